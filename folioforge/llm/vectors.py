"""Embedding near-duplicates by range search on a robust-pruned flat graph."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import connected_components, let, materialise, pair_cells

#: Bytes of query vectors that an audit sends to each task at a time.
AUDIT_BYTES = 1 << 26


@dataclass(frozen=True)
class Graph:
    """Parameters of the graph and its search."""

    threshold: float = 0.9
    #: Vectors the coarse centres are fitted on at most, and their bytes on the driver; a hash picks them. Centres of the coarse level have a fourth of these bytes at most.
    sample: int = 20_000
    sample_bytes: int = 1 << 26
    #: Vectors of a shard aimed at, and the centres a vector is dealt to at least.
    shard: int = 1500
    overlap: int = 3
    #: Shards of a coarse cell aimed at, and coarse cells at most.
    fine: int = 256
    coarse: int = 2048
    #: Share of pairs just at the threshold that must share a centre (at the coarse level only half as many may not); more centres are used for a vector until they do.
    shared: float = 0.99
    #: Vectors dealt by one task at a time.
    dealt: int = 20_000
    #: Vectors of one cell at most about, beyond which a shard is cut into chunks of half as many, of which each pair is a cell.
    cell: int = 2000
    #: Candidates and neighbours of a vertex when the graph is pruned, and the pruning factor.
    candidates: int = 64
    degree: int = 24
    alpha: float = 1.2
    #: Beam of the greedy search, and how far below the threshold it still expands.
    beam: int = 16
    slack: float = 0.05
    seed: int = 5


def classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(rep, first_id, n, dim, v): the different usable vectors at unit length, by a hash, with smallest id and number of rows.

    Null, empty and zero vectors, those with null or non-finite components and rows with a
    null id are left out.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce((x * 0) == 0, F.lit(False))) & F.exists("v", lambda x: F.coalesce(x != 0, F.lit(False)))
    found = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(usable)
    grouped = found.groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n")).withColumn("rep", F.xxhash64("v"))
    # Scaled first, so that squares neither overflow nor vanish; each figure is made once a vector, not once a component.
    scaled = let(F.struct(F.col("v"), F.array_max(F.transform("v", lambda x: F.abs(x))).alias("top")), lambda s: F.transform(s["v"], lambda x: x / s["top"]))
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    unit = let(scaled, lambda v: let(F.struct(v.alias("v"), norm(v).alias("norm")), lambda s: F.transform(s["v"], lambda x: x / s["norm"])))
    return grouped.select("rep", "first_id", "n", F.size("v").alias("dim"), unit.alias("v"))


def nearest_centres(x: np.ndarray, c: np.ndarray, overlap: int) -> np.ndarray:
    """The rows of the ``overlap`` nearest centres, ascending, for each row of ``x``; bounded in memory."""
    take = min(overlap, len(c))
    blocks = [np.argpartition(-(x[at : at + 1024] @ c.T), take - 1, axis=1)[:, :take] for at in range(0, len(x), 1024)]
    return np.sort(np.concatenate(blocks), axis=1) if blocks else np.zeros((0, take), int)


def share_together(x: np.ndarray, c: np.ndarray, overlap: int, threshold: float, seed: int) -> float:
    """Share of pairs at a cosine of exactly ``threshold`` that have one of their nearest centres in common.

    The first of a pair is a vector of ``x``, the second lies beside it in a random direction
    that is drawn with the covariance of ``x``, so that it does not leave the space in which
    the vectors and centres lie. Pairs nearer than the threshold meet more often.
    """
    rng = np.random.default_rng(seed)
    u = x[rng.permutation(len(x))[:2000]]
    beside = rng.normal(size=(len(u), len(u))) @ u
    beside -= (beside * u).sum(axis=1, keepdims=True) * u
    beside /= np.maximum(np.linalg.norm(beside, axis=1, keepdims=True), 1e-12)
    v = threshold * u + np.sqrt(max(0.0, 1 - threshold**2)) * beside
    mine, its = nearest_centres(u, c, overlap), nearest_centres(v, c, overlap)
    return float(np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(mine, its, strict=True)]))


def fit_centres(x: np.ndarray, wanted: float, graph: Graph, shared: float, most: int | None = None) -> tuple[np.ndarray, int]:
    """(unit cluster centres, how many of them a vector is dealt to) from a sample; ``wanted`` centres for an overlap of one.

    As pairs share one of their nearest centres less often the more centres there are, the
    overlap is raised, and the number of centres with it (up to ``most``), until ``shared``
    of the pairs at the threshold share one.
    """
    order = np.random.default_rng(graph.seed).permutation(len(x))
    held = min(2000, len(x) // 4)  # vectors that centres are fitted on lie nearer to them than others do; the share is measured on some kept apart
    apart, fitted = x[order[:held]], x[order[held:]]
    overlap = 1 if wanted < 1 else graph.overlap
    while True:
        c = fitted[: max(1, min(most or len(fitted), round(wanted * overlap)))]
        for _ in range(8 if len(c) > 1 else 0):
            own = nearest_centres(fitted, c, 1)[:, 0]
            total = np.zeros_like(c)
            np.add.at(total, own, fitted)
            norms = np.linalg.norm(total, axis=1, keepdims=True)
            c = np.where(norms > 1e-9, total / np.maximum(norms, 1e-9), c)
        if overlap >= len(c) or not len(apart) or share_together(apart, c, overlap, graph.threshold, graph.seed) >= shared:
            return c, min(overlap, len(c))
        overlap += max(1, overlap // 4)


def coarse_centres(found: DataFrame, graph: Graph) -> dict[int, tuple[np.ndarray, int]]:
    """The coarse centres of each dimension, fitted on the driver; their bytes and the sample's have fixed bounds."""
    out = {}
    for dim, count in found.groupBy("dim").count().collect():
        wanted = min(graph.coarse, count / graph.shard / graph.fine)
        if wanted <= 1:
            out[dim] = np.eye(1, dim), 1
            continue
        rows = max(1, min(graph.sample, graph.sample_bytes // (8 * dim)))
        picked = found.where((F.col("dim") == dim) & (F.pmod(F.xxhash64(F.lit(graph.seed), "rep"), F.lit(1 << 20)) <= min(1.0, rows / count) * (1 << 20))).orderBy("rep").limit(rows)
        x = picked.select("v").toArrow().column(0).combine_chunks().values.to_numpy().reshape(-1, dim)
        out[dim] = fit_centres(x, wanted, graph, (1 + graph.shared) / 2, max(1, min(graph.coarse, graph.sample_bytes // (32 * dim))))
    return out


def deal(found: DataFrame, graph: Graph) -> DataFrame:
    """(rep, shards): the shards of each vector of ``found(rep, dim, v)``, ascending, by two levels of cluster centres.

    Few coarse centres are fitted on the driver. Each coarse cell fits the centres of its own
    shards in one task, on a sample in proportion to them, and its vectors are dealt to these
    in portions, so neither the driver nor a task holds more as the vectors grow.
    """
    middle = coarse_centres(found, graph)

    @F.pandas_udf("array<int>")
    def nearest(dim: pd.Series, v: pd.Series) -> pd.Series:
        return pd.Series([nearest_centres(np.asarray(x)[None, :], *middle[d])[0].astype(np.int32) for d, x in zip(dim, v, strict=True)])

    cell = ["dim", "coarse"]
    spread = materialise(found.select("rep", "dim", "v", F.explode(nearest("dim", "v")).alias("coarse")), "coarse-cells")
    sizes = materialise(spread.groupBy(*cell).agg(F.count("*").alias("size")), "cell-sizes")  # a row for each coarse cell
    sized = spread.join(F.broadcast(sizes), cell)
    wanted = F.col("size") / graph.shard
    share = F.greatest(F.lit(graph.sample / 2), 4 * graph.overlap * wanted) / F.col("size")
    picked = sized.where(F.pmod(F.xxhash64(F.lit(graph.seed + 1), "rep"), F.lit(1 << 20)) <= share * (1 << 20))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        c, overlap = fit_centres(np.stack(pdf["v"]), pdf["size"].iloc[0] / graph.shard, graph, graph.shared)
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1].to_numpy(), "coarse": pdf["coarse"].iloc[:1].to_numpy(), "size": pdf["size"].iloc[:1].to_numpy(), "overlap": [overlap], "centres": [c.ravel()]})

    fitted = materialise(picked.groupBy(*cell).applyInPandas(fit, "dim int, coarse int, size long, overlap int, centres array<double>"), "centres")
    portions = F.ceil(F.col("size") / graph.dealt).cast("long")
    left = sized.withColumn("portion", F.pmod(F.xxhash64(F.lit(19), "rep"), portions))
    right = fitted.withColumn("portion", F.explode(F.sequence(F.lit(0).cast("long"), portions - 1)))

    def assign(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"rep": [], "shards": pd.Series(dtype=object)})
        dim, coarse = int(rows["dim"].iloc[0]), int(rows["coarse"].iloc[0])
        c = np.asarray(centres["centres"].iloc[0]).reshape(-1, dim)
        shards = nearest_centres(np.stack(rows["v"]), c, int(centres["overlap"].iloc[0])) + (coarse << 32)
        return pd.DataFrame({"rep": rows["rep"].to_numpy(), "shards": list(shards)})

    key = [*cell, "portion"]
    dealt = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(assign, "rep long, shards array<long>")
    return dealt.groupBy("rep").agg(F.array_sort(F.flatten(F.collect_list("shards"))).alias("shards"))


def robust_prune(x: np.ndarray, candidates: np.ndarray, own: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Which candidates of each vertex stay neighbours: nearest first, dropping those much nearer to a kept neighbour.

    ``candidates`` has rows of ``x`` for each vertex and ``own`` the vertex's cosines with
    them, falling. Distances are squared Euclidean ones. The nearest is always kept.
    """
    some = x[candidates]
    between, own = 2 - 2 * (some @ some.transpose(0, 2, 1)), 2 - 2 * own
    alive, kept, count = np.ones(own.shape, bool), np.zeros(own.shape, bool), np.zeros(len(own), int)
    for j in range(own.shape[1]):
        pick = np.flatnonzero(alive[:, j] & (count < degree))
        kept[pick, j] = True
        count[pick] += 1
        if (count == degree).all():
            break
        alive[pick] &= alpha * between[pick, j] > own[pick]
    return kept


def nearest_cosines(x: np.ndarray) -> np.ndarray:
    """Each unit vector's cosine with the nearest other one; -3 for one alone."""
    top = np.full(len(x), -3.0)
    for at in range(0, len(x) if len(x) > 1 else 0, 256):
        cosines = x[at : at + 256] @ x.T
        line = np.arange(len(cosines))
        cosines[line, line + at] = -3
        top[at : at + 256] = cosines.max(axis=1)
    return top


def shard_graph(x: np.ndarray, graph: Graph) -> tuple[list[np.ndarray], np.ndarray]:
    """Pruned adjacency lists of unit vectors, and each vertex's cosine with its nearest.

    Reverse edges are added, and lists that grow over twice the degree by them pruned again.
    """
    n = len(x)
    take, top, edges = min(graph.candidates, n - 1), np.full(n, -3.0), [np.zeros(0, np.int64)]
    for at in range(0, n if take else 0, 256):
        cosines = x[at : at + 256] @ x.T
        line = np.arange(len(cosines))[:, None]
        cosines[line[:, 0], line[:, 0] + at] = -3
        nearest = np.argpartition(-cosines, take - 1, axis=1)[:, :take]
        nearest = nearest[line, np.argsort(-cosines[line, nearest], axis=1, kind="stable")]
        own = cosines[line, nearest]
        top[at : at + 256] = own[:, 0]
        rows, at_rank = np.nonzero(robust_prune(x, nearest, own, graph.degree, graph.alpha))
        heads, tails = rows + at, nearest[rows, at_rank]
        edges += [heads * n + tails, tails * n + heads]
    heads, tails = np.divmod(np.unique(np.concatenate(edges)), n)
    lists = np.split(tails, np.searchsorted(heads, np.arange(1, n)))
    for r, near in enumerate(lists):
        if len(near) > 2 * graph.degree:
            own = x[near] @ x[r]
            order = np.argsort(-own, kind="stable")
            lists[r] = np.sort(near[order][robust_prune(x, near[order][None], own[order][None], 2 * graph.degree, graph.alpha)[0]])
    return lists, top


def graph_parts(adjacency: np.ndarray) -> list[np.ndarray]:
    """The vertices of each connected component of a graph, edges taken both ways, as range_search takes it."""
    label = np.arange(len(adjacency))
    near = np.where(adjacency >= 0, adjacency, label[:, None])
    while True:
        least = np.minimum(label, label[near].min(axis=1))
        np.minimum.at(least, near, least[:, None])  # lists that were pruned again are not symmetric
        least = least[least]
        if (least == label).all():
            return [np.flatnonzero(label == g) for g in np.unique(label)]
        label = least


def range_search(x: np.ndarray, adjacency: np.ndarray, parts: list[np.ndarray], graph: Graph, queries: np.ndarray) -> list[np.ndarray]:
    """For each query row the rows of ``x`` within the threshold that the search meets.

    Every query meets its own vertex. In each component of the graph, greedy best-first steps
    from the component's medoid keep a beam of fixed width for each query, so that a group
    that is a component of its own is entered too; all vertices of a component no larger than
    a vertex's candidates are met. Then, as long as vertices within the threshold (less the
    slack) are met, their neighbours are met too, a round of all queries at a time.
    ``adjacency`` has one row for each vertex, filled with -1.
    """
    n, m = len(x), len(queries)
    met = np.zeros((m, n), bool)
    cosine = np.full((m, n), -3.0, np.float32)
    q = x[queries]

    def meet(rows: np.ndarray, vertices: np.ndarray) -> None:
        for a in range(0, len(rows), 1 << 16):
            r, v = rows[a : a + (1 << 16)], vertices[a : a + (1 << 16)]
            cosine[r, v] = np.einsum("ij,ij->i", q[r], x[v])
            met[r, v] = True

    every = np.arange(m)
    meet(every, queries)
    small = np.concatenate([np.zeros(0, int), *[part for part in parts if len(part) <= graph.candidates]])
    cosine[:, small], met[:, small] = q @ x[small].T, True
    for part in parts:
        if len(part) <= graph.candidates:
            continue
        start = part[(x[part] @ x[part].mean(axis=0)).argmax()]
        meet(every, np.full(m, start))
        beam = np.full((m, graph.beam), -1)
        beam[:, 0] = start
        score = np.full((m, graph.beam), -4.0, np.float32)  # of what is in the beam and not stepped from yet
        score[:, 0] = cosine[:, start]
        kept = score.copy()
        active = every
        while len(active):
            best = score[active].argmax(axis=1)
            active, best = active[score[active, best] > -4], best[score[active, best] > -4]
            vertices = beam[active, best]
            score[active, best] = -4
            near = adjacency[vertices]
            fresh = (near >= 0) & ~met[active[:, None], near]
            rows, at = np.nonzero(fresh)
            meet(active[rows], near[rows, at])
            new = np.where(fresh, cosine[active[:, None], near], -5)
            all_ids = np.concatenate([beam[active], near], axis=1)
            all_kept, all_score = np.concatenate([kept[active], new], axis=1), np.concatenate([score[active], new], axis=1)
            top = np.argpartition(-all_kept, graph.beam - 1, axis=1)[:, : graph.beam]
            line = np.arange(len(active))[:, None]
            beam[active], kept[active], score[active] = all_ids[line, top], all_kept[line, top], all_score[line, top]
    frontier = (cosine >= graph.threshold - graph.slack) & met
    ends = np.nonzero(adjacency >= 0)[0], adjacency[adjacency >= 0]
    edges = np.unique(np.stack([np.concatenate(ends), np.concatenate(ends[::-1])], axis=1), axis=0)  # both ways, by the first end
    targets, starts = np.unique(edges[:, 0], return_index=True)
    while len(edges) and frontier.any():
        live = np.flatnonzero(frontier.any(axis=1))
        bits = np.packbits(frontier[live], axis=0).T  # the queries as bits beside each vertex, so that lists are united by words
        united = np.bitwise_or.reduceat(bits[edges[:, 1]], starts, axis=0)
        reached = np.zeros((len(live), n), bool)
        reached[:, targets] = np.unpackbits(united, axis=1, count=len(live)).T
        rows, vertices = np.nonzero(reached & ~met[live])
        meet(live[rows], vertices)
        frontier = np.zeros((m, n), bool)
        frontier[live[rows], vertices] = cosine[live[rows], vertices] >= graph.threshold - graph.slack
    return [np.flatnonzero(row) for row in cosine >= graph.threshold - 1e-4]


def near_duplicates(vectors: DataFrame, graph: Graph = Graph(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Vectors link at a cosine of ``threshold`` or more in double precision, checked for every
    link. Equal vectors are one vertex. Vertices are dealt to overlapping cluster shards;
    each shard builds a robust-pruned graph, the adjacency lists of a vertex are united over
    its shards, and each shard searches the united lists among its vertices for each of
    them. Only vertices whose nearest in the shard is within the threshold (less the slack)
    are in its graph and go on to the search: both ends of a link are such, and so is all
    that range expansion steps from, so this loses no link. Every link found joins
    components; a pair that shares several shards is counted in the first only, so links are
    counted without listing pairs; none are capped. Shards that
    grow beyond a cell are searched as pairs of chunks. The search of a cell stays in it:
    neighbours outside are met in the cells that they share. Vectors of different lengths
    never link. How many shards a vector is dealt to is measured on the data (see ``deal``).
    Unusable vectors and rows without an id (see ``classes``) have no links, a component
    of their own and are kept.
    """
    found = materialise(classes(vectors, id_col, vector_col), "vectors")
    homes = materialise(deal(found, graph), "shards")
    members = homes.join(found.select("rep", "dim"), "rep").select("rep", "dim", F.explode("shards").alias("shard"))
    cells = materialise(pair_cells(members, ["dim", "shard"], "rep", graph.cell, max(1, graph.cell // 2)), "cells")  # without the vectors, which are fetched where they are needed
    cell = ["dim", "shard", "cell_a", "cell_b"]
    near_enough = graph.threshold - graph.slack - 1e-4

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["v"])
        some = np.flatnonzero(nearest_cosines(x) >= near_enough)
        reps = pdf["rep"].to_numpy()[some]
        return pd.DataFrame({"rep": reps, "near": pd.Series([reps[near] for near in shard_graph(x[some], graph)[0]] if len(some) else [], dtype=object)})

    single = found.select("rep", F.col("v").cast("array<float>").alias("v"))
    built = cells.select(*cell, "rep").join(single, "rep").groupBy(*cell).applyInPandas(build, "rep long, near array<long>")
    united = materialise(built.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")
    searched = cells.join(united.join(homes, "rep").join(found.select("rep", "n", "v"), "rep"), "rep")

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        _, shard, a, b = key
        pdf = pdf.sort_values("rep", ignore_index=True)
        x, reps, size = np.stack(pdf["v"]), pdf["rep"].to_numpy(), pdf["n"].to_numpy()
        chunk, homes = pdf["chunk"].to_numpy(), np.full((len(pdf), pdf["shards"].map(len).max()), -1)
        for i, shards in enumerate(pdf["shards"]):
            homes[i, : len(shards)] = shards
        place = [np.searchsorted(reps, near) for near in pdf["near"]]
        local = [p[(p < len(reps)) & (reps[np.minimum(p, len(reps) - 1)] == near)] for p, near in zip(place, pdf["near"], strict=True)]
        adjacency = np.full((len(reps), max([1, *map(len, local)])), -1)
        for i, near in enumerate(local):
            adjacency[i, : len(near)] = near
        parts = graph_parts(adjacency)
        linked = np.zeros((len(reps), len(reps)), bool)
        single = x.astype(np.float32)
        for at in range(0, len(reps), 512):
            queries = np.arange(at, min(at + 512, len(reps)))
            for i, others in zip(queries, range_search(single, adjacency, parts, graph, queries), strict=True):
                linked[i, others[x[others] @ x[i] >= graph.threshold]] = True
        linked |= linked.T  # what either side's search has met is a link of both
        np.fill_diagonal(linked, False)
        links, parent, edges = np.zeros(len(reps), np.int64), np.arange(len(reps)), []
        for i in np.flatnonzero(linked.any(axis=1)):
            others = np.flatnonzero(linked[i])
            # counted here only if this is the first shard that both are dealt to, and in the cell of their chunks
            common = np.isin(homes[others], homes[i][homes[i] >= 0])
            first = np.where(common, homes[others], np.iinfo(np.int64).max).min(axis=1)
            ours = (first == shard) & (np.minimum(chunk[others], chunk[i]) == a) & (np.maximum(chunk[others], chunk[i]) == b)
            links[i] = size[others[ours]].sum()
            groups, where = np.unique(parent[others], return_index=True)
            for g, w in zip(groups, where, strict=True):
                if g != parent[i]:
                    edges.append((reps[i], reps[others[w]]))
                    parent[parent == g] = parent[i]
        some = np.flatnonzero(links)
        u, v = np.array(edges, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"rep": np.concatenate([reps[some], u]), "links": np.concatenate([links[some], 0 * u]), "other": np.concatenate([reps[some], v])})

    result = materialise(searched.groupBy(*cell).applyInPandas(search, "rep long, links long, other long"), "links")
    counted = result.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = connected_components(result.where("other <> rep").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    whole = found.select("rep", "first_id", "n").join(counted, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    whole = whole.select("rep", "first_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    first = whole.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = whole.join(first, "component").select(F.col("rep").alias("__rep"), "n_links", "component_id")
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.when(F.col(id_col).isNotNull(), F.xxhash64(v)).alias("__key"))
    joined = rows.join(known, rows["__key"] == known["__rep"], "left")
    component = F.coalesce("component_id", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(True))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def audit_recall(vectors: DataFrame, answer: DataFrame, every: int = 50, graph: Graph = Graph(), id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Links of every ``every``-th vector (by id) that ``answer`` counts, as a share of those brute force counts.

    The queries, a stated part of the rows, travel in blocks of AUDIT_BYTES; for each block
    the rows pass once, where they lie, and tasks return one count a query.
    """
    spark = vectors.sparkSession
    found = materialise(classes(vectors, id_col, vector_col), "audited")
    queries = materialise(classes(vectors.where(F.col(id_col) % every == 0).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v0")), "vec_id", "v0"), "queries")
    blocks = max(1, -(-(queries.agg(F.sum("dim")).first()[0] or 0) * 8 // AUDIT_BYTES))
    truth = None
    for block in range(blocks):
        some = queries.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == block).select("first_id", "dim", "v").toPandas()
        by_dim = {int(d): (g["first_id"].to_numpy(), np.stack(g["v"])) for d, g in some.groupby("dim")}
        sent = spark.sparkContext.broadcast(by_dim)

        def count(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            totals = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in sent.value.items()}
            for batch in batches:
                for d, rows in batch.groupby("dim"):
                    if d in totals:
                        totals[d] += (sent.value[d][1] @ np.stack(rows["v"]).T >= graph.threshold) @ rows["n"].to_numpy()
            for d, total in totals.items():
                yield pd.DataFrame({"vec_id": sent.value[d][0], "true_links": total})

        part = materialise(found.select("dim", "n", "v").mapInPandas(count, "vec_id long, true_links long").groupBy("vec_id").agg((F.sum("true_links") - 1).alias("true_links")), "truth")
        truth = part if truth is None else truth.unionByName(part)
        sent.destroy()
    got, want = truth.join(answer.select(F.col("vec_id").alias("__id"), "n_links"), F.col("vec_id") == F.col("__id")).agg(F.sum("n_links"), F.sum("true_links")).first()
    return 1.0 if not want else got / want
