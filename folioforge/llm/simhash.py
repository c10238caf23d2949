"""SimHash near-duplicates: fingerprints of word shingles, compared as bit planes.

``near_duplicates`` links by the fingerprints alone; ``similar`` takes a wide radius, whose
buckets are those of the least shingle hashes, and lets the shingles themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import among, connected_components, filled, materialise, pair_cells, text_key

BITS = 64
#: Fingerprints of one cell at most; larger buckets are dealt into pairs of chunks.
CELL = 4096
#: Expected bucket size that the number of tables is chosen for.
BUCKET = 1500
#: Shingles counted at a time, which bounds memory on very long texts.
RUN = 1 << 16
#: Bands of least hashes and hashes in each: a pair of similarity 0.8 meets in a band in all but 5 of 100,000 cases.
BANDS, ROWS = 25, 5
#: Sketches of one cell of ``similar`` at most, rounds of spanning candidates, and bytes of shingle hashes in one cell where texts are compared whole.
SMALL_CELL, TURNS, SET_BYTES = 4096, 2, 1 << 24
#: Fingerprints of texts of similarity 0.8 differ in 10 bits in the mean (12 with few shingles), in more than this in under one of a million.
WIDE = 28


def fingerprint_bytes(data: bytes | None, shingle: int = 4, seed: int = 42) -> int:
    """The signed 64-bit fingerprint of one text in UTF-8; 0 without words.

    A bit is 1 if it is set in over half the XXH64 hashes of the shingles, repeats included.
    A text of fewer words than a shingle counts as one shingle of all of them.
    """
    words = (data or b"").lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        parts = [words]
    else:
        parts = zip(*(words[k:] for k in range(shingle)), strict=False)
    digest = xxhash.xxh64_digest
    digests = [digest(x, seed) for x in map(b" ".join, parts)]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(digests), RUN):
        run = np.frombuffer(b"".join(digests[at : at + RUN]), np.uint8).reshape(-1, BITS // 8)
        counts += np.unpackbits(run, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(digests)).tobytes(), "big", signed=True)


def fingerprint(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """The fingerprint column (long) of a text column; null and blank texts give 0."""

    @F.pandas_udf("long")
    def of(data: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_bytes(x, shingle, seed) for x in data], dtype="int64")

    return of(text.cast("binary"))


def tables_for(n: int, radius: int) -> list[int]:
    """Masks whose bits, for any two fingerprints within the radius, agree under at least one mask.

    The bits are cut into m blocks. Within the radius at least m - radius blocks agree, so one
    table for each choice of m - radius blocks misses nothing. m grows with the number of
    fingerprints to keep buckets near a fixed size; the result is exact for every m.
    """
    for m in range(radius + 1, radius + 5):
        edges = [round(BITS * k / m) for k in range(m + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
        masks = [sum(c) for c in combinations(blocks, m - radius)]
        if n <= BUCKET << min(x.bit_count() for x in masks):
            break
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in masks]


def close_pairs(prints: np.ndarray, radius: int, queries: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j > i within the radius of i) among unsigned 64-bit fingerprints.

    The block's fingerprints lie vertically, one bit plane for each bit position. For many
    queries at once, a plane XORed with the query's bit is added to carry-save counters of a
    few bits, which hold 64 distances in each machine word. The counters start so high that
    they overflow beyond the radius; a run of queries is abandoned once every lane has.
    """
    n = len(prints)
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(n, 8), axis=1)
    varying = np.flatnonzero(bits.any(axis=0) & ~bits.all(axis=0))
    words = -(-n // 64)
    planes = np.zeros((len(varying), words * 8), np.uint8)
    planes[:, : -(-n // 8)] = np.packbits(bits[:, varying].T, axis=1, bitorder="little")
    planes = planes.view("<u8")
    width = radius.bit_length() if radius else 1
    start = (1 << width) - 1 - radius
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    for at in range(0, n, queries):
        rows = np.arange(at, min(at + queries, n))
        own = np.arange(words * 64)[None, :] <= rows[:, None]
        own[:, n:] = True
        beyond = np.packbits(own, axis=1, bitorder="little").view("<u8")
        counters = [np.full((len(rows), words), ones if start >> k & 1 else 0, np.uint64) for k in range(width)]
        for k, b in enumerate(varying):
            carry = planes[k][None, :] ^ np.where(bits[rows, b], ones, np.uint64(0))[:, None]
            for counter in counters:
                held = counter & carry
                counter ^= carry
                carry = held
            beyond |= carry
            if k % 8 == 7 and (beyond == ones).all():
                break
        else:
            near = ~beyond
            for r in np.flatnonzero(near.any(axis=1)):
                yield int(rows[r]), np.flatnonzero(np.unpackbits(near[r].view(np.uint8), bitorder="little"))


def spanning_edges(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges between fingerprints that join the same ones as all close pairs do, one fewer than the members at most."""
    label, edges = np.arange(len(prints)), []
    for i, others in close_pairs(prints, radius):
        found, first = np.unique(label[others], return_index=True)
        fresh = found != label[i]
        if fresh.any():
            edges += [(i, int(others[j])) for j in first[fresh]]
            label[np.isin(label, found[fresh])] = label[i]
    return edges


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id, text_key, first) for every row of ``docs``.

    Two documents are linked if their fingerprints differ in at most ``radius`` bits;
    component_id is the smallest id reachable, and ``first`` is true for the rows with the
    smallest id and, of those, text key of their component. All links count: tables of masked bits give
    candidates that miss no pair, and equal fingerprints are compared once. Rows with a null
    id take part, with null ids ignored when the smallest is sought. Null or blank texts have
    fingerprint 0 and are linked like any other; repeated rows stay, with the same component.
    """
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), text_key(filled(F.col(text_col))).alias("tk"), fingerprint(F.col(text_col), shingle).alias("fp")), "fingerprints")
    prints = materialise(rows.groupBy("fp").agg(smallest_name().alias("named")), "distinct-fingerprints")
    masks = tables_for(prints.count(), radius)
    keys = F.array(*[F.struct(F.lit(t).alias("tbl"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for t, m in enumerate(masks)])
    entries = prints.select("fp", F.explode(keys).alias("k")).select("fp", "k.tbl", "k.bucket")
    cells = (
        pair_cells(entries, ["tbl", "bucket"], "fp", CELL)
        .groupBy("tbl", "bucket", "cell_a", "cell_b")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0)
            flat, offsets = fps.values.to_numpy().view(np.uint64), fps.offsets.to_numpy()
            out = []
            for a, b in zip(offsets, offsets[1:], strict=False):
                out += [(flat[a + i], flat[a + j]) for i, j in spanning_edges(flat[a:b], radius)]
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    labels = connected_components(cells.mapInArrow(links, "u long, v long").distinct())
    member = prints.join(labels, prints.fp == labels.node, "left").select("fp", "named", F.coalesce("component", "fp").alias("component"))
    firsts = member.groupBy("component").agg(F.min("named").alias("named"))
    member = member.select("fp", "component").join(firsts, "component").select("fp", "named")
    return rows.join(member, "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("named.doc_id").alias("component_id"), F.col("tk").alias("text_key"), is_named().alias("first")
    )


def smallest_name() -> Column:
    """Aggregate: the smallest (doc_id, tk) whose id is not null."""
    return F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "tk")))


def is_named() -> Column:
    """Whether a row is what its component is named after."""
    return F.coalesce((F.col("doc_id") == F.col("named.doc_id")) & (F.col("tk") == F.col("named.tk")), F.lit(False))


def shingles(data: bytes | None, size: int) -> np.ndarray:
    """The different XXH64 hashes of the text's word shingles, ascending; a text of fewer words is one shingle."""
    words = (data or b"").lower().split()  # of bytes, as for the fingerprints
    if not words:
        return np.zeros(0, np.uint64)
    parts = [words] if len(words) < size else zip(*(words[k:] for k in range(size)), strict=False)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x) for x in map(b" ".join, parts)), np.uint64))


def set_print(hashes: np.ndarray) -> int:
    """The signed fingerprint of a set of hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), RUN):
        counts += np.unpackbits(hashes[at : at + RUN].view(np.uint8).reshape(-1, BITS // 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def bands(hashes: np.ndarray, seed: int = 42) -> list[int]:
    """One signed hash for each band of the MinHash signature; none without shingles."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        np.minimum(least, (hashes[at : at + 4096, None] * (2 * a + 1) + b).min(axis=0), out=least)
    return [int.from_bytes(xxhash.xxh64_digest(x.tobytes()), "big", signed=True) for x in least.reshape(BANDS, ROWS)]


def spanning_candidates(keys: np.ndarray, prints: np.ndarray, sizes: np.ndarray, component: np.ndarray, similarity: float, turn: int) -> list[tuple[int, int]]:
    """Pairs of keys of different components that may be similar, one fewer than the components at most.

    They join the same components as all such pairs would. ``turn`` sets the order in which
    texts are made centres of their pairs, so that another turn tries other pairs.
    """
    if (component == component[0]).all():
        return []
    order = np.argsort((keys.view(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
    keys, sizes, label, pairs = keys[order], sizes[order], component[order].copy(), []
    for i, others in close_pairs(prints.view(np.uint64)[order], WIDE):
        others = others[(label[others] != label[i]) & may_be(sizes[others], sizes[i], similarity)]
        if len(others):
            found, first = np.unique(label[others], return_index=True)
            pairs += [(int(keys[i]), int(keys[others[j]])) for j in first]
            label[np.isin(label, found)] = label[i]
    return pairs


def may_be(some: np.ndarray, one: int, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can have the similarity."""
    return np.minimum(some, one) >= similarity * np.maximum(some, one)


def apart(keys: np.ndarray, prints: np.ndarray, sizes: np.ndarray, component: np.ndarray, similarity: float) -> np.ndarray:
    """The keys that may be similar to one of another component."""
    marked = np.zeros(len(keys), bool)
    if not (component == component[0]).all():
        for i, others in close_pairs(prints.view(np.uint64), WIDE):
            others = others[(component[others] != component[i]) & may_be(sizes[others], sizes[i], similarity)]
            marked[others] = True
            marked[i] |= len(others) > 0
    return keys[marked]


def verified_links(pdf: pd.DataFrame, similarity: float) -> pd.DataFrame:
    """Links (u, v) among the texts (key, fp, n, component, hashes) of one cell, enough to join what is similar; sets are compared only across components."""
    keys, sizes, label, sets = pdf["key"].to_numpy(), pdf["n"].to_numpy(), pdf["component"].to_numpy().copy(), pdf["hashes"].tolist()
    edges = []
    for i, others in close_pairs(pdf["fp"].to_numpy(np.int64).view(np.uint64), WIDE):
        for j in others[(label[others] != label[i]) & may_be(sizes[others], sizes[i], similarity)]:
            if label[i] != label[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both and both >= similarity * (sizes[i] + sizes[j] - both):
                    edges.append((keys[i], keys[j]))
                    label[label == label[j]] = label[i]
    return pd.DataFrame(np.array(edges, np.int64).reshape(-1, 2), columns=["u", "v"])


def cell_members(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(cell, [keys, prints, sizes, components]) of a batch with columns cell and m, an array of these."""
    lists = batch.column(1)
    columns = [lists.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)]
    offsets = lists.offsets.to_numpy()
    for cell, a, b in zip(batch.column(0).to_pylist(), offsets, offsets[1:], strict=False):
        yield cell, [c[a:b] for c in columns]


def similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, component_id, first) for every row: the smallest id reachable over links of similar texts.

    ``first`` is true for the rows with the smallest id and, of those, text key of their
    component, so rows that share an id with other texts are told apart. Texts link where
    their sets of word shingles have a Jaccard similarity of ``similarity`` or more, computed
    for every link. Texts share a bucket where they share a band of least shingle hashes;
    within a bucket, fingerprints of the sets are compared as bit planes, and what is within
    WIDE bits is a candidate. Texts of equal sets, and all texts without words, are one
    vertex. Null ids are ignored when the smallest is sought; null, empty and repeated rows
    keep a row each.

    Buckets hold sketches of a few bytes. First only candidates that would span a bucket are
    verified, so a group of copies costs its size and not its square; where they fail, others
    are tried (TURNS). Then what may still be similar across components is compared whole,
    set by set, in cells bounded by SET_BYTES. ``docs`` is read again for the texts of
    candidates, so no text is written before it is known to be one.
    """

    @F.pandas_udf("struct<key: long, fp: long, n: int, bands: array<long>>")
    def sketch(data: pd.Series) -> pd.DataFrame:
        sets = [shingles(x, shingle) for x in data]
        keys = [int.from_bytes(xxhash.xxh64_digest(x.tobytes()), "big", signed=True) for x in sets]
        return pd.DataFrame({"key": keys, "fp": [set_print(x) for x in sets], "n": [len(x) for x in sets], "bands": [bands(x) for x in sets]})

    @F.pandas_udf("array<long>")
    def hashes(data: pd.Series) -> pd.Series:
        return pd.Series([shingles(x, shingle).view(np.int64) for x in data])

    text = F.col(text_col)
    named = text_key(filled(text)).alias("tk")
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), named, sketch(text.cast("binary")).alias("s")).select("doc_id", "tk", "s.*"), "sketches")
    classes = materialise(rows.groupBy("key").agg(smallest_name().alias("named"), F.min("tk").alias("tk"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    entries = classes.select("key", "fp", "n", F.posexplode("bands").alias("band", "value"))
    shared = entries.groupBy("band", "value").agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    dealt = pair_cells(materialise(entries.join(shared, ["band", "value"]), "buckets"), ["band", "value"], "key", SMALL_CELL)
    # Most pairs meet in many bands; cells of the same texts are one.
    cells = dealt.groupBy("band", "value", "cell_a", "cell_b").agg(F.sort_array(F.collect_list(F.struct("key", "fp", "n"))).alias("m")).where(F.size("m") > 1).select("m").distinct()
    members = materialise(cells.select(F.xxhash64("m").alias("cell"), F.explode("m").alias("x")).select("cell", "x.*"), "cells")
    wanted = materialise(classes.join(members.select("key").distinct(), "key", "left_semi").select("key", "tk"), "wanted")
    texts = among(docs.select(named, text.alias("text")), "tk", wanted.select("tk")).groupBy("tk").agg(F.first("text").alias("text")).join(wanted, "tk")
    sets = materialise(texts.select("key", hashes(F.col("text").cast("binary")).alias("hashes")), "sets")

    def placed(some: DataFrame, labels: DataFrame) -> DataFrame:
        """Keys with their component so far."""
        return some.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))

    def grouped(labels: DataFrame) -> DataFrame:
        return placed(members, labels).groupBy("cell").agg(F.collect_list(F.struct("key", "fp", "n", "component")).alias("m"))

    def spanning(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pairs = [p for _, m in cell_members(batch) for p in spanning_candidates(*m, similarity, turn)]
                both = np.array(pairs, np.int64).reshape(-1, 2)
                yield pa.record_batch([pa.array(both.min(axis=1)), pa.array(both.max(axis=1))], ["u", "v"])

        return run

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(cell, apart(*m, similarity)) for cell, m in cell_members(batch)]
            cells_, keys = [np.full(len(k), c) for c, k in found], [k for _, k in found]
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *cells_])), pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))], ["cell", "key"])

    links, labels = members.select(F.col("key").alias("u"), F.col("key").alias("v")).limit(0), members.select(F.col("key").alias("node"), F.col("key").alias("component")).limit(0)
    for turn in range(TURNS):
        tried = grouped(labels).mapInArrow(spanning(turn), "u long, v long").distinct()
        ends = [sets.select(F.col("key").alias(k), F.col("hashes").alias(f"{k}_hashes")) for k in ("u", "v")]
        both = tried.join(ends[0], "u").join(ends[1], "v").withColumn("both", F.size(F.array_intersect("u_hashes", "v_hashes")))
        good = (F.col("both") > 0) & (F.col("both") >= similarity * (F.size("u_hashes") + F.size("v_hashes") - F.col("both")))
        links = links.union(materialise(both.where(good).select("u", "v"), "links"))
        labels = materialise(connected_components(links), "labels")
    rest = materialise(grouped(labels).mapInArrow(left, "cell long, key long").join(members, ["cell", "key"]), "apart")
    if not rest.isEmpty():
        whole = pair_cells(rest, ["cell"], "key", SET_BYTES, weight=F.col("n").cast("long") * 8)
        more = placed(whole.join(sets, "key"), labels).groupBy("cell", "cell_a", "cell_b").applyInPandas(lambda pdf: verified_links(pdf, similarity), "u long, v long")
        labels = materialise(connected_components(links.union(more.distinct())), "labels")
    member = classes.join(labels, classes.key == labels.node, "left").select("key", "named", F.coalesce("component", "key").alias("component"))
    firsts = member.groupBy("component").agg(F.min("named").alias("named"))
    known = member.select("key", "component").join(firsts, "component").select("key", "named")
    return rows.select("doc_id", "tk", "key").join(known, "key").select(F.col("doc_id").alias(id_col), F.col("tk").alias("text_key"), F.col("named.doc_id").alias("component_id"), is_named().alias("first"))


def keep_one(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component in ``found`` (as ``similar`` and ``near_duplicates`` give it), one row for each.

    A document is an id and a text: where rows share an id, each text is judged by itself,
    and of rows equal in both one stays, whatever their other columns are. Documents without
    words are linked with each other, so one of them stays. Rows with a null id cannot be
    named as anyone's copy and stay.
    """
    kept = found.where("first").select(F.col(id_col).alias("__id"), F.col("text_key").alias("__tk")).distinct()
    keyed = docs.select(F.col(id_col).alias("__id"), text_key(filled(F.col(text_col))).alias("__tk"), F.struct(*docs.columns).alias("__row"))
    plain = [F.col(f"__row.{f.name}") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    best = keyed.join(kept, ["__id", "__tk"], "left_semi").groupBy("__id", "__tk").agg(F.min_by("__row", F.xxhash64(*plain)).alias("__row"))
    return best.select("__row.*").unionByName(docs.where(F.col(id_col).isNull()))
