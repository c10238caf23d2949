"""Embedding whitening by a tall-skinny QR: R factors of partitions, merged as a tree, and the SVD of the last."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import materialise

#: Bytes of R factors that one merging task holds about, and of whitening models that driver and tasks hold.
MERGE_BYTES, MODEL_BYTES = 1 << 28, 1 << 28
#: Up to here a figure fits in 64 bits with room for a sum.
EXACT = float(1 << 62)


@dataclass(frozen=True)
class Whitening:
    """Entries become floor(scale * c); ``components`` directions of largest variance are returned.

    A direction whose variance is under ``rank`` times the largest counts as none.
    """

    scale: int = 256
    components: int = 4
    rank: float = 1e-24
    #: Rows that a QR takes at a time.
    block: int = 4096


def quantised(vectors: DataFrame, rules: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x, dim): the rows with a usable vector, entries as longs; what a long cannot hold is the nearest that it can."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda c: F.coalesce((c * 0) == 0, F.lit(False))))
    limit = float((1 << 63) - 1024)
    x = F.transform("v", lambda c: F.floor(F.greatest(F.least(rules.scale * c, F.lit(limit)), F.lit(-limit))).cast("long"))
    return rows.select("vec_id", x.alias("x"), F.size("v").alias("dim"))


def matrices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of the lists of one batch, for each length that occurs."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, flat[offsets[rows][:, None] + np.arange(dim)]


def exact_sums(fit: DataFrame) -> DataFrame:
    """(dim, n, sums): for each vector length the number of vectors of the fit list and the exact sum of each entry.

    Tasks add integers and give one row for each length and entry; these are added as decimals.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            for dim, rows, x in matrices(batch.column(0)):
                n, sums = totals.get(dim, (0, np.zeros(dim, object)))
                safe = float(np.abs(x.astype(float)).max(initial=0)) * len(x) < EXACT
                totals[dim] = n + len(rows), sums + (x if safe else x.astype(object)).sum(axis=0).astype(object)
        out = [(dim, k, n, str(s)) for dim, (n, sums) in totals.items() for k, s in enumerate(sums)]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["dim", "k", "n", "s"]).astype({"dim": "int32", "k": "int32", "n": "int64", "s": "str"}), preserve_index=False)

    parts = fit.select("x").mapInArrow(run, "dim int, k int, n long, s string")
    by_entry = parts.groupBy("dim", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda e: e["s"].cast("string"))
    return by_entry.groupBy("dim").agg(F.max("n").alias("n"), listed.alias("sums"))


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they suffice, else Python's."""
    largest = float(np.abs(x.astype(float)).max(initial=0)) * n + float(max(map(abs, sums), default=0))
    return n * x - sums.astype(np.int64) if largest < EXACT else n * x.astype(object) - sums


def deviation(moved: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null beyond a long."""
    largest = float(np.abs(moved.astype(float)).max(initial=0))
    if largest * largest * max(1, moved.shape[1]) < EXACT:
        return (moved.astype(np.int64) ** 2).sum(axis=1).tolist()
    found = (moved.astype(object) ** 2).sum(axis=1)
    return [int(d) if d < 1 << 63 else None for d in found]


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    """The square R factor of the rows of ``blocks``; rows of zeros where there are fewer rows than columns."""
    r = np.linalg.qr(np.concatenate(blocks), mode="r")
    return np.concatenate([r, np.zeros((r.shape[1] - len(r), r.shape[1]))])


def _models(spark_rows: list) -> dict[int, tuple[int, np.ndarray]]:
    return {r.dim: (r.n, np.array([int(s) for s in r.sums], object)) for r in spark_rows}


def partition_factors(fit: DataFrame, sums: dict[int, tuple[int, np.ndarray]], rules: Whitening) -> DataFrame:
    """(dim, slot, r): the R factor of the centred vectors of each partition, its rows one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in matrices(batch.column(0)):
                for at in range(0, len(x) if dim else 0, rules.block):
                    rows = (centred(x[at : at + rules.block], *sums[dim]) / sums[dim][0]).astype(float)
                    factors[dim] = triangle([factors[dim], rows] if dim in factors else [rows])
        slot = TaskContext.get().partitionId()
        for dim, r in factors.items():
            yield pa.record_batch([pa.array([dim], "int32"), pa.array([slot], "int32"), pa.array([r.ravel()], pa.list_(pa.float64()))], ["dim", "slot", "r"])

    return fit.select("x").mapInArrow(run, "dim int, slot int, r array<double>")


def merged_factors(factors: DataFrame, largest: int) -> DataFrame:
    """The factors of each length merged level by level until one is left; (dim, slot, r).

    A task merges as many as MERGE_BYTES hold (two at least), so memory does not grow with
    the number of partitions. Each level is written, and a lost executor costs one level.
    """
    fan = max(2, min(32, MERGE_BYTES // (8 * largest * largest)))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        pdf = pdf.sort_values("slot")
        r = triangle([np.asarray(x).reshape(-1, dim) for x in pdf["r"]])
        return pd.DataFrame({"dim": [dim], "slot": [int(pdf["slot"].iloc[0]) // fan], "r": [r.ravel()]})

    current = materialise(factors, "factors")
    while (current.agg(F.max("slot")).first()[0] or 0) > 0:
        current = materialise(current.groupBy("dim", F.floor(F.col("slot") / fan).alias("next")).applyInPandas(merge, "dim int, slot int, r array<double>"), "factors")
    return current


def directions(factors: DataFrame, sums: dict[int, tuple[int, np.ndarray]], rules: Whitening) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """For each length the unit eigenvectors (rows), their eigenvalues, falling, and the trace of the covariance.

    Right singular vectors of the last R factor, which is square and taken apart in a task;
    the eigenvalues are its squared singular values over n. A vector's largest entry is
    positive, which settles its sign.
    """
    counts = {dim: n for dim, (n, _) in sums.items()}

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(pdf["dim"].iloc[0])
        _, s, v = np.linalg.svd(np.asarray(pdf["r"].iloc[0]).reshape(-1, dim))
        v = v[: rules.components]
        v = v * np.where(v[np.arange(len(v)), np.abs(v).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
        e = s * s / counts[dim]
        return pd.DataFrame({"dim": [dim], "v": [v.ravel()], "e": [e[: rules.components]], "trace": [float(e.sum())]})

    rows = factors.groupBy("dim").applyInPandas(split, "dim int, v array<double>, e array<double>, trace double").collect()  # as many as there are lengths
    return {r.dim: (np.array(r.v).reshape(-1, r.dim), np.array(r.e), r.trace) for r in rows}


def projected(moved: np.ndarray, n: int, v: np.ndarray, e: np.ndarray, rank: float) -> np.ndarray:
    """Whitened coordinates; not a number along directions without variance."""
    live = e > rank * max(e.max(initial=0.0), 1e-300)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(live, ((moved / n).astype(float) @ v.T) / np.sqrt(np.where(live, e, 1.0)), np.nan)


def identity_errors(fit: DataFrame, sums: dict, found: dict, rules: Whitening) -> dict[int, float]:
    """For each length the largest entry, without sign, of the whitened fit list's covariance minus the identity.

    Tasks give sums and sums of products of a few coordinates, which are added.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, x in matrices(batch.column(0)):
                if dim in found:
                    w = np.nan_to_num(projected(centred(x, *sums[dim]), sums[dim][0], *found[dim][:2], rules.rank))
                    w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
                    total[dim] = total.get(dim, 0) + w.T @ w
        out = [(dim, k, float(t)) for dim, m in total.items() for k, t in enumerate(m.ravel())]
        yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["dim", "k", "t"]).astype({"dim": "int32", "k": "int32", "t": "float64"}), preserve_index=False)

    sent = fit.select("x").mapInArrow(run, "dim int, k int, t double").groupBy("dim", "k").agg(F.sum("t").alias("t")).orderBy("dim", "k").collect()
    errors = {}
    for dim, (_, e, _) in found.items():
        m = np.array([r.t for r in sent if r.dim == dim]).reshape(len(e) + 1, -1)
        n, mean = m[-1, -1], m[-1, :-1] / m[-1, -1]
        live = np.flatnonzero(e > rules.rank * max(e.max(initial=0.0), 1e-300))
        cov = (m[:-1, :-1] / n - np.outer(mean, mean))[np.ix_(live, live)]
        errors[dim] = float(np.abs(cov - np.eye(len(live))).max(initial=0.0))
    return errors


def whiten(vectors: DataFrame, rules: Whitening = Whitening(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component.

    Entries c are taken as floor(scale * c). The fit list holds each different such vector
    once; n is its length. Components are unit eigenvectors of its covariance, by falling
    eigenvalue, from a QR of the centred list; no covariance is formed. deviation is the
    exact sum of (n * x - S)**2 (null beyond a long), whitened the centred row along the
    component over the root of its eigenvalue, explained the eigenvalue's share of all,
    identity_error the check of the whitened list's covariance, one value for a length.

    Null vectors and those with null or non-finite entries have no rows; null ids, repeated
    rows and other columns of ``vectors`` do no harm. Vectors of different lengths are
    whitened apart; empty ones have no components. Along a direction without variance (one
    vector only, or all in a plane) whitened is null and explained 0 (null if nothing varies).
    """
    spark = vectors.sparkSession
    schema = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = quantised(vectors, rules, id_col, vector_col)
    out_schema = schema.format(rows.schema["vec_id"].dataType.simpleString())
    fit = materialise(rows.where("dim > 0").select("x", "dim").distinct(), "fit-list")
    lengths, entries = fit.select("dim").distinct().agg(F.count("*"), F.sum("dim")).first()
    if not lengths:
        return spark.createDataFrame([], out_schema)
    if 8 * entries * (rules.components + 8) > MODEL_BYTES:
        raise ValueError(f"{lengths} different vector lengths, {entries} entries in all: whiten them apart")
    sums = _models(exact_sums(fit).collect())  # a row for each length
    found = directions(merged_factors(partition_factors(fit, sums, rules), max(sums)), sums, rules)
    errors = identity_errors(fit, sums, found, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in matrices(batch.column(1)):
                if dim not in found:
                    continue
                n, (v, e, trace) = sums[dim][0], found[dim]
                moved, k = centred(x, *sums[dim]), len(e)
                white = projected(moved, n, v, e, rules.rank).ravel()
                share = np.tile(e / trace if trace > 0 else np.full(k, np.nan), len(at))
                ids = batch.column(0).take(pa.array(np.repeat(at, k)))
                yield pa.record_batch(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(k * len(at), n)), pa.array(deviation(moved), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                        pa.array(white, mask=np.isnan(white)), pa.array(share, mask=np.isnan(share)), pa.array(np.full(k * len(at), errors[dim])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.select("vec_id", "x").mapInArrow(run, out_schema)
