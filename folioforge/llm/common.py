"""What several operators share: row-local helpers, shared storage, hot-group splitting, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.storage import materialise, new_path  # noqa: F401  taken from here by the operators

#: ASCII white space, as in the word patterns of the contracts.
SPACE = r"[\x20\x09-\x0D]"

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, also where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def text_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id; rows equal in both count as one document."""
    return F.xxhash64(text)


def words_of(text: Column, separator: str) -> Column:
    """The non-empty pieces between separators."""
    return F.filter(F.split(text, separator), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each value of an array the combination (associative) of all values before it.

    Blocks of 128 are combined, then the blocks, then the values of a block: an accumulator
    that held the outputs would be copied at each step.
    """
    fold = lambda some: F.aggregate(some, zero, combine)

    def places(v: Column) -> Column:
        blocks = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.shiftright(F.size(v) - 1, 7))).otherwise(F.array().cast("array<int>"))
        sums = F.transform(blocks, lambda b: fold(F.slice(v, b * 128 + 1, F.lit(128))))
        firsts = let(sums, lambda s: F.transform(s, lambda _, b: fold(F.slice(s, F.lit(1), b))))
        return let(firsts, lambda p: F.transform(v, lambda _, i: combine(F.get(p, F.shiftright(i, 7)), fold(F.slice(v, i - i % 128 + 1, i % 128)))))

    return let(values, places)


def same(left: DataFrame, right: DataFrame, columns: Iterable[str]) -> Column:
    """Null-safe equality on columns both sides have."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(right[c])
    return condition


def join_on(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join that keeps one copy of the key columns, those of the left side."""
    renamed = right.select(*[F.col(c).alias(f"__{c}") for c in columns], *[c for c in right.columns if c not in columns])
    condition = F.lit(True)
    for c in columns:
        condition = condition & left[c].eqNullSafe(renamed[f"__{c}"])
    return left.join(renamed, condition, how).drop(*[f"__{c}" for c in columns])


def among(rows: DataFrame, column: str, keys: DataFrame, most_bits: int = 1 << 27) -> DataFrame:
    """The rows whose ``column`` may be among ``keys`` (one column, of hashes as longs): all that are, and at most about a sixteenth of the others.

    To be called before a join of wide rows with few keys, whose shuffle then leaves out what
    would match nothing. The keys' last bits are marked in a bitmap, 16 to 32 bits a key, and
    the bitmap is broadcast in pieces of 4 KB. Beyond ``most_bits`` in all (16 MB) it grows no
    more; then more of the others pass, and still none that matches is lost.
    """
    name = keys.columns[0]
    bits = min(most_bits, 1 << max(15, (16 * keys.count()).bit_length()))
    place = lambda c: F.col(c).bitwiseAND(F.lit(bits - 1))
    marked = keys.groupBy(F.shiftright(place(name), 15).alias("__piece")).agg(F.bitmap_construct_agg(place(name).bitwiseAND(F.lit(32767))).alias("__bits"))
    byte = F.substring("__bits", F.shiftright(place(column), 3).bitwiseAND(F.lit(4095)).cast("int") + 1, F.lit(1))
    bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), place(column).bitwiseAND(F.lit(7)).cast("int"))
    met = rows.withColumn("__piece", F.shiftright(place(column), 15)).join(F.broadcast(marked), "__piece")
    return met.where(bit == 1).select(*rows.columns)


def pair_cells(members: DataFrame, key: list[str], member: str, largest: int, chunk: int | None = None, weight: Column | None = None) -> DataFrame:
    """Deal each group into cells (cell_a, cell_b) of at most about ``2 * largest`` members, or of twice as much ``weight``.

    A group of up to ``largest`` members is one cell. A larger one is cut into chunks (of
    about ``chunk`` members, else ``largest``) by a hash and every pair of chunks becomes a cell, so that any two members still meet in at
    least one cell and no task holds a whole hot group.
    """
    big = members.groupBy(*key).agg((F.count("*") if weight is None else F.sum(weight)).alias("__n")).where(F.col("__n") > largest)
    big = big.select(*key, F.ceil(F.col("__n") / (chunk or largest)).cast("int").alias("__chunks"))
    dealt = members.join(big, key, "left").withColumn("__chunks", F.coalesce("__chunks", F.lit(1)))
    dealt = dealt.withColumn("__chunk", F.pmod(F.xxhash64(F.lit(17), F.col(member)), F.col("__chunks").cast("long")).cast("int"))
    cells = F.transform(
        F.sequence(F.lit(0), F.col("__chunks") - 1),
        lambda j: F.struct(F.least(j, F.col("__chunk")).alias("cell_a"), F.greatest(j, F.col("__chunk")).alias("cell_b")),
    )
    return dealt.withColumn("__cell", F.explode(cells)).select(
        *[c for c in members.columns], "__cell.cell_a", "__cell.cell_b", F.col("__chunk").alias("chunk")
    )


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Lowers the session's rows of an Arrow batch: texts and ids of 10,000 documents at once would fill a worker and the JVM's buffers beside it.

    Operators leave the session as it is; the registered queries and the pipeline call this.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def text_slices(column: pa.Array, chars: int, rows: int = 512) -> Iterator[tuple[int, list]]:
    """(start, texts) of stretches of a text column with so many rows and characters at most; a longer text comes alone."""
    at, held, size = 0, [], 0
    for scalar in column:
        text = scalar.as_py()
        if held and (len(held) >= rows or size + len(text or "") > chars):
            yield at, held
            at, held, size = at + len(held), [], 0
        held.append(text)
        size += len(text or "")
    if held:
        yield at, held


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges(u, v)`` of longs; component is the smallest node reachable.

    Alternates large-star and small-star steps, which keep the components and turn them into
    stars in a logarithmic number of rounds. Minima are partly aggregated before the shuffle
    and hubs only meet joins that Spark can split, so no task gathers a component. Each round
    is written to shared storage.
    """
    current = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    for _ in range(limit):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        current = materialise(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(current.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
