"""Mixing sources to target weights by temperature, realised as permutations of whole blocks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE, filled, join_on, materialise, text_key, words_of

#: Exponents tried at once, and passes; each pass narrows the interval by so much.
GRID, PASSES = 64, 3


@dataclass(frozen=True)
class Target:
    """What the exponent is sought for: entropy of the weights as a share of its maximum, passes over any source.

    With ``least_entropy`` the largest exponent that reaches it is taken. With ``most_passes``
    the exponent is raised until no source is passed over more often; alone, it gives the
    smallest such exponent. ``budget`` is the tokens to draw; None draws as many as let every
    document occur at least once.
    """

    least_entropy: float | None = None
    most_passes: float | None = 1.5
    budget: int | None = None
    blocks: int = 200
    seed: int = 13


def count_words(text: Column) -> Column:
    return F.size(words_of(filled(text), f"{SPACE}+")).cast("long")


def source_tokens(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """(source, tokens, docs): one row for each source, also for the null one."""
    return docs.groupBy(F.col(source_col).alias("source")).agg(F.sum("__tokens").alias("tokens"), F.count("*").alias("docs"))


def find_exponent(sources: DataFrame, target: Target) -> float:
    """The exponent, by sections: a grid of exponents is judged in one aggregation, then the section that holds the change.

    For p the shares and a the exponent, Z = sum p**a and the weights are p**a / Z. Their
    entropy is log Z - a * sum(p**a log p) / Z, which falls as a grows. A source is passed
    over B / (tokens of all) * p**(a - 1) / Z times, or without a budget as often as its
    p**(a - 1) exceeds the least one; the most passes fall too.
    """
    positive = sources.where("tokens > 0")
    total, n = positive.agg(F.sum("tokens"), F.count("*")).first()
    if not total or n < 2:
        return 1.0
    p = F.col("tokens") / F.lit(float(total))

    def judged(low: float, high: float) -> list:
        grid = F.array(*[F.lit(low + (high - low) * k / GRID) for k in range(GRID + 1)])
        w = F.pow(p, F.col("a"))
        sums = positive.withColumn("a", F.explode(grid)).groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log(p)).alias("s"), F.max(w / p).alias("top"), F.min(w / p).alias("low"))
        passes = F.col("top") / F.col("low") if target.budget is None else F.col("top") / F.col("z") * F.lit(target.budget / total)
        entropy = (F.log("z") - F.col("a") * F.col("s") / F.col("z")) / F.log(F.lit(float(n)))
        return sums.select("a", entropy.alias("entropy"), passes.alias("passes")).orderBy("a").collect()

    def border(below) -> float:
        """The least exponent that is no longer ``below`` the border, 1 if all are."""
        low, high = 0.0, 1.0
        for _ in range(PASSES):
            at = [r.a for r in judged(low, high) if below(r)]
            if not at:
                return low
            low, high = at[-1], min(high, at[-1] + (high - low) / GRID)
        return high

    found = 0.0
    if target.least_entropy is not None:
        found = border(lambda r: r.entropy >= target.least_entropy)
    if target.most_passes is not None:
        found = max(found, border(lambda r: r.passes > target.most_passes))
    return found


def plan(docs: DataFrame, target: Target = Target(), source_col: str = "source") -> tuple[DataFrame, float]:
    """((source, block, weight, passes, block_order), exponent); passes is how often the block's documents occur.

    The tokens due to a source are whole passes over it and a rest. For the rest, blocks are
    taken in the order of a hash permutation until the next would lie more than half beyond
    what is due. So each source is met to within half a block.
    """
    sources = materialise(source_tokens(docs, source_col), "sources")
    exponent = find_exponent(sources, target)
    positive = sources.where("tokens > 0")
    total = positive.agg(F.sum("tokens")).first()[0] or 0
    p = F.col("tokens") / F.lit(float(total or 1))
    power = positive.withColumn("w", F.pow(p, F.lit(exponent)))
    z, flattest = power.agg(F.sum("w"), F.min(F.col("w") / p)).first()
    budget = float(target.budget) if target.budget is not None else (total * z / flattest if z else 0.0)
    due = power.select("source", "tokens", (F.col("w") / F.lit(z or 1.0)).alias("weight"))
    due = due.withColumn("due", F.col("weight") * budget)
    blocks = docs.groupBy(F.col(source_col).alias("source"), "__block").agg(F.sum("__tokens").alias("block_tokens"))
    blocks = join_on(blocks, due, ["source"], "left").withColumn("due", F.coalesce("due", F.lit(0.0)))
    blocks = blocks.withColumn("full", F.floor(F.col("due") / F.greatest("tokens", F.lit(1)) + 1e-9)).withColumn("full", F.coalesce("full", F.lit(1)))
    ordered = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(target.seed), "__block"), "__block")
    before = F.coalesce(F.sum("block_tokens").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.col("due") - F.col("full") * F.coalesce("tokens", F.lit(0))
    taken = before + F.col("block_tokens") / 2 <= rest
    return blocks.select(
        "source", "__block", F.coalesce("weight", F.lit(0.0)).alias("weight"), (F.col("full") + F.coalesce(taken, F.lit(False)).cast("int")).cast("int").alias("passes"), F.row_number().over(ordered).alias("block_order")
    ), exponent


def mix(docs: DataFrame, target: Target = Target(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row of ``docs`` once for each pass that takes it, with pass (from 1), block, block_order and weight.

    Tokens are words. A source is cut into ``blocks`` blocks by a hash of id and text, so a
    hot source is spread over as many tasks as there are blocks. Ordered by pass, block_order
    and a hash, the rows are the budgeted permutation. Null and blank texts have no tokens; a
    source without any tokens is passed over once. A null source is a source. With a budget
    under one pass, blocks that are not reached have no rows. Columns of these names are
    replaced.
    """
    new = ["pass", "block", "block_order", "weight"]
    key = F.xxhash64(F.lit(target.seed), F.col(id_col), text_key(F.col(text_col)))
    keyed = docs.drop(*new).withColumns({"__key": key, "__block": F.pmod(key, F.lit(target.blocks)).cast("int"), "__source": F.col(source_col)})
    narrow = materialise(keyed.select("__source", "__block", "__key", count_words(F.col(text_col)).alias("__tokens")), "token-counts")
    blocks, _ = plan(narrow, target, "__source")
    chosen = blocks.select(F.col("source").alias("__s"), F.col("__block").alias("__b"), F.col("weight").alias("__weight"), F.col("passes").alias("__passes"), F.col("block_order").alias("__order"))
    chosen = materialise(chosen, "chosen-blocks")  # of a known size: where sources are few, Spark broadcasts it and moves no text
    joined = keyed.join(chosen, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b")))
    taken = joined.where("__passes > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("__passes"))))
    return taken.select(
        *[c for c in docs.columns if c not in new], "pass", F.col("__block").alias("block"), F.col("__order").alias("block_order"), F.col("__weight").alias("weight")
    )
