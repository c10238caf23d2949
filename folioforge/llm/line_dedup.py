"""Line dedup: repeated runs of lines, found by prefix doubling, lose their later copies.

The suffix array of the corpus's line-id sequences is held as the ranks of its suffixes by
prefixes of 2**k lines (``suffix_ranks``). Two suffixes have a longest common prefix of L
lines or more if and only if, with 2**k <= L < 2**(k + 1), their level-k ranks are equal at
their start and at L - 2**k lines on: the two overlapping stretches of 2**k lines cover just
the first L lines. So (L, the two ranks) names the longest-common-prefix interval of depth L
that a suffix lies in, and the intervals need not be walked from one sorted neighbour to the
next, which would be one chain through all partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE, filled, join_on, let, materialise, text_key

DOC = ["doc_id", "tk"]


def _stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\n\x0b\f\r"))


def _n_words(line: Column) -> Column:
    """The words of a stripped line; where single blanks part them, these are counted, which is faster than a pattern."""
    odd = F.lit(False)
    for gap in ("  ", "\t", "\x0b", "\f", "\r"):
        odd = odd | F.contains(line, F.lit(gap))
    blanks = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(odd, F.size(F.split(line, f"{SPACE}+"))).otherwise(blanks + 1).cast("long")


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, pos, h1, h2, begins, ends, total): the lines with a word, numbered within their document.

    begins and ends are word offsets. h1 and h2 hash the line without outer white space.
    Rows equal in id and text are one document.
    """
    full = F.filter(F.transform(F.split(filled(F.col(text_col)), "\n"), _stripped), lambda x: x != "")
    parts = F.transform(
        full,
        lambda x, i: F.struct(i.alias("pos"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(7), x).alias("h2"), _n_words(x).alias("words")),
    )
    per_doc = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tk"), parts.alias("parts")).where(F.size("parts") > 0)
    lines = per_doc.groupBy(*DOC).agg(F.first("parts").alias("parts")).select(*DOC, F.explode("parts").alias("x")).select(*DOC, "x.*")
    whole = Window.partitionBy(*DOC)
    upto = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("ends", F.sum("words").over(upto)).withColumn("begins", F.col("ends") - F.col("words")).withColumn("total", F.sum("words").over(whole))


def _ranks(blocks: DataFrame, key: list[str], name: str) -> DataFrame:
    """``blocks`` found twice or more, with ``rank``: equal for equal keys and in the order of the keys.

    Equal keys are counted before they are sorted, so no sorted partition holds a hot key;
    row numbers that grow along the sorted partitions are the ranks.
    """
    twice = blocks.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    ranks = materialise(twice.orderBy(*key).withColumn("rank", F.monotonically_increasing_id()), name)
    return materialise(blocks.join(ranks, key).select(*DOC, "pos", "rank"), name)


def suffix_ranks(lines: DataFrame, depth: int) -> list[DataFrame]:
    """Level k: (doc_id, tk, pos, rank) of every suffix whose first 2**k lines occur twice or more.

    Prefix doubling: level 0 ranks the lines, and a suffix's rank at level k + 1 is that of
    the pair (its rank, the rank of the suffix 2**k lines on). A suffix leaves once its
    prefix is unique or its document ends. The ranks of a level order the suffixes, so equal
    ones are an interval of the suffix array. Levels go as far as prefixes of ``depth`` lines.
    """
    levels = [_ranks(lines.select(*DOC, "pos", "h1", "h2"), ["h1", "h2"], "line-ids")]
    while 2 << (len(levels) - 1) <= depth:
        step = 1 << (len(levels) - 1)
        last = levels[-1]
        on = last.select(*DOC, (F.col("pos") - step).alias("pos"), F.col("rank").alias("r2"))
        pairs = join_on(last.withColumnRenamed("rank", "r1"), on, [*DOC, "pos"])
        levels.append(_ranks(pairs, ["r1", "r2"], "suffix-ranks"))
    return levels


def least_windows(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, tk, start, size): for each line the shortest run of ``min_words`` words from it and up to it.

    A run of lines with as many words is the union of such windows, and equal runs have
    equal windows. So what holds for windows holds for maximal runs.
    """
    doc = Window.partitionBy(*DOC)
    ahead = doc.orderBy("begins").rangeBetween(0, min_words - 1)
    behind = doc.orderBy("ends").rangeBetween(1 - min_words, -1)
    sized = lines.withColumn("fore", F.count("*").over(ahead).cast("int")).withColumn("back", (F.count("*").over(behind) + 1).cast("int"))
    fore = F.when(F.col("total") - F.col("begins") >= min_words, F.struct(F.col("pos").alias("start"), F.col("fore").alias("size")))
    back = F.when(F.col("ends") >= min_words, F.struct((F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("size")))
    return sized.select(*DOC, F.explode(F.array_distinct(F.array_compact(F.array(fore, back)))).alias("w")).select(*DOC, "w.*")


def repeated_runs(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tk, runs): the line runs of each document that are later copies, as ARRAY<STRUCT<first, last>>.

    A run is a maximal stretch of lines (blank ones left out of the count) of ``min_words``
    words or more in all, each part of which stands earlier in the corpus, by doc_id and
    line. The windows of one longest-common-prefix interval (see the module) are equal; the
    earliest of them stays and the others are runs.
    """
    lines = materialise(numbered_lines(docs, id_col, text_col), "lines")
    levels = suffix_ranks(lines, min_words)
    level = F.floor(F.log2("size") + 1e-9).cast("int")
    windows = least_windows(lines, min_words).withColumn("level", level)
    windows = windows.withColumn("second", (F.col("start") + F.col("size") - F.pow(F.lit(2), F.col("level")).cast("int")).cast("int"))
    ranks = reduce(DataFrame.union, [x.withColumn("level", F.lit(k)) for k, x in enumerate(levels)])
    head = ranks.select(*DOC, "level", F.col("pos").alias("start"), F.col("rank").alias("a"))
    tail = ranks.select(*DOC, "level", F.col("pos").alias("second"), F.col("rank").alias("b"))
    named = join_on(join_on(windows, head, [*DOC, "level", "start"]), tail, [*DOC, "level", "second"])
    named = materialise(named.select(*DOC, "start", "size", "a", "b"), "windows")
    interval = ["size", "a", "b"]
    place = F.struct(F.col("doc_id").alias("d"), F.col("tk").alias("t"), F.col("start").alias("s"))
    first = named.groupBy(*interval).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialise(first, "first-windows")  # joined from a table, a hot interval's windows can be split among tasks
    later = named.join(first, interval).where(place != F.col("first"))
    covered = later.groupBy(*DOC, "start").agg(F.max(F.col("start") + F.col("size") - 1).alias("end"))
    by_start = Window.partitionBy(*DOC).orderBy("start")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    opens = covered.withColumn("opens", F.coalesce(F.col("start") > reached + 1, F.lit(True)).cast("int"))
    numbered = opens.withColumn("run", F.sum("opens").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*DOC, "run").agg(F.min("start").alias("first"), F.max("end").alias("last"))
    return runs.groupBy(*DOC).agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text, plus n_lines and n_removed.

    n_lines counts the lines with a word, n_removed those deleted. A text that loses no line
    is unchanged, also null and empty ones. Rows equal in id and text lose the same lines.
    A clash with a new column's name is settled for the new column.
    """
    found = repeated_runs(docs.select(id_col, text_col), min_words, id_col, text_col)
    # As the runs grow with the corpus, they are merged with the texts at every size.
    found = materialise(found, "runs").hint("merge").select(F.col("doc_id").alias("__rd"), F.col("tk").alias("__rt"), F.col("runs").alias("__runs"))
    new = ["n_lines", "n_removed"]
    keyed = docs.drop(*new).withColumn("__tk", text_key(F.col(text_col)))
    joined = keyed.join(found, keyed[id_col].eqNullSafe(F.col("__rd")) & (F.col("__tk") == F.col("__rt")), "left")
    lines = F.split(filled(F.col(text_col)), "\n")
    full = lambda x: _stripped(x) != ""

    def kept(lines: Column) -> Column:
        where = F.filter(F.transform(lines, lambda x, i: F.when(full(x), i)), lambda i: i.isNotNull())
        return let(
            where,
            lambda at: let(
                F.transform(F.col("__runs"), lambda r: F.struct(F.get(at, r["first"]).alias("first"), F.get(at, r["last"]).alias("last"))),
                lambda runs: F.array_join(F.filter(lines, lambda x, i: ~F.exists(runs, lambda r: i.between(r["first"], r["last"]))), "\n"),
            ),
        )

    text = F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(let(lines, kept))
    n_removed = F.aggregate(F.col("__runs"), F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"] + 1)
    return joined.select(
        *[text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in new],
        F.size(F.filter(lines, full)).cast("long").alias("n_lines"),
        F.coalesce(n_removed, F.lit(0).cast("long")).alias("n_removed"),
    )
