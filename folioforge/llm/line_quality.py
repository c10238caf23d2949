"""Quality rules: per-document counts and cross-document line frequency, all as column functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import SPACE, filled, join_on, let, materialise, text_key, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class LineLimits:
    """A line is boilerplate on a host from more documents than ``least_docs`` and than ``doc_share`` of the host's.

    A document is depleted if it keeps under ``least_left`` of its words without such lines.
    """

    least_docs: int = 10
    doc_share: float = 0.05
    least_left: float = 0.3


def _repeated_words(words: Column) -> Column:
    """Words of ``words`` that lie in windows of WINDOW words found twice or more.

    Windows are compared by 64-bit hashes. Sorted by hash, a window is repeated if a
    neighbour is equal; sorted by start, the repeated windows' union is summed gap by gap.
    """

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda p, i: F.when(i + 1 < F.size(starts), F.least(F.lit(WINDOW), F.get(starts, i + 1) - p)).otherwise(F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def repeated(hashes: Column) -> Column:
        def starts(found: Column) -> Column:
            twice = F.filter(found, lambda x, i: (F.get(found, i - 1)["h"] == x["h"]) | (F.get(found, i + 1)["h"] == x["h"]))
            return F.array_sort(F.transform(twice, lambda x: x["p"]))

        return let(starts_of(hashes), lambda found: let(starts(found), covered))

    def starts_of(hashes: Column) -> Column:
        return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

    hashed = F.transform(
        F.when(F.size(words) >= WINDOW, F.sequence(F.lit(1), F.size(words) - (WINDOW - 1))).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.slice(words, i, WINDOW)),
    )
    return let(hashed, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(repeated(h)))


def text_counts(text: Column) -> Column:
    """STRUCT of the counts of one text; null counts as empty.

    n_words and word_chars (code points in words), n_symbols, n_dup_lines (lines with a word
    that equal an earlier line), n_repeat_words (words in windows of eight words found twice
    or more).
    """
    body = filled(text)
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\f\r", "")) > 0)
    long = lambda c: c.cast("long")
    return F.struct(
        long(F.length(F.translate(body, " \t\n\x0b\f\r", ""))).alias("word_chars"),
        long(F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: long(F.size(x) - F.size(F.array_distinct(x)))).alias("n_dup_lines"),
        let(words_of(body, f"{SPACE}+"), lambda w: F.struct(long(F.size(w)).alias("n_words"), _repeated_words(w).alias("n_repeat_words"))).alias("w"),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def normalised(line: Column) -> Column:
    """What makes two lines the same: letters and digits, lower-cased, digits alike, everything else one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"\p{N}+", "0"), r"[^\p{L}\p{M}0]+", " "))


def _hashed(line: Column) -> Column:
    """STRUCT<h, words> of a normalised line."""
    return F.struct(F.xxhash64(line).alias("h"), (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1).cast("int").alias("words"))


def line_hashes(text: Column) -> Column:
    """ARRAY<STRUCT<h, words>> of the lines with a letter or digit, equal lines of the text summed by the caller."""
    return F.transform(F.filter(F.transform(F.split(filled(text), "\n"), normalised), lambda x: x != ""), _hashed)


def _marked_lines(text: Column) -> Column:
    """ARRAY<STRUCT<raw, x>>: every line and its hash and words, null for one without a letter or digit."""
    return F.transform(F.split(text, "\n"), lambda raw: F.struct(raw.alias("raw"), let(normalised(raw), lambda x: F.when(x != "", _hashed(x))).alias("x")))


def _cut(lines: Column, bad: Column) -> Column:
    """STRUCT<total, gone, clean>: words in all lines and in those among ``bad``, and the text without these."""
    words = lambda some: F.aggregate(some, F.lit(0).cast("long"), lambda a, s: a + F.coalesce(s["x"]["words"], F.lit(0)))
    is_bad = lambda s: F.coalesce(F.array_contains(bad, s["x"]["h"]), F.lit(False))
    left = F.array_join(F.transform(F.filter(lines, lambda s: ~is_bad(s)), lambda s: s["raw"]), "\n")
    return F.struct(words(lines).alias("total"), words(F.filter(lines, is_bad)).alias("gone"), left.alias("clean"))


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, tk, host, lines): the hashes and words of each document's lines, written once as they are read twice.

    Rows equal in id, text and host are one document; they are put together before the
    shuffle already, so that a row repeated very often is no hot group.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(F.col(text_col)).alias("tk"), F.col(host_col).alias("host"), line_hashes(F.col(text_col)).alias("lines"))
    return materialise(rows.groupBy("doc_id", "tk", "host").agg(F.first("lines").alias("lines")), "line-hashes")


def frequent_lines(numbered: DataFrame, limits: LineLimits) -> DataFrame:
    """(host, h, n_docs) of the lines over the limits. Counts are partly aggregated before the shuffle.

    As a line must be in a share of a host's documents, a host has no more of them than its
    documents' mean number of lines over that share, however many documents it has.
    """
    per_host = numbered.groupBy("host").agg(F.count("*").alias("host_docs"))
    distinct = numbered.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counted = distinct.groupBy("host", "h").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > limits.least_docs)
    over = join_on(counted, per_host, ["host"]).where(F.col("n_docs") > limits.doc_share * F.col("host_docs")).drop("host_docs")
    return over


def apply_rules(docs: DataFrame, limits: LineLimits = LineLimits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` with the counts, base_failed, kept, removed_words and clean_text.

    For each host the different documents of every normalised line are counted: rows equal in
    id, text and host are one document, in the line's count and in the host's, and all get
    its result. Lines over the limits are removed from clean_text; a document left with too
    few of its words is rejected. Null or empty texts have counts of zero and fail the base
    rules; a null host is a host of its own. Other columns of ``docs`` are passed through; a
    clash with a new column's name is settled for the new column.
    """
    numbered = numbered_lines(docs, id_col, text_col, host_col)
    by_host = frequent_lines(numbered, limits).groupBy("host").agg(F.collect_set("h").alias("__bad")).withColumnRenamed("host", "__bad_host")
    by_host = materialise(by_host, "frequent-lines")  # of a known size: where hosts are few, Spark broadcasts it and moves no text
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words", "clean_text"]
    text = F.col(text_col)
    counted = docs.withColumns({"__host": F.col(host_col), "__n": text_counts(text)})
    joined = counted.join(by_host, F.col("__host").eqNullSafe(F.col("__bad_host")), "left")
    failed = base_failed(F.col("__n.w.n_words"), F.col("__n.w.n_repeat_words"))
    cut = F.when(F.col("__bad").isNotNull(), let(_marked_lines(filled(text)), lambda lines: _cut(lines, F.col("__bad"))))
    joined = joined.withColumn("__cut", cut)
    gone, total = F.coalesce("__cut.gone", F.lit(0).cast("long")), F.col("__cut.total")
    depleted = F.coalesce((gone > 0) & (total - gone < limits.least_left * total), F.lit(False))
    return joined.select(
        *[F.col(c) for c in docs.columns if c not in new],
        F.col("__n.w.n_words").alias("n_words"), F.col("__n.word_chars").alias("word_chars"), F.col("__n.n_symbols").alias("n_symbols"),
        F.col("__n.n_dup_lines").alias("n_dup_lines"), F.col("__n.w.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.alias("removed_words"), F.when(gone > 0, F.col("__cut.clean")).otherwise(text).alias("clean_text"),
    )
