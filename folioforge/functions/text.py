"""Column functions for lines and tokens with the Unicode white space rules of the data."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_END = r"\R|[\x1c-\x1e]"
#: The characters with the Unicode property White_Space, and the four separators below the blank.
BLANK_POINTS = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
BLANKS = "".join(map(chr, BLANK_POINTS))
#: Runs of the same characters, as the pattern that takes the least time.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(BLANKS))


def squeeze(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def tokens(c: Column) -> Column:
    """Pieces between white space; none for a blank text."""
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def count_tokens(c: Column) -> Column:
    """How many pieces stand between white space."""
    return let(squeeze(c), lambda t: F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def split_lines(text: Column) -> Column:
    """The lines of a text; a line end at the very end opens no further line."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_END)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def to_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, raw) with line numbers from 1. Null and empty texts have no lines."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "raw")).select("doc_id", (F.col("pos") + 1).alias("line_no"), "raw")


def has_any(c: Column, phrases: Iterable[str]) -> Column:
    """Whether any phrase is a substring."""
    return let(c, lambda v: F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(v, p)))


def count_of(c: Column, phrases: Iterable[str]) -> Column:
    """How many of the phrases are substrings."""
    return let(c, lambda v: F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(v, p))))


def joined_lines(order: Column, line: Column, separator: str = "\n") -> Column:
    """Aggregate: the lines in order, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda s: s["l"]), separator)


def rewrite_matches(c: Column, pattern: str, fix: Callable[[Column], Column]) -> Column:
    """Each match of ``pattern`` replaced by ``fix(match)``."""
    found = F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), fix)
    pieces = let(found, lambda m: F.transform(F.split(c, pattern), lambda gap, i: F.concat(gap, F.coalesce(F.get(m, i), F.lit("")))))
    return F.array_join(pieces, "")
