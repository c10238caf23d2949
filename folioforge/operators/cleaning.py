"""Cleaning of OCR lines: classification, table mode, rewrites, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import lexicon
from folioforge.functions.carry import carried
from folioforge.functions.text import has_any, let, rewrite_matches, squeeze, strip

#: Patterns in the order in which they rewrite a table line, after the numeric tokens.
NUMERIC_TOKEN = r"\b[\dOo.,-]+\b"
O_FIXES = (r"(?<=\d)[oO](?=\d)", r"(?<=\.)[oO](?=\d)", r"(?<=\d)[oO](?=\.)")
TABLE_REWRITES = (
    (r"(?U)(?<=\s)[AVW]\s+(?=\d)", ""),
    (r"(?U)(?<=\s)V[vV]\s+(?=\d)", ""),
    (r"(?U)(?<![A-Za-z])[_^~]+\s*(?=\d)", ""),
    (r"(?<=\d)[\[\]}]+", ""),
    (r"[\[\{]+(?=\d)", ""),
    (r"(?<=\d)_(?=\d)", " "),
    (r"(?U)(?<=\d)\s+[&^~]+\s+(?=\d)", " "),
    (r"[ \t]+", " "),
)
MERGED_NUMBER = r"\b\d{2,4}\.\d{2,}\b"


def is_page_marker(line: Column) -> Column:
    return line.rlike(r"(?iU)^\s*PAGE\s+\d+\s*$")


def is_table_heading(line: Column) -> Column:
    return line.rlike(r"(?i)\bTable\s+\d+(?:\.\d+)*")


def is_source_or_note(line: Column) -> Column:
    return line.rlike(r"(?i)^\s*(?:Source|Note)\s*:")


#: Fixed value: how lines begin that are never left-overs of charts.
PROTECTED = "^(?:Government|Ministry|CIL|SCCL|NLCIL)"


def is_chart_noise(line: Column) -> Column:
    """Whether a trimmed line is a left-over of a chart."""
    letters = F.length(F.regexp_replace(line, "[^A-Za-z0-9]", ""))
    protected = is_page_marker(line) | is_table_heading(line) | is_source_or_note(line) | line.rlike(PROTECTED)
    short = (F.length(line) <= 3) & ~line.rlike(r"(?U)\d") & ~F.upper(line).isin(*lexicon.COMPANY_CODES)
    fragment = line.rlike(r"(?i)^(?:" + "|".join(lexicon.CHART_FRAGMENTS) + r")$")
    return (
        F.when((line == "") | protected, False)
        .when(line.rlike(r"(?U)^[\W_]+$") | short, True)
        .when((F.length(line) > 5) & (letters / F.length(line) < 0.20), True)
        .otherwise(fragment)
    )


def looks_like_row(line: Column) -> Column:
    """The cleaner's rule for rows outside tables."""
    return (line != "") & ((F.regexp_count(line, F.lit(r"\b\d+(?:[.,]\d+)?\b")) >= 2) | has_any(F.lower(line), lexicon.ROW_WORDS))


def fix_number(token: Column) -> Column:
    for pattern in O_FIXES:
        token = F.regexp_replace(token, pattern, "0")
    return token


def clean_table_line(line: Column) -> Column:
    out = F.regexp_replace(F.replace(line, F.lit("|"), F.lit(" ")), "[¥£€©®™]", "")
    # Each of O_FIXES needs an o between two digits or dots; a line without one has nothing to fix.
    out = let(out, lambda x: F.when(x.rlike(r"[\d.][oO][\d.]"), rewrite_matches(x, NUMERIC_TOKEN, fix_number)).otherwise(x))
    for pattern, by in TABLE_REWRITES:
        out = F.regexp_replace(out, pattern, by)
    return strip(out)


def clean_normal_line(line: Column) -> Column:
    return strip(F.replace(F.regexp_replace(strip(line), r"[ \t]{2,}", " "), F.lit("Inpt"), F.lit("Input")))


def classify(lines: DataFrame, span: int | None = None) -> DataFrame:
    """Adds stripped, cls (blank, page, heading, source, noise, table, text) and in_table.

    Table mode starts after a heading and ends at a page marker or the third blank line in a
    row; it is the last such event before a line. Line numbers follow each other. One shuffle
    by document serves all windows; with ``span`` (see ``carried``) none holds a document.
    """
    stripped = strip(F.col("raw"))
    marked = lines.withColumn("stripped", stripped).withColumn("blank", F.col("stripped") == "")
    marked = carried(marked, {"solid": F.when(~F.col("blank"), F.col("line_no"))}, span)
    marked = marked.withColumn("gap", F.col("line_no") - F.coalesce("solid", F.lit(0)))
    event = F.when(F.col("blank") & (F.col("gap") == 3), False).when(~F.col("blank") & is_page_marker(F.col("stripped")), False).when(~F.col("blank") & is_table_heading(F.col("stripped")), True)
    moded = carried(marked.withColumn("event", event), {"in_table": F.col("event")}, span, inclusive=False).withColumn("in_table", F.coalesce("in_table", F.lit(False)))
    s = F.col("stripped")
    cls = (
        F.when(F.col("blank"), "blank")
        .when(is_page_marker(s), "page")
        .when(is_table_heading(s), "heading")
        .when(is_source_or_note(s), "source")
        .when(~F.col("in_table") & is_chart_noise(s), "noise")
        .when(F.col("in_table") | looks_like_row(s), "table")
        .otherwise("text")
    )
    return moded.select("doc_id", "line_no", "raw", "stripped", cls.alias("cls"), "in_table")


def _single_blanks(kept: DataFrame, span: int | None) -> DataFrame:
    """Without blank lines at a document's ends and all but the last of a run; line_no anew from 1."""
    cls = F.col("cls")
    if span is None:
        doc = Window.partitionBy("doc_id").orderBy("line_no")
        follows = F.coalesce(F.lead(cls).over(doc) != "blank", F.lit(False))
        opened = F.max((cls != "blank").cast("int")).over(doc) == 1
        left = kept.withColumn("keep", (cls != "blank") | (follows & opened)).where("keep")
        return left.withColumn("line_no", F.row_number().over(doc).cast("int"))
    backwards = lambda df: df.withColumn("line_no", -F.col("line_no"))
    ahead = backwards(carried(backwards(kept), {"next": cls}, span, inclusive=False))
    both = carried(ahead, {"opened": F.when(cls != "blank", True)}, span)
    left = both.where((cls != "blank") | (F.col("opened") & (F.col("next") != "blank")))
    return carried(left, {}, span, counts={"place": F.col("line_no")}).withColumn("line_no", F.col("place").cast("int"))


def clean(lines: DataFrame, span: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(cleaned lines, audit) of ``lines(doc_id, line_no, raw)``; ``span`` as in ``classify``.

    Cleaned lines are numbered anew from 1; at most one blank line stands between two others.
    The audit has (doc_id, line_no, kind, message): removed, numeric, merged, cleaned.
    """
    done = classify(lines, span)
    s, cls = F.col("stripped"), F.col("cls")
    text = F.when(cls == "page", squeeze(s)).when(cls == "heading", s).when(cls == "table", clean_table_line(s)).when(cls.isin("source", "text"), clean_normal_line(s)).when(cls == "blank", "")
    out = done.withColumn("text", text)
    # A filter would be moved below the rewriting and make it twice; as members of an array, texts are made once.
    one = F.filter(F.array(text), lambda x: (cls != "noise") & ((cls == "blank") | (x != "")))
    kept = done.withColumn("text", F.explode(one))
    cleaned = _single_blanks(kept, span).select("doc_id", "line_no", "cls", "in_table", "text")
    return cleaned, audit(out)


def audit(cleaned: DataFrame) -> DataFrame:
    """What cleaning removed or changed, from lines with stripped, cls and text."""
    s, cls, text = F.col("stripped"), F.col("cls"), F.col("text")
    message = lambda kind, m: F.struct(F.lit(kind).alias("kind"), m.alias("message"))
    before = F.regexp_replace(F.replace(s, F.lit("|"), F.lit(" ")), "[¥£€©®™]", "")
    pairs = F.transform(F.regexp_extract_all(before, F.lit(NUMERIC_TOKEN), F.lit(0)), lambda t: F.struct(t.alias("a"), fix_number(t).alias("b")))
    numeric = F.transform(F.filter(pairs, lambda p: p["a"] != p["b"]), lambda p: message("numeric", F.concat(F.lit("OCR numeric correction: "), p["a"], F.lit(" -> "), p["b"])))
    values = F.filter(F.regexp_extract_all(text, F.lit(MERGED_NUMBER), F.lit(0)), lambda v: F.length(F.substring_index(v, ".", 1)) >= 3)
    merged = F.transform(values, lambda v: message("merged", F.concat(F.lit("REVIEW merged/suspicious number: "), v, F.lit(" | "), text)))
    changed = F.when(s != text, F.array(message("cleaned", F.concat(F.lit("Cleaned: "), s, F.lit(" -> "), text))))
    none = F.array().cast("array<struct<kind:string,message:string>>")
    entries = F.when(cls == "noise", F.array(message("removed", s))).when(cls == "table", F.concat(numeric, merged, F.coalesce(changed, none))).otherwise(none)
    return cleaned.select("doc_id", "line_no", F.explode(entries).alias("e")).select("doc_id", "line_no", "e.*")
