"""Checks of numeric tokens in table-like lines, and the quality of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.carry import carried
from folioforge.functions.text import joined_lines, strip, tokens

#: Patterns of suspicious tokens.
NUMBER = r"\b\d+(?:[.,]\d+)*\b"
LETTERS_THEN_DIGITS = r"\b[A-Za-z]+[-_]?\d+(?:\.\d+)?\b"
DIGITS_THEN_LETTERS = r"\b\d+(?:\.\d+)?[A-Za-z]+\b"
SUBSTITUTED = r"\b(?:[A-Za-z][0-9]+|[0-9]+[A-Za-z])\b"
FISCAL_YEARS = ("FY24", "FY25", "FY26")


def looks_like_row(line: Column) -> Column:
    """The validator's rule: three numbers or more."""
    return F.regexp_count(line, F.lit(NUMBER)) >= 3


def _said(kind: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.concat(F.lit(f"{kind}: '"), v, F.lit("'")))


def _all(line: Column, pattern: str) -> Column:
    return F.regexp_extract_all(line, F.lit(pattern), F.lit(0))


def attached(line: Column) -> Column:
    found = F.concat(_all(line, LETTERS_THEN_DIGITS), _all(line, DIGITS_THEN_LETTERS))
    return _said("Attached letters/numbers", F.filter(found, lambda v: ~F.upper(v).isin(*FISCAL_YEARS) & ~F.upper(v).rlike(r"^(TABLE|PAGE)\d*$")))


def _bare(token: Column) -> Column:
    return F.btrim(token, F.lit(",;:()[]{}"))


def malformed(line: Column) -> Column:
    def check(t: Column) -> Column:
        bare = _bare(t)
        dots = F.when((F.length(bare) - F.length(F.replace(bare, F.lit("."), F.lit(""))) > 1) & bare.rlike(r"\d"), F.concat(F.lit("Multiple decimal points: '"), t, F.lit("'")))
        commas = F.when((F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit(""))) > 1) & bare.rlike(r"^[\d,]+$"), F.concat(F.lit("Suspicious numeric commas: '"), t, F.lit("'")))
        return F.array_compact(F.array(dots, commas))

    return F.flatten(F.transform(tokens(line), check))


def merged(line: Column) -> Column:
    return _said("Possible merged number", F.filter(tokens(line), lambda t: _bare(t).rlike(r"^\d{5,}\.\d+$")))


def substituted(line: Column) -> Column:
    return _said("Possible OCR character substitution", F.filter(_all(line, SUBSTITUTED), lambda v: ~F.upper(v).isin(*FISCAL_YEARS, "MT")))


def line_issues(line: Column) -> Column:
    """The issues of one line, each once, in order of first mention."""
    return F.array_distinct(F.concat(attached(line), malformed(line), merged(line), substituted(line)))


def check_lines(lines: DataFrame, span: int | None = None) -> DataFrame:
    """(doc_id, line_no, page, table, original, is_row, issues) of every line.

    page and table are those last named up to the line, "Unknown" before any; neither resets
    the other. Only table-like lines have issues. ``span``: see ``carried``.
    """
    s = F.col("original")
    marked = lines.withColumn("original", strip(F.col("raw")))
    page = F.when(s.rlike(r"(?i)PAGE\s+\d+"), F.regexp_extract(s, r"(?i)PAGE\s+(\d+)", 1))
    table = F.when(s.rlike(r"(?i)\bTABLE\s+\d"), s)
    named = carried(marked.select("doc_id", "line_no", "original"), {"page": page, "table": table}, span)
    known = lambda c: F.coalesce(c, F.lit("Unknown")).alias(c)
    judged = named.select("doc_id", "line_no", known("page"), known("table"), "original", looks_like_row(s).alias("is_row"))
    return judged.withColumn("issues", F.when(F.col("is_row"), line_issues(s)).otherwise(F.array().cast("array<string>")))


def issues(lines: DataFrame) -> DataFrame:
    """One row for each issue, numbered from 1 within its line."""
    return check_lines(lines).select("doc_id", "line_no", "page", "table", "original", F.posexplode("issues").alias("ord", "issue")).withColumn("ord", F.col("ord") + 1)


def metrics(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """Per document of ``docs``: table_rows, rows_with_issues, rows_without_issues, total_issues, validation_quality.

    Quality is the share of table-like lines without issues in percent, 100 without such lines.
    Issues of a line do not depend on other lines, so this needs one aggregation and no window.
    """
    s = strip(F.col("raw"))
    counted = lines.select("doc_id", looks_like_row(s).alias("is_row"), F.when(looks_like_row(s), F.size(line_issues(s))).otherwise(0).alias("n"))
    per_doc = counted.groupBy("doc_id").agg(F.count_if("is_row").alias("rows"), F.count_if(F.col("n") > 0).alias("bad"), F.sum("n").alias("n"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows, bad = zero(F.col("rows")), zero(F.col("bad"))
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select(
        "doc_id", rows.alias("table_rows"), bad.alias("rows_with_issues"), (rows - bad).alias("rows_without_issues"), zero(F.col("n")).alias("total_issues"),
        F.when(rows > 0, (rows - bad) / F.when(rows > 0, rows) * 100).otherwise(100.0).alias("validation_quality"),
    )


def render_issues(found: DataFrame) -> DataFrame:
    """(doc_id, text): the review of each document as text, a block for each line with issues."""
    block = F.concat_ws(
        "\n", F.concat(F.lit("Line "), F.col("line_no"), F.lit(" | Page "), F.col("page")), F.concat(F.lit("Table: "), F.col("table")), F.concat(F.lit("Original: "), F.col("original")),
        F.lit("Issues:"), F.array_join(F.transform("issues", lambda i: F.concat(F.lit("  - "), i)), "\n"), F.lit("-" * 70),
    )
    return found.where(F.size("issues") > 0).groupBy("doc_id").agg(joined_lines(F.col("line_no"), block).alias("text"))


def render_report(figures: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, text): the validation report of each document of ``figures`` (as ``metrics`` gives them), its figures above its review.

    The labels are those that ``parse_validation_report`` of the sources reads.
    """
    entry = lambda label, c: F.concat(F.lit(f"{label} : "), c)
    text = lambda c: F.col(c).cast("string")
    head = F.concat_ws(
        "\n", F.lit("=" * 60), F.lit("OCR VALIDATION REPORT"), F.lit("=" * 60), F.lit(""),
        entry("Table-like rows inspected", text("table_rows")), entry("Rows requiring review", text("rows_with_issues")), entry("Rows without detected issues", text("rows_without_issues")),
        entry("Possible OCR issues", text("total_issues")), entry("Validation Quality", F.format_string("%.2f%%", F.col("validation_quality"))), F.lit(""),
        F.lit("Numbers are reported as they stand; none was changed."), F.lit(""),
    )
    blocks = render_issues(found).withColumnRenamed("text", "blocks")
    joined = figures.join(blocks, "doc_id", "left")
    return joined.select("doc_id", F.concat_ws("\n", head, F.coalesce("blocks", F.lit("No issues were found."))).alias("text"))
