"""Extractive summaries, key sentences and the text report of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import lexicon
from folioforge.functions.text import has_any, let, squeeze, strip

SUMMARY_SENTENCES, SUMMARY_LENGTH, KEY_SENTENCES, KEY_LENGTH, EXCERPT = 5, 40, 10, 30, 1000
RULE, LINE = "=" * 70, "-" * 70
LANGUAGES = ("english", "hindi")


def sentences(text: Column) -> Column:
    """The sentences of a text in order, white space squeezed; each as often as it occurs."""
    return F.split(squeeze(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+")


def summary_sentences(text: Column) -> Column:
    """The first different sentences of 40 characters or more that are no page marks."""
    good = F.filter(sentences(text), lambda s: (F.length(s) >= SUMMARY_LENGTH) & ~s.rlike(r"(?i)^PAGE\s+\d+"))
    return F.slice(F.array_distinct(good), 1, SUMMARY_SENTENCES)


def key_sentences(text: Column) -> Column:
    """The first different sentences of 30 characters or more with a word of the key list."""
    good = F.filter(sentences(text), lambda s: (F.length(s) >= KEY_LENGTH) & has_any(F.lower(s), lexicon.KEY_INFORMATION_WORDS))
    return F.slice(F.array_distinct(good), 1, KEY_SENTENCES)


def summary(text: Column) -> Column:
    flat = squeeze(F.coalesce(text, F.lit("")))
    excerpt = F.when(F.length(flat) > EXCERPT, F.concat(F.substring(flat, 1, EXCERPT), F.lit("..."))).otherwise(flat)
    return F.when(flat == "", "No page text was available for document summarization.").otherwise(
        let(summary_sentences(text), lambda s: F.when(F.size(s) > 0, F.array_join(s, " ")).otherwise(excerpt))
    )


def document_text(structured: DataFrame) -> DataFrame:
    """(doc_id, text): page texts with content, in order."""
    parts = structured.withColumn("t", strip(F.col("text"))).where(F.col("t") != "")
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_ord", "t"))), lambda s: s["t"]), "\n").alias("text"))


def titles(structured: DataFrame) -> DataFrame:
    """(doc_id, title, place): the different table titles, by first place (page and table)."""
    out = structured.select("doc_id", "page_ord", F.posexplode("tables").alias("pos", "t")).select("doc_id", "page_ord", "pos", strip(F.col("t.title")).alias("title"))
    return out.where(F.col("title") != "").groupBy("doc_id", "title").agg(F.min(F.struct("page_ord", "pos")).alias("place"))


def report_lines(info: DataFrame, texts: DataFrame, title_list: DataFrame, metrics: DataFrame | None, names: DataFrame, stamp: str | None = None, language: str = "english") -> DataFrame:
    """(doc_id, lines): the report of each document as lines.

    The content is English in every language. ``stamp`` is the time shown; None takes the
    clock. ``metrics`` are the validation metrics; a document without them says so.
    """
    if language not in LANGUAGES:
        language = "english"
    shown = F.lit(stamp) if stamp is not None else F.date_format(F.current_timestamp(), "dd-MM-yyyy HH:mm:ss")
    found = title_list.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "title"))), lambda s: s["title"]).alias("titles"))
    all_ = names.join(info, "doc_id").join(texts, "doc_id", "left").join(found, "doc_id", "left")
    checked = ("table_rows", "rows_with_issues", "rows_without_issues", "total_issues", "validation_quality")
    if metrics is not None:
        all_ = all_.join(metrics.select("doc_id", *checked), "doc_id", "left")
    else:
        all_ = all_.withColumns({c: F.lit(None).cast("double") for c in checked})
    entry = lambda label, c: F.concat(F.lit(f"{label:<28}: "), c.cast("string"))
    head = lambda t: F.array(F.lit(""), F.lit(LINE), F.lit(t), F.lit(LINE))
    numbered = lambda a: F.transform(a, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    ocr = F.when(
        F.col("table_rows").isNotNull(),
        F.array(
            entry("Table-like rows inspected", F.col("table_rows")), entry("Rows requiring review", F.col("rows_with_issues")),
            entry("Rows without detected issues", F.col("rows_without_issues")), entry("Possible OCR issues", F.col("total_issues")),
            entry("Validation Quality", F.concat(F.format_string("%.2f", F.col("validation_quality").cast("double")), F.lit("%"))),
        ),
    ).otherwise(F.array(F.lit("Matching OCR validation report was not found."), F.lit("OCR validation metrics are not available for this document.")))
    listed = F.when(F.size(F.coalesce("titles", F.array().cast("array<string>"))) > 0, numbered(F.col("titles"))).otherwise(F.array(F.lit("No tables or sections were identified.")))
    has_text = F.coalesce(strip(F.col("text")), F.lit("")) != ""
    key = let(key_sentences(F.col("text")), lambda k: F.when(F.size(k) > 0, numbered(k)).otherwise(F.array(F.lit("No specific key information was automatically identified."))))
    key = F.when(has_text, key).otherwise(F.array(F.lit("No extracted text is available.")))
    lines = F.concat(
        F.array(F.lit(RULE), F.lit("AUTOMATED REPORT"), F.lit(RULE)),
        head("DOCUMENT DETAILS"), F.array(F.concat(F.lit("Document: "), F.col("name")), F.concat(F.lit("Generated on: "), shown), F.concat(F.lit("Pages: "), F.col("pages").cast("string"))),
        head("DOCUMENT SUMMARY"), F.array(summary(F.col("text"))),
        head("DOCUMENT PERFORMANCE METRICS"),
        F.array(entry("Total pages processed", F.col("pages")), entry("Pages containing text", F.col("pages_with_text")), entry("Tables detected", F.col("tables")), entry("Rows extracted", F.col("rows"))),
        head("OCR PERFORMANCE METRICS"), ocr, head("IDENTIFIED TABLES / SECTIONS"), listed, head("KEY EXTRACTED INFORMATION"), key,
        F.array(F.lit(""), F.lit(RULE), F.lit("END OF REPORT"), F.lit(RULE)),
    )
    return all_.select("doc_id", lines.alias("lines"))
