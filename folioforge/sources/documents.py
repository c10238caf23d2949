"""Scans and sinks: binary files, text, structured JSON, stage tables, reports."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import lexicon
from folioforge.functions.text import strip
from folioforge.sources.reports import read_reports, write_reports  # noqa: F401  the report sinks belong to these

#: What turns the bytes of a file into its pages: (page number, text), from 1. In place of a
#: text there may be a function that recognises it, so that one page's fault is that page's.
PageTextExtractor = Callable[[bytes], Iterable[tuple[int, str | Callable[[], str]]]]

NO_FILE, UNSUPPORTED = "No file selected", "Unsupported file type"
STRUCTURED_SCHEMA = (
    "doc_id string, document struct<file:string,pages_processed:int,tables_detected:int,rows_extracted:int>, "
    "pages array<struct<page:int,text:string,tables:array<struct<title:string,header:array<string>,rows:array<string>,source:string>>>>"
)
#: Label of each figure in a written validation report.
REPORT_FIGURES = {
    "table_rows": r"Table-like rows inspected\s*:\s*(\d+)",
    "rows_with_issues": r"Rows requiring review\s*:\s*(\d+)",
    "rows_without_issues": r"Rows without detected issues\s*:\s*(\d+)",
    "total_issues": r"Possible OCR issues\s*:\s*(\d+)",
    "validation_quality": r"Validation Quality\s*:\s*([\d.]+)",
}


def file_extension(name: Column) -> Column:
    """The part after the last dot in lower case; null without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))


def is_allowed(name: Column) -> Column:
    return F.coalesce(file_extension(name).isin(*lexicon.UPLOAD_TYPES), F.lit(False))


def upload_message(name: Column) -> Column:
    """Null for an acceptable name, else why it is not."""
    return F.when(F.coalesce(F.trim(name), F.lit("")) == "", NO_FILE).when(~is_allowed(name), UNSUPPORTED)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def stage_names(name: Column) -> Column:
    """STRUCT of the names that a source's stages bear."""
    cleaned = F.concat(F.lit("cleaned_"), stem(name))
    validated = F.concat(F.lit("validated_"), cleaned)
    txt = lambda c: F.concat(c, F.lit(".txt"))
    return F.struct(
        txt(stem(name)).alias("text"), txt(cleaned).alias("cleaned"), txt(validated).alias("validated"), txt(F.concat(F.lit("ocr_validation_report_"), cleaned)).alias("review"),
        F.concat(F.lit("structured_"), cleaned, F.lit(".json")).alias("structured"), txt(F.concat(F.lit("structured_"), cleaned, F.lit("_automated_report"))).alias("report"),
    )


def scan_files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder and those below."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)


def scan_text(spark: SparkSession, folder: str, pattern: str = "*.txt", skip: tuple[str, ...] = ("cleaned_", "cleaning_review", "validated_", "ocr_validation")) -> DataFrame:
    """(doc_id, text): whole text files by name, without those whose name starts as later stages' do."""
    found = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    name = F.url_decode(file_name(F.col("path")))
    taken = found.withColumn("doc_id", name)
    return taken.where(~F.col("doc_id").rlike("^(?:" + "|".join(map(re.escape, skip)) + ")") if skip else F.lit(True)).select("doc_id", "text")


def _read_file(extractor: PageTextExtractor, content: bytes) -> Iterator[tuple[int, str, str | None]]:
    """The pages of one file; faults of a reader are facts about the page or file."""
    try:
        for n, found in extractor(content):
            try:
                yield n, ((found() if callable(found) else found) or "").strip(), None
            except Exception as e:
                yield n, f"[OCR ERROR: {e}]", str(e)
    except Exception as e:
        yield 0, f"[OCR ERROR: {e}]", str(e)


def extract_pages(files: DataFrame, extractor: PageTextExtractor) -> DataFrame:
    """(path, page_number, text, error, seconds): the pages of each file, texts trimmed, and how long each took.

    A page that cannot be recognised has its error as text, and the file's other pages are
    read. Where the file itself cannot be read on, a row with page 0 has the error. No fault
    of a reader fails a task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, began = [], time.perf_counter()
                for page in _read_file(extractor, bytes(content)):
                    now = time.perf_counter()
                    rows.append((path, *page, now - began))
                    began = now
                yield pd.DataFrame(rows, columns=["path", "page_number", "text", "error", "seconds"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string, error string, seconds double")


#: What stands before and after a page's number where pages are one text.
FRAME_RULE = "=" * 60
FRAME = f"\n{FRAME_RULE}\nPAGE "
FRAME_END = f"\n{FRAME_RULE}\n\n"


def frame_pages(pages: DataFrame, key: str = "path") -> DataFrame:
    """(key, text): the pages of each file as one text, each under a page marker."""
    framed = F.concat(F.lit(FRAME), F.col("page_number").cast("string"), F.lit(FRAME_END), F.col("text"))
    return pages.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", framed.alias("f")))), lambda s: s["f"]), "\n").alias("text"))


def write_framed(pages: DataFrame, folder: str) -> None:
    """Framed text of ``pages(doc_id, page_number, text)``, a folder for each document; other documents' stay, a given one's is replaced."""
    framed = frame_pages(pages, "doc_id").select("doc_id", F.col("text").alias("value"))
    framed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").partitionBy("doc_id").text(folder)


def read_framed(spark: SparkSession, folder: str, stage: str = "") -> DataFrame:
    """(doc_id, page_number, text): the pages of framed text files, read page by page.

    The reader cuts files at the frames, so a long file is read by many tasks and none holds
    it whole. doc_id is the folder that ``write_framed`` made, else the file's name; a filter
    on ``file`` (its name) reads no other file. ``stage`` takes only files whose names begin
    so, as ``cleaned_`` or ``validated_``. White space at a page's end is not kept; what
    stands before the first frame is page null, where it is not blank.
    """
    raw = spark.read.option("lineSep", FRAME).option("recursiveFileLookup", "true").text(folder).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("path"), "value")
    raw = raw.where(F.startswith(F.col("file"), F.lit(stage)) & ~F.startswith(F.col("file"), F.lit("_")))
    own = F.nullif(F.regexp_extract(F.url_decode("path"), r"/doc_id=([^/]+)/[^/]*$", 1), F.lit(""))
    framed = F.col("value").rlike(rf"\A[0-9]+\n{FRAME_RULE}\n")
    number = F.when(framed, F.substring_index("value", "\n", 1).cast("int"))
    text = F.when(framed, F.substring(F.col("value"), F.length(F.substring_index("value", "\n", 1)) + len(FRAME_END) + 1, F.length("value"))).otherwise(F.col("value"))
    found = raw.select(F.coalesce(own, F.url_decode("file")).alias("doc_id"), "file", number.alias("page_number"), F.regexp_replace(text, r"\s+\z", "").alias("text"))
    return found.where(F.col("page_number").isNotNull() | (F.col("text") != ""))


def read_structured(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """(doc_id, document, pages) of structured JSON, a document in each file or, as ``write_structured`` writes, in each line.

    doc_id is the one that was written, as text, else the file's name. Unreadable ones have
    nulls and keep their text in _corrupt_record.
    """
    raw = spark.read.schema(f"{STRUCTURED_SCHEMA}, _corrupt_record string").option("multiLine", whole_files).json(path)
    name = F.url_decode(file_name(F.input_file_name()))
    return raw.select(F.coalesce("doc_id", name).alias("doc_id"), "document", "pages", "_corrupt_record")


def write_structured(nested: DataFrame, folder: str) -> None:
    """One JSON object for each document, with its doc_id; letters beyond ASCII as they are."""
    nested.select("doc_id", "document", "pages").write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def write_stage(df: DataFrame, folder: str) -> None:
    """A stage table."""
    df.write.mode("overwrite").parquet(folder)


def parse_validation_report(text: Column) -> Column:
    """STRUCT of the figures in a written validation report; null where one is missing."""
    return F.struct(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("double" if c == "validation_quality" else "long").alias(c) for c, p in REPORT_FIGURES.items()])


def with_derived_figures(figures: DataFrame) -> DataFrame:
    """Rows without issues and quality filled in from the other figures where they are missing."""
    rows, bad = F.col("table_rows"), F.col("rows_with_issues")
    rest = F.coalesce("rows_without_issues", F.greatest(rows - bad, F.lit(0)))
    return figures.withColumn("rows_without_issues", rest).withColumn("validation_quality", F.coalesce("validation_quality", F.when(rows > 0, rest / rows * 100)))


#: Lengths of the stretches by which names are compared.
STRETCHES = (1, 2, 4, 8, 16, 32)


def _contained(small: DataFrame, large: DataFrame) -> DataFrame:
    """The pairs of ``small(s, ...)`` and ``large(l, ...)`` where l contains s, which is not empty.

    The beginning of s, as long as the longest stretch that it has, must be one of l's
    stretches of that length. So the names are joined on stretches, not all with all.
    """
    longest = F.greatest(*[F.when(F.length("s") >= k, k).otherwise(0) for k in STRETCHES])
    begins = small.where(F.col("s") != "").withColumn("__stretch", F.left(F.col("s"), longest))
    all_of = lambda k: F.when(F.length("l") >= k, F.transform(F.sequence(F.lit(1), F.length("l") - (k - 1)), lambda i: F.substring(F.col("l"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    spread = large.withColumn("__stretch", F.explode(F.array_distinct(F.concat(*map(all_of, STRETCHES)))))
    return begins.join(spread, "__stretch").where(F.contains("l", F.col("s"))).drop("__stretch", "s", "l")


def match_reports(names: DataFrame, reports: DataFrame) -> DataFrame:
    """(doc_id, report): for each document ``names(doc_id, name)`` its report among ``reports(report, modified)``.

    The report named after the document comes first; else the newest whose normalised name
    contains the document's or is contained in it. Documents without one are left out, and
    so are names without an ASCII letter or digit.
    """
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    wanted = names.select("doc_id", F.regexp_replace(stem(F.col("name")), "^structured_", "").alias("base")).withColumn("s", plain(F.col("base")))
    have = reports.select("report", "modified", F.regexp_replace(stem(F.col("report")), "^ocr_validation_report_", "").alias("rbase")).withColumn("l", plain(F.col("rbase")))
    met = _contained(wanted, have).unionByName(_contained(have.withColumnRenamed("l", "s"), wanted.withColumnRenamed("s", "l")))
    return met.groupBy("doc_id").agg(F.max_by("report", F.struct(F.col("base") == F.col("rbase"), "modified", "report")).alias("report"))


def page_texts(pages: DataFrame) -> DataFrame:
    return pages.where(strip(F.col("text")) != "")


def spread(df: DataFrame) -> DataFrame:
    """A table that fewer than half as many tasks as there are cores would read is dealt evenly over the cores.

    A small file of one row group is one task, however long its rows take to work on.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() < cores else df
