"""The store of report texts: one report for each document and language, replaced or removed by itself."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.storage import materialise
from folioforge.operators.report import LANGUAGES

#: Buckets of documents, a folder each.
BUCKETS = 64
KEY = ["doc_id", "language"]


def language_or_default(language: str | None) -> str:
    """A language that reports have, in lower case; English for any other."""
    named = (language or "").strip().lower()
    return named if named in LANGUAGES else LANGUAGES[0]


def bucket_of(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("string")), F.lit(BUCKETS)).cast("int")


def _by_bucket(rows: DataFrame) -> DataFrame:
    """With the bucket, dealt by it; AQE splits large buckets over tasks and puts small ones together."""
    return rows.withColumn("bucket", bucket_of(F.col("doc_id"))).hint("rebalance", F.col("bucket"))


def _append(rows: DataFrame, folder: str) -> None:
    """Adds versions; nothing that is there is touched, so a job that fails or runs twice does no harm."""
    _by_bucket(rows).write.mode("append").partitionBy("bucket").parquet(folder)


def write_reports(reports: DataFrame, folder: str, as_files: bool = False, language: str | None = None, version: int | None = None) -> None:
    """Stores ``reports(doc_id, lines)`` in a language; a document's earlier report is replaced, all others stay.

    Each write adds rows with a version (by default the clock's nanoseconds) to the buckets of
    its documents; readers take the newest. Writing again with the same version changes
    nothing, and a write that fails half way leaves the old reports.

    ``as_files`` makes text files instead, a folder for each document, and replaces those of
    the given documents only; it is for as many documents as a file system takes.
    """
    texts = reports.select("doc_id", F.array_join("lines", "\n").alias("text"))
    if as_files:
        texts.select("doc_id", F.col("text").alias("value")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").text(folder)
        return
    number = time.time_ns() if version is None else version
    _append(texts.select("doc_id", F.lit(language_or_default(language)).alias("language"), "text", F.lit(number).cast("long").alias("version")), folder)


def remove_reports(ids: DataFrame, folder: str, language: str | None = None, version: int | None = None) -> None:
    """Removes the reports in a language of the documents ``ids(doc_id)``; ids without one are passed over."""
    number = time.time_ns() if version is None else version
    gone = ids.select("doc_id", F.lit(language_or_default(language)).alias("language"), F.lit(None).cast("string").alias("text"), F.lit(number).cast("long").alias("version"))
    _append(gone.distinct(), folder)


def _newest(rows: DataFrame) -> DataFrame:
    """(doc_id, language, text, version) of the newest versions; of one version written with different texts, the greater text."""
    return rows.groupBy(*KEY).agg(F.max(F.struct("version", "text")).alias("v")).select(*KEY, "v.text", "v.version")


def read_reports(spark: SparkSession, folder: str, as_files: bool = False, language: str | None = None, doc_id: str | int | None = None) -> DataFrame:
    """(doc_id, language, text, version) of the reports that ``write_reports`` stored; a document without one has no row.

    With ``doc_id`` only that document's bucket is read. An empty or missing store has no
    reports. Of files: (doc_id, text).
    """
    if as_files:
        return spark.read.text(folder, wholetext=True).select("doc_id", F.col("value").alias("text"))
    try:
        stored = spark.read.parquet(folder)
    except AnalysisException:
        return spark.createDataFrame([], "doc_id string, language string, text string, version long")
    if language is not None:
        stored = stored.where(F.col("language") == language_or_default(language))
    if doc_id is not None:
        bucket = spark.range(1).select(bucket_of(F.lit(doc_id))).first()[0]
        stored = stored.where((F.col("bucket") == bucket) & (F.col("doc_id") == doc_id))
    return _newest(stored).where("text IS NOT NULL")


def compact_reports(spark: SparkSession, folder: str) -> int:
    """Drops replaced and removed versions from the buckets that have any, and says how many buckets were rewritten.

    What a bucket is to hold is written to shared storage before its folder is replaced. No
    other writer may be at work meanwhile.
    """
    stored = spark.read.parquet(folder)
    counts = stored.groupBy("bucket", *KEY).agg(F.count("*").alias("n"), F.max(F.struct("version", "text")).alias("v"))
    stale = counts.groupBy("bucket").agg(F.max((F.col("n") > 1) | F.col("v.text").isNull()).alias("stale")).where("stale").select("bucket")
    todo = [r.bucket for r in stale.collect()]  # BUCKETS at most
    if todo:
        kept = materialise(_newest(stored.where(F.col("bucket").isin(todo))).where("text IS NOT NULL"), "reports")
        emptied = set(todo) - {r.bucket for r in kept.select(bucket_of(F.col("doc_id")).alias("bucket")).distinct().collect()}
        _by_bucket(kept).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for bucket in emptied:  # dynamic overwriting leaves a folder for which there are no rows
            files.delete(spark._jvm.org.apache.hadoop.fs.Path(folder, f"bucket={bucket}"), True)
    return len(todo)
