"""The landing table of uploaded files: what is accepted, under its base name, and what is refused and why."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.storage import save
from folioforge.sources.documents import file_extension, file_name, upload_message


def base_name(name: Column) -> Column:
    """The part of a name after its last slash of either kind."""
    return file_name(F.translate(name, "\\", "/"))


def judged(uploads: DataFrame) -> DataFrame:
    """``uploads(name, content)`` with file (the base name), type and message, which is null for what is accepted."""
    named = uploads.withColumn("file", base_name(F.col("name")))
    return named.withColumns({"message": upload_message(F.col("file")), "type": file_extension(F.col("file"))})


def land(uploads: DataFrame, folder: str, version: int | None = None) -> DataFrame:
    """Adds the accepted of ``uploads(name, content)`` to the landing table and gives the refused: (name, message).

    A file of a name that is there already takes its place; of several in one call, the one
    with the greatest content. Each call adds a folder of its own (named by ``version``, by
    default the clock's nanoseconds), so one that fails or runs twice spoils nothing.
    """
    number = time.time_ns() if version is None else version
    seen = judged(uploads)
    taken = seen.where(F.col("message").isNull()).groupBy("file").agg(F.max_by(F.struct("type", "content"), F.struct(F.length("content"), F.sha2("content", 256))).alias("x"))
    save(taken.select("file", "x.type", "x.content", F.lit(number).cast("long").alias("version")), f"{folder}/{number:020d}")
    return seen.where(F.col("message").isNotNull()).select("name", "message")


def landed(spark: SparkSession, folder: str, *versions: int) -> DataFrame:
    """(path, type, content, version) of the newest file of each name among the calls of these versions, to be read by an extractor.

    Without versions, of all calls; none before the first. The names of the newest are found
    without the contents, which are then read once.
    """
    paths = [f"{folder}/{v:020d}/rows" for v in versions] or [f"{folder}/*/rows"]
    schema = "file string, type string, content binary, version long"
    try:
        every = spark.read.schema(schema).parquet(*paths)
    except AnalysisException:
        every = spark.createDataFrame([], schema)
    newest = every.groupBy("file").agg(F.max("version").alias("version"))
    return every.join(newest, ["file", "version"]).select(F.col("file").alias("path"), "type", "content", "version")
