"""Tables written to the storage that driver and executors share."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local one only where the session names none and runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to shared storage and read back: lineage ends there, so a lost executor costs no earlier stage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def save(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Write a table with its schema beside it, so that it can be loaded also without rows; replaces the one there."""
    last = StructType([*[f for f in df.schema if f.name != partition], *[f for f in df.schema if f.name == partition]])
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(last.json(),)], "value string").write.mode("overwrite").text(f"{path}/schema")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``save`` wrote; a partition column is the last one."""
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first().value))
    return spark.read.schema(schema).parquet(f"{path}/rows")
