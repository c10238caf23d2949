"""Extension: new text files validated as they arrive. The batch functions do the work on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioforge.functions.text import to_lines
from folioforge.operators import validation
from folioforge.sources.documents import file_name


def stream_texts(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(doc_id, text) of the text files that arrive in a folder."""
    files = spark.readStream.format("text").option("wholetext", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return files.select(F.url_decode(file_name(F.input_file_name())).alias("doc_id"), F.col("value").alias("text"))


def stream_metrics(texts: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Writes validation metrics of each micro-batch, its number beside them; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        found = validation.metrics(batch, to_lines(batch))
        found.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
