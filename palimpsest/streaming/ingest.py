"""Incremental comparison: a stream of page texts or pairs goes through the same plans, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """New text files below a folder as (doc_id, page_number, text, arrived)."""
    raw = spark.readStream.option("wholetext", "true").text(path)
    return raw.select(F.col("_metadata.file_path").alias("doc_id"), F.lit(1).alias("page_number"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("arrived"))


def once_each(stream: DataFrame, keys: list[str], time: str = "arrived", late: str = "1 hour") -> DataFrame:
    """Rows whose keys have not come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def compare_stream(pairs: DataFrame, compare: Callable[[DataFrame], dict[str, DataFrame]], sink: str, checkpoint: str, tables: list[str]):
    """Writes the named results of compare(pairs of the batch) below sink, a folder for each batch, so that a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        results = compare(batch)
        for name in tables:
            results[name].write.mode("overwrite").parquet(f"{sink}/{name}/batch={number}")

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
