"""Streams of page relations: stateless per-page operators over arriving files, and a
windowed count of arriving readings with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_table(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def per_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run a page operator on every micro-batch; a page's rows must arrive in one file.

    Each batch goes to a folder of its own, written anew if the batch is retried, so
    every page is in the output exactly once.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``window_start, key, n`` of rows in tumbling windows; rows later than the watermark are left out."""
    counted = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n")
