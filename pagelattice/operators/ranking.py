"""Row numbers over groups of any size without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucketed_rank(df: DataFrame, group: list[str], bucket: str, order: list[Column | str], out: str) -> DataFrame:
    """Add ``out``, the 0-based rank within ``group`` by ``(bucket, *order)``.

    ``bucket`` must be a monotone coarsening of ``order``. Ranks are counted within
    each (group, bucket) and shifted by the sizes of the buckets before, so a task
    holds buckets only, never a whole group. Group and bucket must not be null. The
    running sum is over one row per bucket.
    """
    keys = [*group, bucket]
    local = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    running = (Window.partitionBy(*group) if group else Window.partitionBy()).orderBy(bucket)
    shift = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, F.coalesce(F.sum("__n").over(running.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    )
    return local.join(shift, keys).withColumn(out, F.col(out) + F.col("__before")).drop("__before")


def bucket_count(rows: int, per_bucket: int = 4096, least: int = 64, most: int = 1 << 20) -> int:
    """How many buckets to rank in; results do not depend on it."""
    return max(least, min(most, rows // per_bucket))
