"""Drawing aggregation and statistics over groups of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators.scan import page_keys


def build_drawings(paths: DataFrame, order: str = "path_id") -> DataFrame:
    """One row per drawing: union box, style of the first member by ``order``, whether dashed, its members in order.

    Each part of the style is an aggregate of its own, so those not read take no room. Paths
    without ``path_id`` give no members.
    """
    page = page_keys(paths)
    style = [F.min_by(c, order).alias(c) for c in ("layer_key", "color_key", "stroke_width", "dashes")]
    members = [F.array_sort(F.collect_list("path_id")).alias("members")] if "path_id" in paths.columns else []
    out = paths.groupBy(*page, "seq").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count(F.lit(1)).alias("n_paths"), *style, *members,
    )
    return out.select(
        *page, "seq", "x0", "y0", "x1", "y1", "n_paths", "layer_key", "color_key", "stroke_width",
        G.is_dashed(F.col("dashes")).alias("dashed"), *["members"] * len(members),
    )


def text_clusters(groups: DataFrame, bucket: list[str]) -> DataFrame:
    """One row per group: union box, size and members in order."""
    return groups.groupBy(*bucket, "group_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.count(F.lit(1)).alias("n_paths"), F.array_sort(F.collect_list("path_id")).alias("members"),
    )


def size_stats(groups: DataFrame, bucket: list[str]) -> DataFrame:
    """Number, least, median, mean and largest of the groups' sizes; zeros where there are none."""
    sizes = groups.groupBy(*bucket, "group_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.coalesce(F.min("n"), F.lit(0)).alias("least"),
        F.coalesce(F.median("n"), F.lit(0.0)).alias("median"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"),
        F.coalesce(F.max("n"), F.lit(0)).alias("most"),
    )


def step_counts(log: DataFrame, bucket: list[str]) -> DataFrame:
    """Groups and paths kept and dropped by each step of a chain's log."""
    groups = log.groupBy("step_index", "step", "status", *bucket, "group_id").agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy("step_index", "step", "status").agg(F.count(F.lit(1)).alias("n_groups"), F.sum("n").alias("n_paths"))


def centroids(groups: DataFrame, bucket: list[str]) -> DataFrame:
    boxes = groups.groupBy(*bucket, "group_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    return boxes.select(*bucket, "group_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
