"""What a renderer draws, as relations: styles, canvases and the reconstruction's draw list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators.scan import page_keys


def draw_styles(paths: DataFrame) -> DataFrame:
    """Whether a path is drawn at all, with its width (1 if unset), closing (true if unset) and colour."""
    stroke, fill = F.size("stroke_color") > 0, F.size("fill_color") > 0
    return paths.select(
        *page_keys(paths), "path_id",
        (F.coalesce(stroke, F.lit(False)) | F.coalesce(fill, F.lit(False))).alias("drawable"),
        F.coalesce("stroke_width", F.lit(1.0)).alias("width"),
        F.coalesce("closed", F.lit(True)).alias("closed"),
        G.path_color_hex(F.col("stroke_color"), F.col("fill_color")).alias("color"),
    )


def cluster_canvas(groups: DataFrame, bucket: list[str], dpi: float = 300.0, least_pad: float = 4.0) -> DataFrame:
    """Padding, translation and canvas of each group's picture: its box and the widest stroke around."""
    boxes = groups.groupBy(*bucket, "group_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.greatest(F.lit(least_pad), F.coalesce(F.max("stroke_width"), F.lit(0.0))).alias("pad"),
    )
    width, height = F.col("x1") - F.col("x0") + 2 * F.col("pad"), F.col("y1") - F.col("y0") + 2 * F.col("pad")
    return boxes.select(
        *bucket, "group_id", "pad", (F.col("pad") - F.col("x0")).alias("shift_x"), (F.col("pad") - F.col("y0")).alias("shift_y"),
        width.alias("width"), height.alias("height"), F.lit(float(dpi) / 72.0).alias("scale"),
    )


def reconstruction(drawings: DataFrame, words: DataFrame, results: DataFrame) -> DataFrame:
    """The page's draw list: drawings, then words, then recognised texts; blank texts are skipped.

    Words sit at their origin (the box's lower left if unset) with a size of one point
    at least; recognised texts at their box's lower left with their height, four at
    least. Angles go to the nearest quarter turn.
    """
    page = page_keys(drawings)
    drawn = drawings.select(
        *page, F.lit(0).alias("z"), F.col("seq").alias("ord"), F.lit("drawing").alias("item"), F.lit("").alias("text"),
        F.col("x0").alias("x"), F.col("y0").alias("y"), F.coalesce("stroke_width", F.lit(1.0)).alias("size"), F.lit(0).alias("rotation"),
    )
    written = words.where(F.col("text").rlike(r"\S")).select(
        *page, F.lit(1).alias("z"), F.col("ord"), F.lit("word").alias("item"), "text",
        F.coalesce("origin_x", F.col("x0")).alias("x"), F.coalesce("origin_y", F.col("y1")).alias("y"),
        F.greatest(F.col("font_size"), F.lit(1.0)).alias("size"), G.nearest_quarter(F.col("angle")).alias("rotation"),
    )
    read = results.where(F.col("text").rlike(r"\S")).select(
        *page, F.lit(2).alias("z"), F.col("ord"), F.lit("result").alias("item"), "text",
        F.col("x0").alias("x"), F.col("y1").alias("y"), F.greatest(F.col("y1") - F.col("y0"), F.lit(4.0)).alias("size"),
        G.nearest_quarter(F.col("rotation_used")).alias("rotation"),
    )
    return drawn.unionByName(written).unionByName(read)
