"""Readings of rotated clusters: fan-out, left-to-right joining, and confidence votes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from pagelattice.functions import geometry as G

SIMILAR = 0.75
ROTATIONS = 8


def rotation_fanout(clusters: DataFrame, n: int = ROTATIONS) -> DataFrame:
    """One row per cluster and rotation, evenly spaced from 0 degrees."""
    if n <= 0:
        raise ValueError("at least one rotation is needed")
    at = clusters.withColumn("rotation_index", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return at.withColumn("angle", F.col("rotation_index") * F.lit(360.0 / n))


def combine_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Texts of one reading joined left to right, their mean score and covering box.

    Boxes have ``ord``, ``text``, ``score`` and a box; equal left edges go by ``ord``.
    """
    texts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "ord", "text"))), lambda t: t["text"])
    return boxes.groupBy(*keys).agg(
        F.array_join(texts, " ").alias("text"), F.avg("score").alias("confidence"),
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
    )


def _tally(readings: DataFrame, grouped: DataFrame, key: str, group: str) -> DataFrame:
    """Winning text per cluster of readings that are grouped already; blank ones are left out by the caller."""
    sums = grouped.groupBy(key, group).agg(
        F.sum("confidence").alias("total"), F.avg("confidence").alias("mean"), F.min("rotation_index").alias("first"),
        F.max(F.struct("confidence", (-F.col("rotation_index")).alias("k"), F.col("text").alias("t"))).alias("best"),
    )
    won = sums.groupBy(key).agg(F.max(F.struct("total", (-F.col("first")).alias("k"), "mean", F.col("best.t").alias("t"))).alias("m"))
    return (
        readings.select(key).distinct().join(won, key, "left")
        .select(key, F.coalesce("m.t", F.lit("")).alias("text"), F.coalesce("m.mean", F.lit(0.0)).alias("confidence"))
    )


def vote_exact(readings: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Winning text per cluster where texts are the same or dissimilar: grouped by normalised text.

    The group of largest total confidence wins (the first met on ties); its text is that
    of its most confident reading as it was read, its confidence the mean. Blank readings
    do not count; a cluster without others gets the empty text and 0.
    """
    seen = readings.withColumn("norm", G.normalize_text(F.col("text"))).where(F.col("text").rlike(r"\S"))
    return _tally(readings, seen, key, "norm")


def leaders(texts: list[str | None], similar: float = SIMILAR) -> list[int]:
    """For each text the place of the first leader it resembles, itself if none; -1 for blank texts.

    Leaders are the texts that resembled none before them. The measure depends on the
    order of its arguments, which is the reading, then the leader.
    """
    norms = [" ".join((t or "").split()).casefold() for t in texts]
    matcher, found = SequenceMatcher(None), []
    for at, norm in enumerate(norms):
        matcher.set_seq1(norm)
        place = at if norm else -1
        for lead in sorted({p for p in found if p >= 0}) if norm else ():
            matcher.set_seq2(norms[lead])
            if matcher.ratio() >= similar:
                place = lead
                break
        found.append(place)
    return found


def vote_fuzzy(readings: DataFrame, key: str = "cluster_id", similar: float = SIMILAR) -> DataFrame:
    """The vote of ``vote_exact`` with similar texts as one group, led by its first reading.

    Readings of a cluster (a handful) are put in rotation order and get their leader in
    Arrow batches; totals, means and winners are aggregations.
    """
    member = F.struct("rotation_index", "text", "confidence")
    rows = readings.groupBy(key).agg(F.array_sort(F.collect_list(member)).alias("members"))
    schema = StructType([*rows.schema.fields, StructField("lead", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = [leaders([m["text"] for m in members], similar) for members in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lead, pa.list_(pa.int32()))], names=[*batch.schema.names, "lead"])

    led = rows.mapInArrow(run, schema)
    each = led.select(key, F.posexplode("members").alias("at", "m"), "lead").select(key, "m.*", F.element_at("lead", F.col("at") + 1).alias("lead"))
    return _tally(readings, each.where("lead >= 0"), key, "lead")


def best_rotation(readings: DataFrame, key: str = "cluster_id", n: int = ROTATIONS) -> DataFrame:
    """Rotation, in whole degrees, of the first most confident reading of each cluster."""
    best = readings.groupBy(key).agg(F.max(F.struct("confidence", (-F.col("rotation_index")).alias("k"))).alias("m"))
    return best.select(key, F.pmod(F.bround(F.lit(360.0 / n) * -F.col("m.k"), 0).cast("int"), F.lit(360)).alias("rotation_used"))


def read_clusters(images: DataFrame, engine: Callable[[], Callable[[bytes], tuple[str, float]]], key: str = "cluster_id") -> DataFrame:
    """Readings of rendered rotations by a recognition engine, made once per Python worker.

    ``images`` has ``key``, ``rotation_index`` and ``image``; ``engine`` returns a
    function from image bytes to text and confidence. An image that fails reads as blank.
    """
    kind = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = engine()
        for pdf in batches:
            out = []
            for image in pdf["image"]:
                try:
                    out.append(read(image))
                except Exception:  # a broken image must not end the job
                    out.append(("", 0.0))
            yield pd.DataFrame({
                key: pdf[key], "rotation_index": pdf["rotation_index"],
                "text": [t for t, _ in out], "confidence": [float(c) for _, c in out],
            })

    return images.select(key, "rotation_index", "image").mapInPandas(run, f"{key} {kind}, rotation_index int, text string, confidence double")
