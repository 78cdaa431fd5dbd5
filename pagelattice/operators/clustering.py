"""Filters and clustering steps over groups of paths.

State is one row per path with its bucket columns, ``path_id``, ``seq``, a box and
``group_id``, the smallest path id of its group. Steps return the kept rows with new
group ids and the dropped rows. Components run over all buckets at once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators.components import connected_components
from pagelattice.operators.joins import dimension_links, overlap_pairs, spatial_pairs
from pagelattice.operators.scan import page_keys

BUCKET = ["page_index", "layer_key", "color_key"]
#: For parity: the number of entries from which a pairwise pass may be told to give one cluster.
PAIRWISE_CAP = 4000


def bucket_of(groups: DataFrame) -> list[str]:
    """The columns within which paths cluster: the page (of its document, where there are several), layer and colour."""
    return [*page_keys(groups), "layer_key", "color_key"]


def singletons(paths: DataFrame) -> DataFrame:
    """Every path its own group."""
    return paths.withColumn("group_id", F.col("path_id"))


def group_boxes(groups: DataFrame, bucket: list[str] | None = None) -> DataFrame:
    """``bucket, group_id, x0, y0, x1, y1, n``: the union box and size of each group."""
    bucket = bucket or bucket_of(groups)
    return groups.groupBy(*bucket, "group_id").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count(F.lit(1)).alias("n")
    )


def components(pairs: DataFrame, bucket: list[str]) -> DataFrame:
    """``bucket, node, component`` of pairs ``bucket, a, b``; the component is its smallest node."""

    def node(c: str) -> Column:
        return F.struct(*bucket, F.col(c).alias("n"))

    edges = pairs.select(node("a").alias("a"), node("b").alias("b"), F.xxhash64(*bucket).alias("bucket"))
    found = connected_components(edges, "a", "b", within="bucket")
    return found.select(*[F.col(f"node.{c}").alias(c) for c in bucket], F.col("node.n").alias("node"), F.col("component.n").alias("component"))


def _relabel(groups: DataFrame, pairs: DataFrame, node: str, bucket: list[str]) -> DataFrame:
    """Groups after merging the nodes that pairs connect; ``node`` becomes the group's id."""
    found = components(pairs, bucket).withColumnRenamed("node", "__node")
    keys = [groups[c].eqNullSafe(found[c]) for c in bucket]
    on = groups[node] == found["__node"]
    for k in keys:
        on &= k
    return groups.join(found, on, "left").select(
        *[groups[c] for c in groups.columns if c != "group_id"], F.coalesce(found["component"], groups[node]).alias("group_id")
    )


def _capped(boxes: DataFrame, pairs, node: str, bucket: list[str], cap: int | None) -> DataFrame:
    """Pairs of ``pairs(boxes)``; a bucket with more than ``cap`` entries is one cluster."""
    if cap is None:
        return pairs(boxes)
    w = Window.partitionBy(*bucket)
    sized = boxes.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__first", F.min(node).over(w))
    one = sized.where(F.col("__n") > cap).select(*bucket, F.col("__first").alias("a"), F.col(node).alias("b")).where("a < b")
    return pairs(sized.where(F.col("__n") <= cap).drop("__n", "__first")).unionByName(one)


# -- clustering ------------------------------------------------------------------------


def cluster_spatial(groups: DataFrame, threshold: float = 8.0, bucket: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Single linkage of all paths at the threshold, from scratch: earlier groups are dissolved."""
    bucket = bucket or bucket_of(groups)
    boxes = groups.select(*bucket, "path_id", "x0", "y0", "x1", "y1")
    return _relabel(groups, spatial_pairs(boxes, bucket, "path_id", threshold, exact), "path_id", bucket)


def cluster_spatial_union_find(groups: DataFrame, threshold: float = 8.0, bucket: list[str] | None = None, exact: bool = True) -> DataFrame:
    """Single linkage of whole groups by their union boxes: groups merge and never split."""
    bucket = bucket or bucket_of(groups)
    return _relabel(groups, spatial_pairs(group_boxes(groups, bucket), bucket, "group_id", threshold, exact), "group_id", bucket)


def _runs(groups: DataFrame, within: list[str], by: str, max_gap: float) -> DataFrame:
    order = Window.partitionBy(*within).orderBy(by, "path_id")
    gap = F.col(by) - F.lag(by).over(order)
    run = F.sum(F.when(gap > max_gap, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = groups.withColumn("__run", run)
    return out.withColumn("group_id", F.min("path_id").over(Window.partitionBy(*within, "__run"))).drop("__run")


def cluster_by_seq(groups: DataFrame, max_gap: float = 3, bucket: list[str] | None = None) -> DataFrame:
    """Splits each group where the drawing sequence jumps by more than ``max_gap``."""
    bucket = bucket or bucket_of(groups)
    return _runs(groups, [*bucket, "group_id"], "seq", max_gap)


def group_overlapping(
    groups: DataFrame, pages: DataFrame, scope: str = "path", tolerance: float | None = None, bucket: list[str] | None = None, cap: int | None = None
) -> DataFrame:
    """Merges boxes that touch or nearly touch, but not one inside another.

    ``scope`` is ``path`` (from scratch) or ``cluster`` (whole groups). The tolerance
    defaults to half a percent of the page's shorter side, three at least.
    """
    bucket = bucket or bucket_of(groups)
    if scope not in ("path", "cluster"):
        raise ValueError(f"unknown scope {scope!r}")
    node = "path_id" if scope == "path" else "group_id"
    boxes = groups.select(*bucket, "path_id", "x0", "y0", "x1", "y1") if scope == "path" else group_boxes(groups, bucket).drop("n")
    if tolerance is None:
        page = page_keys(groups)
        sizes = pages.select(*page, G.overlap_tolerance(F.col("width"), F.col("height")).alias("__tol"))
        boxes = boxes.join(sizes, page).select(*bucket, node, "x0", "y0", "x1", "y1", "__tol")
        reach = F.col("__tol")
    else:
        reach = F.lit(float(tolerance))
    return _relabel(groups, _capped(boxes, lambda b: overlap_pairs(b, bucket, node, reach), node, bucket, cap), node, bucket)


def cluster_by_dimension(groups: DataFrame, tolerance: float = 0.35, bucket: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Merges whole groups of similar width and height, wherever they are."""
    bucket = bucket or bucket_of(groups)
    boxes = group_boxes(groups, bucket)
    return _relabel(groups, _capped(boxes, lambda b: dimension_links(b, bucket, "group_id", tolerance), "group_id", bucket, cap), "group_id", bucket)


def cluster_by_item_path_count(groups: DataFrame, max_gap: float = 2, bucket: list[str] | None = None) -> DataFrame:
    """Runs of drawings by their path count (``drawing_paths``, frozen at the chain's input), from scratch."""
    bucket = bucket or bucket_of(groups)
    return _runs(groups, bucket, "drawing_paths", max_gap)


def cluster_by_item_bbox(groups: DataFrame, tolerance: float = 0.35, bucket: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """Groups paths whose drawings have similar boxes (``drawing_x0``..), from scratch; runs once per drawing."""
    bucket = bucket or bucket_of(groups)
    drawings = groups.groupBy(*bucket, "seq").agg(
        F.min("path_id").alias("__lead"), F.first("drawing_x0").alias("x0"), F.first("drawing_y0").alias("y0"),
        F.first("drawing_x1").alias("x1"), F.first("drawing_y1").alias("y1"), F.count(F.lit(1)).alias("__n"),
    )
    led = groups.withColumn("__lead", F.min("path_id").over(Window.partitionBy(*bucket, "seq")))
    if cap is not None:  # the cap counts paths
        w = Window.partitionBy(*bucket)
        drawings = drawings.withColumn("__all", F.sum("__n").over(w)).withColumn("__first", F.min("__lead").over(w))
        one = drawings.where(F.col("__all") > cap).select(*bucket, F.col("__first").alias("a"), F.col("__lead").alias("b")).where("a < b")
        pairs = dimension_links(drawings.where(F.col("__all") <= cap), bucket, "__lead", tolerance).unionByName(one)
    else:
        pairs = dimension_links(drawings, bucket, "__lead", tolerance)
    return _relabel(led, pairs, "__lead", bucket).drop("__lead")


# -- filters -----------------------------------------------------------------------------


Store = Callable[[DataFrame], DataFrame]


def _as_is(df: DataFrame) -> DataFrame:
    return df


def layout_panel(bucket: list[str] = BUCKET) -> Column:
    """Whether a path is a drawing's only path in the current population and a rectangle or quad."""
    alone = F.count(F.lit(1)).over(Window.partitionBy(*bucket, "seq")) == 1
    return alone & F.col("kind").isin("re", "qu")


def _large(b: dict[str, Column], fraction: float) -> Column:
    page = F.col("width") * F.col("height")
    return (page > 0) & (G.area(b) > F.lit(float(fraction)) * page)


def split_paths(groups: DataFrame, drop: Column, bucket: list[str] | None = None, store: Store = _as_is) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) by a path predicate: groups keep their survivors, dropped paths stand alone.

    ``store`` is given the marked rows that both parts are read from, to write them once.
    """
    bucket = bucket or bucket_of(groups)
    marked = store(groups.withColumn("__drop", F.coalesce(drop, F.lit(False))))
    kept = marked.where(~F.col("__drop")).drop("__drop")
    kept = kept.withColumn("group_id", F.min("path_id").over(Window.partitionBy(*bucket, "group_id")))
    return kept, marked.where("__drop").drop("__drop").withColumn("group_id", F.col("path_id"))


def split_groups(groups: DataFrame, drop, bucket: list[str] | None = None, store: Store = _as_is) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) whole groups; ``drop`` is given the columns of the group's union box. ``store`` as in ``split_paths``."""
    bucket = bucket or bucket_of(groups)
    w = Window.partitionBy(*bucket, "group_id")
    boxed = groups
    for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max)):
        boxed = boxed.withColumn(f"__{c}", f(c).over(w))
    boxed = store(boxed.withColumn("__drop", F.coalesce(drop(G.box("__")), F.lit(False))))
    gone = ["__x0", "__y0", "__x1", "__y1", "__drop"]
    return boxed.where(~F.col("__drop")).drop(*gone), boxed.where("__drop").drop(*gone)


def filter_layout_panels(groups: DataFrame, bucket: list[str] | None = None, store: Store = _as_is) -> tuple[DataFrame, DataFrame]:
    bucket = bucket or bucket_of(groups)
    return split_paths(groups, layout_panel(bucket), bucket, store)


def _with_page(groups: DataFrame, pages: DataFrame) -> DataFrame:
    page = page_keys(groups)
    return groups.join(pages.select(*page, "width", "height"), page).select(*groups.columns, "width", "height")


def filter_large_bbox(
    groups: DataFrame, pages: DataFrame, max_area_fraction: float = 0.2, bucket: list[str] | None = None, store: Store = _as_is
) -> tuple[DataFrame, DataFrame]:
    """Drops paths larger than a fraction of the page; a page without area keeps all."""
    bucket = bucket or bucket_of(groups)
    kept, dropped = split_paths(_with_page(groups, pages), _large(G.box(), max_area_fraction), bucket, store)
    return kept.drop("width", "height"), dropped.drop("width", "height")


def filter_large_group_bbox(
    groups: DataFrame, pages: DataFrame, max_area_fraction: float = 0.2, bucket: list[str] | None = None, store: Store = _as_is
) -> tuple[DataFrame, DataFrame]:
    """Drops groups whose union box is larger than a fraction of the page."""
    bucket = bucket or bucket_of(groups)
    kept, dropped = split_groups(_with_page(groups, pages), lambda b: _large(b, max_area_fraction), bucket, store)
    return kept.drop("width", "height"), dropped.drop("width", "height")


def filter_aspect_ratio(
    groups: DataFrame, max_aspect_ratio: float = 10.0, bucket: list[str] | None = None, store: Store = _as_is
) -> tuple[DataFrame, DataFrame]:
    """Drops groups whose union box is more than so many times longer than wide."""
    bucket = bucket or bucket_of(groups)
    return split_groups(groups, lambda b: G.aspect_ratio(b["x0"], b["y0"], b["x1"], b["y1"]) > max_aspect_ratio, bucket, store)
