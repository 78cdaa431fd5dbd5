"""Clustering chains: an ordered list of named steps folded over the groups, with a log.

Any number of steps may be given and steps may repeat; parameters go by step name.
Statistics of drawings are frozen at the chain's input; filters see what the steps
before them have kept. A chain that filters everything ends with no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.operators import clustering as C
from pagelattice.operators.joins import with_drawing_stats
from pagelattice.runtime import materialize

DEFAULT_ORDER = (
    "filter_layout_panels", "filter_large_bbox", "cluster_spatial", "none", "none", "none", "filter_large_group_bbox", "filter_aspect_ratio",
)
#: step -> parameters it takes; others are ignored
STEPS: dict[str, tuple[str, ...]] = {
    "none": (),
    "filter_layout_panels": (),
    "filter_large_bbox": ("max_area_fraction",),
    "filter_large_group_bbox": ("max_area_fraction",),
    "filter_aspect_ratio": ("max_aspect_ratio",),
    "cluster_spatial": ("threshold",),
    "cluster_spatial_union_find": ("threshold",),
    "cluster_by_seq": ("max_gap",),
    "group_overlapping": ("bbox_scope", "tolerance"),
    "cluster_groups_by_dimension": ("tolerance",),
    "cluster_by_item_path_count": ("max_gap",),
    "cluster_by_item_bbox": ("tolerance",),
}
_LOG = ["step_index", "step", "path_id", "group_id", "status"]


def apply_step(
    name: str, groups: DataFrame, pages: DataFrame, params: Mapping | None = None, bucket: list[str] | None = None, store: C.Store = C._as_is
) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) of one step. Unknown steps raise ``ValueError``. A filter's marked rows go through ``store``."""
    bucket = bucket or C.bucket_of(groups)
    if name not in STEPS:
        raise ValueError(f"unknown step {name!r}")
    given = {k: v for k, v in (params or {}).items() if k in STEPS[name]}
    nothing = groups.limit(0)
    if name == "none":
        return groups, nothing
    if name == "filter_layout_panels":
        return C.filter_layout_panels(groups, bucket, store)
    if name == "filter_large_bbox":
        return C.filter_large_bbox(groups, pages, bucket=bucket, store=store, **given)
    if name == "filter_large_group_bbox":
        return C.filter_large_group_bbox(groups, pages, bucket=bucket, store=store, **given)
    if name == "filter_aspect_ratio":
        return C.filter_aspect_ratio(groups, bucket=bucket, store=store, **given)
    if name == "group_overlapping":
        if "bbox_scope" in given:
            given["scope"] = given.pop("bbox_scope")
        return C.group_overlapping(groups, pages, bucket=bucket, **given), nothing
    kernel = {
        "cluster_spatial": C.cluster_spatial,
        "cluster_spatial_union_find": C.cluster_spatial_union_find,
        "cluster_by_seq": C.cluster_by_seq,
        "cluster_groups_by_dimension": C.cluster_by_dimension,
        "cluster_by_item_path_count": C.cluster_by_item_path_count,
        "cluster_by_item_bbox": C.cluster_by_item_bbox,
    }[name]
    return kernel(groups, bucket=bucket, **given), nothing


def run_chain(
    paths: DataFrame, pages: DataFrame, order: Sequence[str] | None = None, params: Mapping[str, Mapping] | None = None, bucket: list[str] | None = None
) -> list[tuple[str, DataFrame, DataFrame]]:
    """``(step, kept, dropped)`` after each step; ``dropped`` is what that step dropped."""
    bucket = bucket or C.bucket_of(paths)
    groups = C.singletons(with_drawing_stats(paths, bucket))
    out = []
    for name in order or DEFAULT_ORDER:
        # what a filter marks is written once, for its kept and dropped rows and all steps after it
        kept, dropped = apply_step(name, groups, pages, (params or {}).get(name), bucket, lambda df, name=name: materialize(df, f"chain-{name}"))
        if STEPS[name] and not name.startswith("filter"):
            kept = materialize(kept, f"chain-{name}")  # the steps after it read the clusters, not the joins
        out.append((name, kept, dropped))
        groups = kept
    return out


def step_log(steps: list[tuple[str, DataFrame, DataFrame]], bucket: list[str] | None = None) -> DataFrame:
    """The chain as one long relation ``bucket, step_index, step, path_id, group_id, status``."""
    bucket = bucket or C.bucket_of(classify(steps))
    parts = []
    for i, (name, kept, dropped) in enumerate(steps):
        for status, rows in (("kept", kept), ("dropped", dropped)):
            parts.append(
                rows.select(*bucket, F.lit(i).alias("step_index"), F.lit(name).alias("step"), "path_id", "group_id", F.lit(status).alias("status"))
            )
    return reduce(DataFrame.unionByName, parts)


def classify(steps: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """The groups kept by the last step."""
    return steps[-1][1]


def all_dropped(steps: list[tuple[str, DataFrame, DataFrame]]) -> DataFrame:
    """Every path some step dropped."""
    return reduce(DataFrame.unionByName, [dropped for _, _, dropped in steps])
