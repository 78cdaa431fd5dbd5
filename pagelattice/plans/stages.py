"""The page pipeline as named stages over DataFrames.

Stages run in order up to ``final_stage``; a stage that fails is reported and the later
ones still run, with whatever inputs they have. Plans are lazy: with ``materialize``
each stage is executed at once, so that errors at run time are caught here too.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.operators import aggregates, clustering, scan, voting
from pagelattice.plans import chain
from pagelattice.runtime import materialize as write_out
from pagelattice.sources.sinks import stage_logger


@dataclass
class Context:
    """Inputs (flat or nested page relations) and what the stages have made so far."""

    pages: DataFrame
    words: DataFrame | None = None
    drawings: DataFrame | None = None
    order: Sequence[str] | None = None
    params: Mapping[str, Mapping] | None = None
    read: Callable[[DataFrame], DataFrame] | None = None
    made: dict[str, object] = field(default_factory=dict)


@dataclass
class StageOutput:
    key: str
    label: str
    status: str
    data: object = None
    error: str | None = None


def _reader(c: Context):
    return scan.page_metadata(c.pages)


def _native(c: Context):
    return scan.reading_order(c.words)


def _vectors(c: Context):
    return scan.number_paths(scan.extract_paths(c.drawings)).withColumn("layer_key", F.coalesce("layer", F.lit("")))


def _layers(c: Context):
    paths = c.made["vector_extract"]
    return paths.groupBy(*scan.page_keys(paths), "layer_key").agg(F.count(F.lit(1)).alias("n"))


def _colors(c: Context):
    return scan.color_key(c.made["vector_extract"])


def _clustering(c: Context):
    return chain.run_chain(c.made["color_separation"], c.made["reader"], c.order, c.params)


def _drawing_vectors(c: Context):
    return aggregates.build_drawings(chain.all_dropped(c.made["clustering"]))


def _ocr(c: Context):
    groups = chain.classify(c.made["clustering"])
    clusters = aggregates.text_clusters(groups, clustering.bucket_of(groups))
    if c.read is None:
        return clusters.withColumn("text", F.lit("")).withColumn("confidence", F.lit(0.0))
    return voting.vote_fuzzy(c.read(clusters))


STAGES: dict[str, tuple[str, Callable[[Context], object]]] = {
    "reader": ("Pages", _reader),
    "native": ("Native words", _native),
    "vector_extract": ("Vector paths", _vectors),
    "layer_separation": ("Layers", _layers),
    "color_separation": ("Colours", _colors),
    "clustering": ("Clustering", _clustering),
    "drawing_vectors": ("Drawings", _drawing_vectors),
    "ocr_text_clusters": ("Recognised text", _ocr),
}


def run_stages(context: Context, final_stage: str | None = None, materialize: bool = False) -> list[StageOutput]:
    """Outputs of the stages up to and with ``final_stage``; unknown names raise ``ValueError`` first."""
    if final_stage is not None and final_stage not in STAGES:
        raise ValueError(f"unknown stage {final_stage!r}")
    out = []
    for key, (label, run) in STAGES.items():
        try:
            data = run(context)
            if materialize and isinstance(data, DataFrame):
                data = write_out(data, f"stage-{key}")
            context.made[key] = data
            out.append(StageOutput(key, label, "ok", data))
        except Exception as e:  # reported; the later stages still run
            stage_logger(key).warning("%s failed: %s", label, e)
            out.append(StageOutput(key, label, "error", error=f"{type(e).__name__}: {e}"))
        if key == final_stage:
            break
    return out


class Memo:
    """The latest runs by page selection, step order and parameters, persisted until pushed out or dropped."""

    def __init__(self, run: Callable[..., DataFrame], most: int = 8) -> None:
        self._run, self._most, self._kept = run, most, {}

    def get(self, pages, order: Sequence[str], params: Mapping[str, Mapping] | None = None) -> DataFrame:
        key = (tuple(pages), tuple(order), tuple(sorted((s, tuple(sorted(p.items()))) for s, p in (params or {}).items())))
        found = self._kept.pop(key, None)
        self._kept[key] = self._run(pages, order, params).persist() if found is None else found
        while len(self._kept) > self._most:
            self._kept.pop(next(iter(self._kept))).unpersist()
        return self._kept[key]

    def clear(self) -> None:
        for df in self._kept.values():
            df.unpersist()
        self._kept.clear()
