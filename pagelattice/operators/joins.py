"""Spatial joins as equi-joins on grid cells.

A box is listed in every cell it covers; two boxes that come near meet in several cells
and are reported in one of them only, so no distinct is needed. Page and layer keys are
part of the join key, and a crowded page is spread over its cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagelattice.functions import geometry as G
from pagelattice.operators.scan import page_keys

CELL = 64.0
#: Cells an item may register in before the parity mode keeps its centre cell only.
PARITY_CELLS = 2000


def _celled(df: DataFrame, grow: Column, cell: float) -> DataFrame:
    def span(a: str, b: str) -> Column:
        return F.sequence(F.floor((F.col(a) - grow) / cell), F.floor((F.col(b) + grow) / cell))

    return df.withColumn("__cx", F.explode(span("x0", "x1"))).withColumn("__cy", F.explode(span("y0", "y1")))


def _sided(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def near_pairs(left: DataFrame, right: DataFrame, keys: list[str], reach: Column, cell: float = CELL) -> DataFrame:
    """Pairs of boxes of equal ``keys`` whose gap is at most ``reach``, once each.

    ``reach`` is a column of ``left``'s and ``right``'s keys or a literal. Other columns
    come out prefixed ``l_`` and ``r_``. Boxes must have x0 <= x1 and y0 <= y1.
    """
    a = _sided(_celled(left.withColumn("__r", reach), F.lit(0.0), cell), "l_", [*keys, "__cx", "__cy"])
    b = _sided(_celled(right.withColumn("__r", reach), F.col("__r"), cell), "r_", [*keys, "__cx", "__cy"])
    l, r = G.box("l_"), G.box("r_")
    home = [F.floor(F.greatest(l[c], r[c] - F.col("r___r")) / cell) == F.col(k) for c, k in (("x0", "__cx"), ("y0", "__cy"))]
    near = G.gap_squared(l, r) <= F.col("r___r") * F.col("r___r")
    return a.join(b, [*keys, "__cx", "__cy"]).where(home[0] & home[1] & near).drop("__cx", "__cy", "l___r", "r___r")


def spatial_pairs(boxes: DataFrame, keys: list[str], node: str, threshold: float, exact: bool = True, cell: float = CELL) -> DataFrame:
    """``keys, a, b`` (a < b) of boxes at most ``threshold`` apart.

    ``exact=False`` adds the rule of a hash grid of the threshold's cell size: an item
    over more than 2000 cells is known in its centre cell only, so it can miss
    neighbours.
    """
    pairs = near_pairs(boxes, boxes, keys, F.lit(float(threshold)), max(cell, threshold)).where(F.col(f"l_{node}") < F.col(f"r_{node}"))
    if not exact:
        size = max(threshold, 1e-6)

        def registered(p: str) -> dict[str, Column]:
            b = G.box(p)
            span = {c: F.floor(b[c] / size) for c in b}
            many = (span["x1"] - span["x0"] + 1) * (span["y1"] - span["y0"] + 1) > PARITY_CELLS
            mid = {"x": F.floor((b["x0"] + b["x1"]) / 2 / size), "y": F.floor((b["y0"] + b["y1"]) / 2 / size)}
            return {c: F.when(many, mid[c[0]]).otherwise(span[c]) for c in b}

        l, r = registered("l_"), registered("r_")
        pairs = pairs.where(
            (l["x0"] - 1 <= r["x1"]) & (r["x0"] <= l["x1"] + 1) & (l["y0"] - 1 <= r["y1"]) & (r["y0"] <= l["y1"] + 1)
        )
    return pairs.select(*keys, F.col(f"l_{node}").alias("a"), F.col(f"r_{node}").alias("b"))


def overlap_pairs(boxes: DataFrame, keys: list[str], node: str, tolerance: Column, cell: float = CELL) -> DataFrame:
    """Pairs at most ``tolerance`` apart of which neither contains the other."""
    pairs = near_pairs(boxes, boxes, keys, tolerance, cell).where(F.col(f"l_{node}") < F.col(f"r_{node}"))
    pairs = pairs.where(~G.contained(G.box("l_"), G.box("r_")))
    return pairs.select(*keys, F.col(f"l_{node}").alias("a"), F.col(f"r_{node}").alias("b"))


def _banded(boxes: DataFrame, keys: list[str], node: str, tolerance: float) -> DataFrame:
    """``keys, n, w, h`` and the sizes' bands on a logarithmic scale, as wide as the tolerance reaches."""
    sized = boxes.select(*keys, F.col(node).alias("n"), (F.col("x1") - F.col("x0")).alias("w"), (F.col("y1") - F.col("y0")).alias("h"))
    if tolerance >= 1.0:
        return sized.withColumn("__w", F.lit(0).cast("long")).withColumn("__h", F.lit(0).cast("long"))
    step = max(-math.log1p(-tolerance), 1e-3) if tolerance > 0 else 1e-3
    for c in ("w", "h"):
        sized = sized.withColumn(f"__{c}", F.floor(F.log(F.greatest(F.col(c), F.lit(1e-6))) / step))
    return sized


def _close(p: str | Column, q: str | Column, tolerance: float) -> Column:
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return F.abs(p - q) <= F.lit(float(tolerance)) * F.greatest(p, q, F.lit(1e-6))


def dimension_pairs(boxes: DataFrame, keys: list[str], node: str, tolerance: float) -> DataFrame:
    """Pairs whose widths and heights differ by at most ``tolerance`` relative to the larger.

    Sizes within the tolerance lie in the same or neighbouring bands of a logarithmic
    scale, which are the join keys; the exact test follows.
    """
    sized = _banded(boxes, keys, node, tolerance)
    left = sized.select(*keys, F.col("n").alias("a"), F.col("w").alias("wa"), F.col("h").alias("ha"), "__w", "__h")
    right = sized.select(*keys, F.col("n").alias("b"), F.col("w").alias("wb"), F.col("h").alias("hb"), "__w", "__h")
    if tolerance < 1.0:
        for c in ("__w", "__h"):
            right = right.withColumn(c, F.explode(F.array(*[F.col(c) + d for d in (-1, 0, 1)])))
    near = (F.col("a") < F.col("b")) & _close("wa", "wb", tolerance) & _close("ha", "hb", tolerance)
    return left.join(right, [*keys, "__w", "__h"]).where(near).select(*keys, "a", "b")


def dimension_links(boxes: DataFrame, keys: list[str], node: str, tolerance: float) -> DataFrame:
    """Edges ``keys, a, b`` (a < b) with the components of :func:`dimension_pairs`, linear in the boxes.

    A cell of bands whose extreme sizes are within the tolerance is one class, joined to
    its smallest node; of other cells (sizes about zero) every distinct size is a class.
    Distinct sizes of neighbouring cells are compared, and a pair of classes is one edge.
    """
    cell = [*keys, "__w", "__h"]
    sized = _banded(boxes, keys, node, tolerance)
    sizes = sized.groupBy(*cell, "w", "h").agg(F.min("n").alias("lead"))
    cells = sizes.groupBy(*cell).agg(
        F.min("lead").alias("cell_lead"),
        (_close(F.min("w"), F.max("w"), tolerance) & _close(F.min("h"), F.max("h"), tolerance)).alias("whole"),
    )
    classes = sizes.join(cells, cell).select(*cell, "w", "h", "whole", F.when(F.col("whole"), F.col("cell_lead")).otherwise(F.col("lead")).alias("rep"))
    stars = sized.join(classes, [*cell, "w", "h"]).select(*keys, F.col("rep").alias("a"), F.col("n").alias("b")).where("a < b")
    ahead = [F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 1), (1, -1), (1, 0), (1, 1))]
    itself = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))
    left = classes.select(*cell, F.col("w").alias("wa"), F.col("h").alias("ha"), F.col("rep").alias("ra"))
    probes = F.when(F.col("whole"), F.array(*ahead)).otherwise(F.array(itself, *ahead))
    right = classes.withColumn("o", F.explode(probes)).select(
        *keys, (F.col("__w") + F.col("o.x")).alias("__w"), (F.col("__h") + F.col("o.y")).alias("__h"),
        F.col("w").alias("wb"), F.col("h").alias("hb"), F.col("rep").alias("rb"),
    )
    near = (F.col("ra") != F.col("rb")) & _close("wa", "wb", tolerance) & _close("ha", "hb", tolerance)
    met = left.join(right, cell).where(near).select(*keys, F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
    return stars.unionByName(met)


def match_spans(words: DataFrame, spans: DataFrame, cell: float = CELL) -> DataFrame:
    """Each word with its best span: the one that covers the largest share of the word.

    ``words`` has ``ord`` and a box, ``spans`` ``span_ord``, ``font``, ``size``,
    ``dir_x``, ``dir_y`` and a box. Empty intersections do not count; the first span
    wins ties; a word without a span gets the fallback orientation.
    """
    page = page_keys(words)
    w = words.select(*page, "ord", "x0", "y0", "x1", "y1")
    s = spans.select(*page, "span_ord", "font", "size", "dir_x", "dir_y", "x0", "y0", "x1", "y1")
    pairs = near_pairs(w, s, page, F.lit(0.0), cell)
    l, r = G.box("l_"), G.box("r_")
    score = G.intersection_area(l, r) / F.greatest(G.area(l), F.lit(G.EPS))
    # the best span in one map-side combined aggregation: high score first, then low ordinal
    best = (
        pairs.withColumn("score", score)
        .where(F.col("score") > 0)
        .groupBy(*page, F.col("l_ord").alias("ord"))
        .agg(F.max(F.struct("score", (-F.col("r_span_ord")).alias("k"), "r_font", "r_size", "r_dir_x", "r_dir_y")).alias("m"))
    )
    out = words.join(best, [*page, "ord"], "left")
    return out.select(
        *words.columns,
        (-F.col("m.k")).alias("span_ord"),
        F.coalesce("m.r_font", F.lit("")).alias("font"),
        F.coalesce("m.r_size", F.lit(0.0)).alias("font_size"),
        F.coalesce("m.r_dir_x", F.lit(1.0)).alias("dir_x"),
        F.coalesce("m.r_dir_y", F.lit(0.0)).alias("dir_y"),
        F.when(F.col("m").isNull(), F.lit("fallback")).otherwise(F.lit("text-span")).alias("orientation_source"),
    )


#: Pairs compared at once, and bytes of pages unpacked at once; a page is never cut.
_PAIRS, _BYTES = 1 << 19, 1 << 20


def best_spans(words: np.ndarray, spans: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of each word's best span (-1: none) and its score, for the ``(rows, 4)`` boxes of one page.

    Spans whose extents share a power of two are sorted by where they begin; a word can
    only meet those that begin before its end and after the last whose predecessors all end
    before its start. Of the two axes the one with fewer such candidates is taken.
    """
    best, top = np.full(len(words), -1), np.zeros(len(words))
    live = np.flatnonzero((words[:, 2] > words[:, 0]) & (words[:, 3] > words[:, 1]))
    solid = np.flatnonzero((spans[:, 2] > spans[:, 0]) & (spans[:, 3] > spans[:, 1]))
    if not len(live) or not len(solid):
        return best, top
    w, s, rank_of = words[live], spans[solid], rank[solid]
    size = np.maximum((w[:, 2] - w[:, 0]) * (w[:, 3] - w[:, 1]), 1e-9)
    plans = []
    for a in (0, 1):
        ranges = []
        kinds = np.frexp(s[:, a + 2] - s[:, a])[1]
        for kind in np.unique(kinds):
            rows = np.flatnonzero(kinds == kind)
            rows = rows[np.argsort(s[rows, a], kind="stable")]
            first = np.searchsorted(np.maximum.accumulate(s[rows, a + 2]), w[:, a], "right")
            ranges.append((rows, first, np.maximum(np.searchsorted(s[rows, a], w[:, a + 2], "left") - first, 0)))
        plans.append((sum(int(n.sum()) for _, _, n in ranges), ranges))
    got, score = np.full(len(w), -1), np.zeros(len(w))
    for rows, first, n in min(plans, key=lambda p: p[0])[1]:
        ends = np.cumsum(n)
        at = 0
        while at < len(w):
            before = ends[at] - n[at]
            stop = max(at + 1, int(np.searchsorted(ends, before + _PAIRS, "right")))
            k = np.repeat(np.arange(at, stop), n[at:stop])
            j = rows[np.arange(len(k)) + np.repeat(first[at:stop] - (ends[at:stop] - n[at:stop] - before), n[at:stop])]
            at = stop
            dx = np.minimum(w[k, 2], s[j, 2]) - np.maximum(w[k, 0], s[j, 0])
            dy = np.minimum(w[k, 3], s[j, 3]) - np.maximum(w[k, 1], s[j, 1])
            meet = np.flatnonzero((dx > 0) & (dy > 0))
            k, j = k[meet], j[meet]
            share = dx[meet] * dy[meet] / size[k]
            order = np.lexsort((rank_of[j], -share, k))
            order = order[np.concatenate([[True], k[order][1:] != k[order][:-1]])] if len(order) else order
            k, j, share = k[order], j[order], share[order]
            better = (share > score[k]) | ((share == score[k]) & (share > 0) & (rank_of[j] < rank_of[got[k]]))
            got[k[better]], score[k[better]] = j[better], share[better]
    hit = got >= 0
    best[live[hit]], top[live[hit]] = solid[got[hit]], score[hit]
    return best, top


def _share_by_ord(ord_: np.ndarray, best: np.ndarray, top: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Words of one ordinal in a page - its text came in several rows - have their best span in common."""
    if not len(ord_) or (np.diff(ord_) > 0).all():
        return best
    order = np.lexsort((np.where(best < 0, 0, rank[best]) if len(rank) else best, -top, ord_))
    lead = np.concatenate([[True], ord_[order][1:] != ord_[order][:-1]])
    out = np.empty_like(best)
    out[order] = best[order][np.flatnonzero(lead)[np.cumsum(lead) - 1]]
    return out


def _cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and batch.nbytes > _BYTES:
        half = batch.num_rows // 2
        yield from _cut(batch.slice(0, half))
        yield from _cut(batch.slice(half))
    elif batch.num_rows:
        yield batch


def _boxes(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.float64) for c in ("x0", "y0", "x1", "y1")], axis=1)


def match_page_spans(pages: DataFrame, unpack: Callable[[pa.RecordBatch], tuple[pa.Table, pa.Table]], words: str, keep: Sequence[str] | None = None) -> DataFrame:
    """:func:`match_spans` for pages that come whole, a row each: nothing is dealt out, joined or sorted.

    ``unpack`` makes of some pages' rows their words and spans as flat tables whose column
    ``page`` counts those rows upwards; ``words`` is the schema of the words' other columns, of
    which ``keep`` come out. Spans without font, size or direction get ``flatten_spans``'
    defaults. A page without a key has no spans, as none joins it.
    """
    page = page_keys(pages)
    shown = [f for f in StructType.fromDDL(words).fields if keep is None or f.name in keep]
    names = [f.name for f in shown]
    found = ["span_ord", "font", "size", "dir_x", "dir_y"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _cut(whole)):
            w, s = unpack(batch)
            row, of = w.column("page").to_numpy(), s.column("page").to_numpy()
            boxes, sides = _boxes(w), _boxes(s)
            ord_, rank = w.column("ord").to_numpy(), s.column("span_ord").to_numpy()
            best = np.full(len(row), -1)
            known = np.ones(batch.num_rows, bool)
            for c in page:
                known &= batch.column(c).is_valid().to_numpy(zero_copy_only=False)
            count = np.arange(batch.num_rows + 1)
            wa, sa = np.searchsorted(row, count), np.searchsorted(of, count)
            for k in np.flatnonzero(known & (np.diff(wa) > 0) & (np.diff(sa) > 0)):
                a, b, c, d = wa[k], wa[k + 1], sa[k], sa[k + 1]
                hit, top = best_spans(boxes[a:b], sides[c:d], rank[c:d])
                hit = _share_by_ord(ord_[a:b], hit, top, rank[c:d])
                best[a:b] = np.where(hit < 0, -1, hit + c)
            spot = pa.array(best, mask=best < 0)
            columns = [batch.column(c).take(pa.array(row)) for c in page]
            columns += [w.column(c).combine_chunks() for c in names] + [s.column(c).combine_chunks().take(spot) for c in found]
            yield pa.RecordBatch.from_arrays(columns, names=[*page, *names, *found])

    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in [*[pages.schema[c] for c in page], *shown]]
    out = pages.mapInArrow(run, ", ".join([*kinds, "span_ord long, font string, size double, dir_x double, dir_y double"]))
    return out.select(
        *page, *names, "span_ord",
        F.coalesce("font", F.lit("")).alias("font"),
        F.coalesce("size", F.lit(0.0)).alias("font_size"),
        F.coalesce("dir_x", F.lit(1.0)).alias("dir_x"),
        F.coalesce("dir_y", F.lit(0.0)).alias("dir_y"),
        F.when(F.col("span_ord").isNull(), F.lit("fallback")).otherwise(F.lit("text-span")).alias("orientation_source"),
    )


def with_drawing_stats(paths: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Path count and box of each path's drawing, by one window over the drawing."""
    w = Window.partitionBy(*keys, seq)
    out = paths.withColumn("drawing_paths", F.count(F.lit(1)).over(w))
    for c, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max)):
        out = out.withColumn(f"drawing_{c}", f(c).over(w))
    return out
