"""Embedding near-dedup: exact cosine threshold pairs by dual traversal of cover trees.

Unit vectors at cosine c are sqrt(2 - 2c) apart, so the threshold is a distance. The top
of the tree is laid over the cluster: seeded pivots (a bounded sample of each label) cut
a label into cells, cells are split into blocks of bounded size, and pairs of blocks
whose covering balls are too far apart are never made. Within a pair of blocks two cover
trees (nested nets of halving radii) are traversed together: node pairs farther apart
than their covering radii and the threshold are dropped, pairs within it are linked
wholesale, the others are opened down to exact cosines.

Equal vectors of a label are one weighted point. A task reports, per point, the number of
linked rows and one edge to its local component, so output is linear in its input
however many pairs link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.operators.components import connected_components
from pagelattice.runtime import materialize

COSINE = 0.98
BLOCK_ROWS = 2048
#: Bound of the pivot sample over all labels: it is sent to every executor.
MAX_PIVOTS = 8192
LEAF = 64
#: Distances from here on are accurate when taken from dot products.
FINE = 1e-4
#: Above the error of distances taken from dot products.
_SLACK = 1e-7


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; the largest component is divided out first, so no square overflows or vanishes."""
    rows = rows / np.abs(rows).max(axis=1, initial=0.0)[:, None]
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


class CoverTree:
    """Nested nets of halving radii over unit vectors; children stand together in arrays.

    ``points`` of a node are a slice of ``order``; its ``radius`` is the true largest
    distance from its centre to them.
    """

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[np.ndarray | None] = []
        if len(rows):
            self._grow(0, np.arange(len(rows)), 2.0)
        self.centres, self.radii = np.array(self.centre, np.int64), np.array(self.radius)
        self.size = np.array([len(m) for m in self.members], np.int64)

    def _add(self, centre: int, members: np.ndarray) -> int:
        self.centre.append(centre)
        self.members.append(members)
        gap = self.rows[members] - self.rows[centre]
        self.radius.append(float(np.sqrt(np.einsum("ij,ij->i", gap, gap).max())))
        self.children.append(None)
        return len(self.centre) - 1

    def _grow(self, centre: int, members: np.ndarray, scale: float) -> None:
        """Open nodes level by level: the net of the next radius holds the parent's centre.

        At small scales distances are taken from differences, which stay exact for vectors
        that dot products cannot tell apart. The radius of an opened node is above the next
        scale, so there it has two children at least and the tree ends.
        """
        todo = [(self._add(centre, members), scale)]
        while todo:
            node, scale = todo.pop()
            members = self.members[node]
            if len(members) <= LEAF or self.radius[node] <= 0.0:
                continue
            while scale / 2 >= self.radius[node]:
                scale /= 2
            scale /= 2
            points = self.rows[members]
            left = np.ones(len(members), bool)
            at, kids = int(np.flatnonzero(members == self.centre[node])[0]), []
            while True:
                near = left.copy()
                if scale > FINE:
                    near[left] = points[left] @ points[at] >= 1.0 - scale * scale / 2
                else:
                    gap = points[left] - points[at]
                    near[left] = np.sqrt(np.einsum("ij,ij->i", gap, gap)) <= scale
                near[at] = True
                left &= ~near
                kids.append(self._add(int(members[at]), members[near]))
                if not left.any():
                    break
                at = int(left.argmax())
            self.children[node] = np.array(kids)
            if len(kids) < len(members):
                todo += [(k, scale) for k in kids]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each point's component under the edges."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == label).all():
            break
        label = new
    return label


def dual_traverse(
    left: np.ndarray, right: np.ndarray, w_left: np.ndarray, w_right: np.ndarray, cosine: float, same: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Link weights of the points of two blocks and components over both.

    ``same``: the two are one block, whose pairs count once for either point and not for
    a point with itself. Returns (weight linked to each left point, to each right point,
    smallest point of each component with right points numbered after the left).
    """
    reach = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine)))
    ta, tb = CoverTree(left), None
    tb = ta if same else CoverTree(right)
    na, nb = len(left), len(right)
    got_a, got_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    label = np.arange(na if same else na + nb)
    shift = 0 if same else na
    heads, tails, held = [], [], 0

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label, heads, tails, held
        heads.append(i)
        tails.append(j + shift)
        held += len(i)
        if held > 1 << 20:
            settle()

    def settle() -> None:
        nonlocal label, heads, tails, held
        if held:
            known = np.flatnonzero(label != np.arange(len(label)))
            label = _forest(len(label), np.concatenate([known, *heads]), np.concatenate([label[known], *tails]))
            heads, tails, held = [], [], 0

    def exact(i: np.ndarray, j: np.ndarray, twice: bool) -> None:
        """All pairs of two sets of points; ``twice``: count for both sides of one block."""
        for s in range(0, len(i), 512):
            rows = i[s : s + 512]
            hit = left[rows] @ right[j].T >= cosine
            if same and not twice:
                hit &= rows[:, None] != j[None, :]
            if not hit.any():
                continue
            got_a[rows] += hit @ w_right[j]
            if twice or not same:
                np.add.at(got_a if same else got_b, j, w_left[rows] @ hit)
            x, y = np.nonzero(hit)
            join(rows[x], j[y])

    def whole(i: np.ndarray, j: np.ndarray) -> None:
        """Every pair of the two sets links."""
        got_a[i] += w_right[j].sum()
        np.add.at(got_a if same else got_b, j, w_left[i].sum())
        join(i, np.full(len(i), j[0]))
        join(np.full(len(j), i[0]), j)

    todo = [(0, 0)] if na and nb else []
    while todo:
        a, b = todo.pop()
        one = same and a == b
        if one and 2 * ta.radius[a] < reach - _SLACK:  # every pair within the node links
            i = ta.members[a]
            got_a[i] += w_left[i].sum() - w_left[i]
            join(i, np.full(len(i), i[0]))
            continue
        ca, cb = ta.children[a], tb.children[b]
        if (ca is None and cb is None) or len(ta.members[a]) * len(tb.members[b]) <= LEAF * LEAF:
            exact(ta.members[a], tb.members[b], twice=not one)
            continue
        open_a = np.array([a]) if ca is None else ca
        open_b = np.array([b]) if cb is None else cb
        for s in range(0, len(open_a), 512):
            part = open_a[s : s + 512]
            dots = left[ta.centres[part]] @ right[tb.centres[open_b]].T
            gaps = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots))
            radii = ta.radii[part][:, None] + tb.radii[open_b][None, :]
            keep = gaps <= radii + reach + _SLACK
            if one:
                keep &= (np.arange(s, s + len(part))[:, None] <= np.arange(len(open_b))[None, :])
            x, y = np.nonzero(keep)
            inside = gaps[x, y] + radii[x, y] < reach - _SLACK
            p, q = part[x], open_b[y]
            single = (ta.size[p] == 1) & (tb.size[q] == 1)
            if same:
                single &= p != q
            for u, v, all_in in zip(p[~single], q[~single], inside[~single]):
                if same and u == v:
                    if ta.size[u] > 1:
                        todo.append((u, v))
                elif all_in:
                    whole(ta.members[u], tb.members[v])
                else:
                    todo.append((u, v))
            if single.any():
                i, j = ta.centres[p[single]], tb.centres[q[single]]
                hit = np.einsum("ij,ij->i", left[i], right[j]) >= cosine
                i, j = i[hit], j[hit]
                np.add.at(got_a, i, w_right[j])
                np.add.at(got_a if same else got_b, j, w_left[i])
                join(i, j)
    settle()
    return got_a, got_b, label


def _valid(vec) -> F.Column:
    values = F.transform(vec, lambda x: x.cast("double"))
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(values, lambda x: x != 0), F.lit(False))


def _point(label, v) -> F.Column:
    """128 bits of hash, in hexadecimal, that stand for a vector of a label."""
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(k), label, v)), 16, "0") for k in (1, 2)])


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    block_rows: int = BLOCK_ROWS,
    max_pivots: int = MAX_PIVOTS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors``.

    Vectors link with other vectors of an equal non-null label and dimension at a cosine
    of ``cosine`` or more. Null, zero or non-finite vectors, and those with a null label,
    link with nothing. ``n_links`` counts linked rows, copies included, not the row
    itself. ``component_id`` is the smallest non-null id reachable. Rows with null ids
    link and count like others. Repeated rows are rows of their own. Other columns are
    ignored; an empty table gives no rows.

    ``max_pivots`` bounds the sample that is broadcast; it only shapes the cells. Every
    row is assigned to a cell and compared wherever the bounds allow a link.
    """
    if not -1.0 < cosine < 1.0:
        raise ValueError("the cosine must lie between -1 and 1")
    spark = vectors.sparkSession
    rows = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")
    )
    fit = rows.where(F.col("label").isNotNull() & _valid(F.col("v"))).withColumn("label", F.col("label").cast("string"))
    points = materialize(
        fit.groupBy("label", "v")
        .agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least_id"))
        .withColumn("point", _point("label", "v"))
        .withColumn("dim", F.size("v")),
        "points",
    )
    total = points.count()
    per_pivot = max(block_rows, -(-total // max_pivots))
    sample = points.where(F.pmod(F.xxhash64("point"), F.lit(per_pivot)) == 0).select("label", "dim", "v").limit(4 * max_pivots)
    pivots: dict[tuple[str, int], np.ndarray] = {}
    for r in sample.collect():
        pivots.setdefault((r["label"], r["dim"]), []).append(r["v"])
    shared = spark.sparkContext.broadcast({k: unit(np.array(sorted(v))) for k, v in pivots.items()})  # at most 4 * max_pivots vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            vs = batch.column(2)
            cell, gap = np.zeros(len(labels), np.int32), np.full(len(labels), 2.0)
            groups: dict = {}
            for i, key in enumerate(zip(labels, dims)):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                centres = shared.value.get(key)
                if centres is not None:
                    part = vs.take(pa.array(at))
                    x = unit(part.flatten().to_numpy(zero_copy_only=False).reshape(len(at), key[1]))
                    dots = x @ centres.T
                    cell[at] = dots.argmax(axis=1)
                    gap[at] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots.max(axis=1)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(5)), pa.array(cell), pa.array(gap)], names=["label", "dim", "v", "point", "w", "cell", "gap"]
            )

    schema = "label string, dim int, v array<double>, point string, w long, cell int, gap double"
    celled = materialize(points.select("label", "dim", "v", "point", "w").mapInArrow(assign, schema), "cells")
    key = ["label", "dim", "cell"]
    cells = celled.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("reach"))
    cells = cells.withColumn("parts", F.ceil(F.col("n") / F.lit(block_rows)).cast("int"))
    blocked = celled.join(cells.select(*key, "parts"), key).withColumn(
        "part", F.pmod(F.xxhash64(F.col("point"), F.lit(7)), F.col("parts")).cast("int")
    )
    limit = float(np.sqrt(2.0 - 2.0 * cosine)) + _SLACK

    def cell_pairs(a, b):
        """Whether the balls of two cells may hold a link; cells without a pivot may."""

        @F.pandas_udf("boolean")
        def near(label, dim, p, q, rp, rq):
            out = np.ones(len(label), bool)
            for (k, d), at in label.groupby([label, dim]).indices.items():
                centres = shared.value.get((k, int(d)))
                if centres is not None:
                    for s in range(0, len(at), 4096):
                        rows = at[s : s + 4096]
                        dots = np.einsum("ij,ij->i", centres[p.to_numpy()[rows]], centres[q.to_numpy()[rows]])
                        out[rows] = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * dots)) <= rp.to_numpy()[rows] + rq.to_numpy()[rows] + limit
            return type(p)(out)

        return near("label", "dim", "cell", "other", F.col(a), F.col(b))

    # one row per cell: the join is over pairs of cells of one label, never of rows
    others = cells.select("label", "dim", F.col("cell").alias("other"), F.col("reach").alias("reach_b"), F.col("parts").alias("parts_b"))
    paired = cells.select(*key, "reach", "parts").join(others, ["label", "dim"]).where(F.col("cell") <= F.col("other"))
    paired = paired.where(cell_pairs("reach", "reach_b"))
    paired = (
        paired.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("part_b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)))
        .where((F.col("cell") < F.col("other")) | (F.col("part") <= F.col("part_b")))
        .withColumn("pair", F.concat_ws("/", "dim", "cell", "part", "other", "part_b", "label"))
    )
    itself = (F.col("cell") == F.col("other")) & (F.col("part") == F.col("part_b"))
    sides = paired.select(
        "label", "dim", "pair", F.explode(F.when(itself, F.array(F.struct("cell", "part", F.lit(0).alias("side")))).otherwise(
            F.array(F.struct("cell", "part", F.lit(1).alias("side")), F.struct(F.col("other").alias("cell"), F.col("part_b").alias("part"), F.lit(2).alias("side")))
        )).alias("s"),
    ).select("label", "dim", "pair", "s.cell", "s.part", "s.side")
    tasks = blocked.join(sides, ["label", "dim", "cell", "part"]).select("pair", "side", "point", "w", "v")

    def traverse(table: pa.Table) -> pa.Table:
        side = table["side"].to_numpy()
        v, point, w = table["v"], table["point"].to_numpy(zero_copy_only=False), table["w"].to_numpy()
        where = [np.flatnonzero(side == k) for k in ((0, 0) if (side == 0).any() else (1, 2))]
        x = [unit(v.take(pa.array(k)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(k), -1)) if len(k) else np.empty((0, 1)) for k in where]
        same = where[0] is where[1] or bool((side == 0).any())
        if same:
            got, _, label = dual_traverse(x[0], x[0], w[where[0]], w[where[0]], cosine, True)
            ids = point[where[0]]
        else:
            a, b, label = dual_traverse(x[0], x[1], w[where[0]], w[where[1]], cosine, False) if len(x[0]) and len(x[1]) else (
                np.zeros(len(x[0]), np.int64), np.zeros(len(x[1]), np.int64), np.arange(len(point)))
            got, ids = np.concatenate([a, b]), np.concatenate([point[where[0]], point[where[1]]])
        hit = got > 0
        return pa.table({"point": pa.array(ids[hit], pa.string()), "links": got[hit], "to": pa.array(ids[label][hit], pa.string())})

    found = materialize(tasks.groupBy("pair").applyInArrow(traverse, "point string, links long, to string"), "links")
    comps = connected_components(found, "point", "to")
    counts = found.groupBy("point").agg(F.sum("links").alias("links"))
    named = (
        points.select("label", "v", "point", "w", "least_id")
        .join(counts, "point", "left")
        .join(comps.withColumnRenamed("node", "point"), "point", "left")
        .withColumn("component", F.coalesce("component", "point"))
    )
    named = materialize(named.select("point", "w", "least_id", "component", F.coalesce("links", F.lit(0)).alias("links")), "named")
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(least, "component").select(F.col("point").alias("p"), (F.col("links") + F.col("w") - 1).alias("n_links"), "component_id")
    fit = F.col("label").isNotNull() & _valid(F.col("v"))
    tagged = rows.select("vec_id", F.when(fit, _point(F.col("label").cast("string"), F.col("v"))).alias("p"))
    out = tagged.join(named, "p", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10_embed_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP10_SQL = f"""
WITH RECURSIVE ok AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= {COSINE}),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
comp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, comp.component_id,
  e.vec_id = comp.component_id AS kept
FROM embeddings e JOIN comp USING (vec_id)
"""
