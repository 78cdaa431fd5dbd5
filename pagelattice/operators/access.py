"""Spatial access: grid index, viewport queries, hit tests and view changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G

#: Bounds of the parity grid: cells an entry registers in, cells of a query, cell side.
ENTRY_CELLS, QUERY_CELLS, SIDE_LEAST, SIDE_MOST = 64, 4000, 1.0, 500.0


def grid_side(items: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, side``: the upper median of the items' longer sides, kept in 1..500."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    w = Window.partitionBy(*keys)
    ranked = items.select(*keys, side.alias("s")).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("r", F.row_number().over(w.orderBy("s")))
    middle = ranked.where(F.col("r") == F.floor(F.col("n") / 2) + 1)
    return middle.select(*keys, F.least(F.greatest(F.col("s"), F.lit(SIDE_LEAST)), F.lit(SIDE_MOST)).alias("side"))


def grid_index(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items with one row per cell they register in; items over 64 cells register in their centre cell."""
    sided = items.join(grid_side(items, keys), keys)

    def cell(v: Column) -> Column:
        return F.floor(v / F.col("side"))

    b = G.box()
    many = (cell(b["x1"]) - cell(b["x0"]) + 1) * (cell(b["y1"]) - cell(b["y0"]) + 1) > ENTRY_CELLS
    mid = {"x": cell((b["x0"] + b["x1"]) / 2), "y": cell((b["y0"] + b["y1"]) / 2)}

    def span(a: str) -> Column:
        return F.when(many, F.array(mid[a])).otherwise(F.sequence(cell(b[f"{a}0"]), cell(b[f"{a}1"])))

    return sided.withColumn("cell_x", F.explode(span("x"))).withColumn("cell_y", F.explode(span("y")))


def in_view(view: tuple[float, float, float, float]) -> Column:
    """Whether a box meets the closed rectangle; a plain range predicate that prunes Parquet row groups."""
    x0, y0, x1, y1 = map(float, view)
    return (F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0)


def viewport_query(items: DataFrame, view: tuple[float, float, float, float]) -> DataFrame:
    return items.where(in_view(view))


def viewport_query_parity(items: DataFrame, keys: list[str], view: tuple[float, float, float, float]) -> DataFrame:
    """As the grid answers: everything if the query covers over 4000 cells, else items met through their registered cells."""
    x0, y0, x1, y1 = map(float, view)
    indexed = grid_index(items, keys)

    def cell(v: float) -> Column:
        return F.floor(F.lit(v) / F.col("side"))

    all_of = (cell(x1) - cell(x0) + 1) * (cell(y1) - cell(y0) + 1) > QUERY_CELLS
    met = F.col("cell_x").between(cell(x0), cell(x1)) & F.col("cell_y").between(cell(y0), cell(y1)) & in_view(view)
    return indexed.where(all_of | met).select(*items.columns).distinct()


def view_rect(canvas: tuple[float, float, float, float], matrix: list[float], pad: float = 0.2) -> tuple[float, float, float, float]:
    """A canvas rectangle, padded on each side, in page space."""
    x0, y0, x1, y1 = canvas
    px, py = (x1 - x0) * pad, (y1 - y0) * pad
    a, b, c, d, e, f = G.inverse_matrix(matrix)
    points = [(a * x + c * y + e, b * x + d * y + f) for x in (x0 - px, x1 + px) for y in (y0 - py, y1 + py)]
    return min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)


def hit_test(groups: DataFrame, keys: list[str], x: float, y: float, tolerance: float, category: str = "category") -> DataFrame:
    """The first group of each key, by category and group id, with a member box within the tolerance of the point.

    ``groups`` has one row per member with ``category`` (a number that orders them),
    ``group_id`` and a box.
    """
    hit = (F.col("x0") - tolerance <= x) & (F.col("x1") + tolerance >= x) & (F.col("y0") - tolerance <= y) & (F.col("y1") + tolerance >= y)
    return groups.where(hit).groupBy(*keys).agg(F.min(F.struct(category, "group_id")).alias("m")).select(*keys, f"m.{category}", "m.group_id")


def topmost(items: DataFrame, keys: list[str], x: float, y: float, order: list[str]) -> DataFrame:
    """The last drawn item of each key whose closed box holds the point."""
    hit = (F.col("x0") <= x) & (F.col("x1") >= x) & (F.col("y0") <= y) & (F.col("y1") >= y)
    return items.where(hit).groupBy(*keys).agg(F.max(F.struct(*order)).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in order])


def viewport_delta(items: DataFrame, drawn: tuple, wanted: tuple, node: list[str]) -> DataFrame:
    """``node, change``: what a move of the view draws and deletes; two anti joins in one pass over the predicates."""
    was, now = F.coalesce(in_view(drawn), F.lit(False)), F.coalesce(in_view(wanted), F.lit(False))
    return items.where(was != now).select(*node, F.when(now, "draw").otherwise("delete").alias("change"))
