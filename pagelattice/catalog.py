"""Registered queries of the page operators, each with the same result in DuckDB's SQL.

Every query runs over its whole tables. Results are flat columns; lists are joined texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G
from pagelattice.operators import access, aggregates, clustering, drawlist, facets, joins, scan, voting
from pagelattice.operators.clustering import BUCKET
from pagelattice.plans import chain
from pagelattice.sources import fixtures as X

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

_VIEWS = {
    "paths": X.PATHS_SQL, "pm": X.PAGES_SQL, "words": X.WORDS_SQL, "spans": X.SPANS_SQL, "readings": X.READINGS_SQL,
    "images": X.IMAGES_SQL, "items": X.ITEMS_SQL,
}
_NEEDS = {"spans": ["words"], "items": ["paths", "words", "images"]}


def _with(views: str, body: str, recursive: bool = False) -> str:
    """``body`` - more CTEs and a SELECT, or a SELECT - over the named views."""
    names: list[str] = []
    for v in views.split():
        for n in [*_NEEDS.get(v, []), v]:
            if n not in names:
                names.append(n)
    head = ", ".join(f"{n} AS ({_VIEWS[n]})" for n in names)
    rest = body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{'' if rest.upper().startswith('SELECT') else ','} {rest}"


def register(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- pages and words -------------------------------------------------------------------


@register("page_prune", _with("pm", "SELECT page_index, page_number, rotation FROM pm WHERE page_index = 3"))
def _page_prune(spark, sf):
    return scan.page_metadata(scan.prune_pages(X.page_meta(spark, sf), 3)).select("page_index", "page_number", "rotation")


@register("page_meta", _with("pm", "SELECT * FROM pm"))
def _page_meta(spark, sf):
    return scan.page_metadata(X.page_meta(spark, sf))


@register("page_lookup", _with("pm", "SELECT page_index, page_number, (SELECT count(*) FROM pm) AS page_count FROM pm WHERE page_index IN (0, 2, 5)"))
def _page_lookup(spark, sf):
    pages = scan.page_metadata(X.page_meta(spark, sf))
    count = pages.agg(F.count(F.lit(1)).alias("page_count"))
    return scan.lookup_pages(pages, [0, 2, 5]).select("page_index", "page_number").join(F.broadcast(count))  # one row


_ORDERED = "ordered AS (SELECT *, row_number() OVER (PARTITION BY page_index ORDER BY round_even(y0, 0), x0, ord) - 1 AS seq FROM words)"


@register("word_reading_order", _with("words", f"{_ORDERED} SELECT page_index, ord, seq, x0, y0 FROM ordered"))
def _reading_order(spark, sf):
    return scan.reading_order(X.words(spark, sf)).select("page_index", "ord", "seq", "x0", "y0")


@register("native_head", _with("words", f"{_ORDERED} SELECT page_index, seq, text, n FROM (SELECT *, count(*) OVER (PARTITION BY page_index) AS n FROM ordered) WHERE seq < 10"))
def _native_head(spark, sf):
    words = X.words(spark, sf)
    total = words.groupBy("page_index").agg(F.count(F.lit(1)).alias("n"))
    return scan.reading_order(words).where("seq < 10").join(total, "page_index").select("page_index", "seq", "text", "n")


@register("span_flatten", _with("spans", "SELECT page_index, span_ord, x0, y0, x1, y1, text, font, size, dir_x, dir_y FROM spans"))
def _span_flatten(spark, sf):
    return scan.flatten_spans(X.raw_spans(spark, sf)).drop("flags")


_MATCH = """
scored AS (SELECT w.page_index, w.ord, s.span_ord, s.font, s.size, s.dir_x, s.dir_y,
    (least(w.x1, s.x1) - greatest(w.x0, s.x0)) * (least(w.y1, s.y1) - greatest(w.y0, s.y0))
      / greatest((w.x1 - w.x0) * (w.y1 - w.y0), 1e-9::DOUBLE) AS score
  FROM words w JOIN spans s ON w.page_index = s.page_index AND s.x0 < w.x1 AND w.x0 < s.x1 AND s.y0 < w.y1 AND w.y0 < s.y1),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY page_index, ord ORDER BY score DESC, span_ord) = 1),
matched AS (SELECT w.*, b.span_ord, coalesce(b.font, '') AS font, coalesce(b.size, 0) AS font_size, coalesce(b.dir_x, 1) AS dir_x,
    coalesce(b.dir_y, 0) AS dir_y, CASE WHEN b.ord IS NULL THEN 'fallback' ELSE 'text-span' END AS orientation_source
  FROM words w LEFT JOIN best b ON w.page_index = b.page_index AND w.ord = b.ord)
"""


def _matched(spark, sf, *keep):
    return joins.match_page_spans(X.whole_pages(spark, sf), X.unpack_pages, X.WORD_SCHEMA, keep)


@register("word_span_match", _with("words spans", f"{_MATCH} SELECT page_index, ord, span_ord, font, font_size, dir_x, dir_y, orientation_source FROM matched"))
def _word_span_match(spark, sf):
    return _matched(spark, sf, "ord").select("page_index", "ord", "span_ord", "font", "font_size", "dir_x", "dir_y", "orientation_source")


_ANGLE = "CASE WHEN abs(dir_x) < 1e-9 AND abs(dir_y) < 1e-9 THEN 0 ELSE degrees(atan2(dir_y, dir_x)) END"


@register(
    "overlay_text",
    _with("words spans", f"""{_MATCH} SELECT page_index, ord, text, CASE WHEN orientation_source = 'text-span' THEN 'quad' ELSE 'rect' END AS shape,
  round_even(CASE WHEN orientation_source = 'text-span' THEN {_ANGLE} ELSE 0 END, 3) AS angle, dir_x, dir_y, font_size, font,
  x0 AS x, y0 AS y, x1 - x0 AS width, y1 - y0 AS height, (x1 - x0) * (y1 - y0) AS area,
  CASE WHEN abs(y1 - y0) > 1e-9 THEN round_even((x1 - x0) / (y1 - y0), 4) END AS aspect_ratio FROM matched"""),
)
def _overlay_text(spark, sf):
    return scan.overlay_text(_matched(spark, sf, "ord", "text", *G.box()))


_QUAD = """
unit AS (SELECT *, dir_x AS ux, dir_y AS uy FROM matched),
extents AS (SELECT *, least(x0*ux+y0*uy, x1*ux+y0*uy, x0*ux+y1*uy, x1*ux+y1*uy) AS a0, greatest(x0*ux+y0*uy, x1*ux+y0*uy, x0*ux+y1*uy, x1*ux+y1*uy) AS a1,
  least(y0*ux-x0*uy, y0*ux-x1*uy, y1*ux-x0*uy, y1*ux-x1*uy) AS c0, greatest(y0*ux-x0*uy, y0*ux-x1*uy, y1*ux-x0*uy, y1*ux-x1*uy) AS c1 FROM unit),
quads AS (SELECT page_index, ord, a0*ux-c0*uy+0 AS ul_x, a0*uy+c0*ux+0 AS ul_y, a1*ux-c0*uy+0 AS ur_x, a1*uy+c0*ux+0 AS ur_y,
  a1*ux-c1*uy+0 AS lr_x, a1*uy+c1*ux+0 AS lr_y, a0*ux-c1*uy+0 AS ll_x, a0*uy+c1*ux+0 AS ll_y FROM extents)
"""


def _quads(spark, sf):
    return _matched(spark, sf, "ord", *G.box()).select(
        "page_index", "ord", G.oriented_quad(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("dir_x"), F.col("dir_y")).alias("q")
    )


@register("oriented_quad", _with("words spans", f"{_MATCH}, {_QUAD} SELECT * FROM quads"))
def _oriented_quad(spark, sf):
    names = [(f"{n}_{a}", i, a) for i, n in enumerate(("ul", "ur", "lr", "ll")) for a in ("x", "y")]
    return _quads(spark, sf).select("page_index", "ord", *[(F.col("q")[i][a] + F.lit(0.0)).alias(n) for n, i, a in names])


@register("quad_metrics", _with("words spans", f"""{_MATCH}, {_QUAD} SELECT page_index, ord,
  round_even(CASE WHEN abs(ur_x-ul_x) < 1e-9 AND abs(ur_y-ul_y) < 1e-9 THEN 0 ELSE degrees(atan2(ur_y-ul_y, ur_x-ul_x)) END, 3) AS angle,
  round_even(sqrt(pow(ur_x-ul_x, 2)+pow(ur_y-ul_y, 2)), 3) AS width, round_even(sqrt(pow(ll_x-ul_x, 2)+pow(ll_y-ul_y, 2)), 3) AS height FROM quads"""))
def _quad_metrics(spark, sf):
    corners = F.array(*[F.struct((F.col("q")[i]["x"] + 0.0).alias("x"), (F.col("q")[i]["y"] + 0.0).alias("y")) for i in range(4)])
    rows = _quads(spark, sf).select("page_index", "ord", corners.alias("q"))  # a lambda would be interpreted, with all that it reads
    return rows.select("page_index", "ord", *[v.alias(k) for k, v in G.quad_metadata(F.col("q")).items()])


# -- paths and scalar geometry ----------------------------------------------------------

_KNOWN = "known AS (SELECT * FROM paths WHERE item_index % 7 <> 5)"
_POINTS = """CASE kind WHEN 'qu' THEN 4 WHEN 'c' THEN 4 ELSE 2 END AS n_points"""


@register("path_extract", _with("paths", f"""{_KNOWN} SELECT page_index, seq, item_index, kind, layer,
  CASE WHEN has_stroke THEN '0.5,0.25,0.0' END AS stroke, dashes, stroke_width, x0, y0, x1, y1, {_POINTS} FROM known"""))
def _path_extract(spark, sf):
    out = scan.extract_paths(X.raw_drawings(spark, sf))
    return out.select(
        "page_index", "seq", "item_index", "kind", "layer", F.array_join(F.col("stroke_color").cast("array<string>"), ",").alias("stroke"), "dashes",
        "stroke_width", "x0", "y0", "x1", "y1", F.size("points").alias("n_points"),
    )


_W, _H = "(x1 - x0)", "(y1 - y0)"


@register("drawing_metrics", _with("paths", f"""
counted AS (SELECT *, CAST(count(*) OVER (PARTITION BY page_index, seq) AS INTEGER) AS operation_count FROM paths)
SELECT page_index, seq, item_index, kind, operation_count,
  CASE kind WHEN 'l' THEN round_even(CASE WHEN {_W} < 1e-9 AND {_H} < 1e-9 THEN 0 ELSE degrees(atan2({_H}, {_W})) END, 3)
            WHEN 'qu' THEN CAST(0 AS DOUBLE) END AS angle,
  CASE kind WHEN 'l' THEN round_even(sqrt({_W}*{_W}+{_H}*{_H}), 3) WHEN 'c' THEN round_even({_H} + sqrt({_W}*{_W}+{_H}*{_H}) + {_H}, 3) END AS length,
  CASE WHEN kind IN ('qu', 're') THEN {_W} END AS width, CASE WHEN kind IN ('qu', 're') THEN {_H} END AS height,
  CASE WHEN kind = 're' THEN {_W}*{_H} END AS area FROM counted WHERE item_index % 7 <> 5"""))
def _drawing_metrics(spark, sf):
    return scan.drawing_metrics(scan.extract_paths(X.raw_drawings(spark, sf)))


@register("line_metrics", _with("paths", f"""SELECT page_index, path_id,
  round_even(CASE WHEN {_W} < 1e-9 AND {_H} < 1e-9 THEN 0 ELSE degrees(atan2({_H}, {_W})) END, 6) AS angle,
  round_even(sqrt({_W}*{_W}+{_H}*{_H}), 6) AS length FROM paths WHERE kind = 'l'"""))
def _line_metrics(spark, sf):
    b = G.box()
    return X.paths(spark, sf).where("kind = 'l'").select(
        "page_index", "path_id", F.bround(G.point_angle(*b.values()), 6).alias("angle"), F.bround(G.line_length(*b.values()), 6).alias("length")
    )


@register("curve_polygon_length", _with("paths", f"SELECT page_index, path_id, round_even({_H} + sqrt({_W}*{_W}+{_H}*{_H}) + {_H}, 6) AS length FROM paths WHERE kind = 'c'"))
def _curve_length(spark, sf):
    points = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x0", "y1"), ("x1", "y0"), ("x1", "y1"))])
    return X.paths(spark, sf).where("kind = 'c'").select("page_index", "path_id", F.bround(G.path_length(points), 6).alias("length"))


@register("rect_metrics", _with("paths", f"""SELECT page_index, path_id, x0 AS x, y0 AS y, {_W} AS width, {_H} AS height, {_W}*{_H} AS area,
  CASE WHEN {_H} > 1e-9 THEN round_even({_W}/{_H}, 4) END AS aspect_ratio FROM paths"""))
def _rect_metrics(spark, sf):
    rect = G.rect_metadata(*G.box().values())
    return X.paths(spark, sf).select("page_index", "path_id", *[v.alias(k) for k, v in rect.items()])


@register("color_round", _with("paths", "SELECT page_index, path_id, CASE WHEN has_stroke THEN '0.333,0.667,1.0' END AS color FROM paths"))
def _color_round(spark, sf):
    raw = F.when(F.size("stroke_color") > 0, F.array(F.lit(1 / 3), F.lit(2 / 3), F.lit(0.99996)))
    return X.paths(spark, sf).select("page_index", "path_id", F.array_join(G.round_color(raw).cast("array<string>"), ",").alias("color"))


@register("is_dashed", _with("paths", "SELECT page_index, path_id, coalesce(dashes, '') <> '' AND NOT starts_with(trim(dashes), '[]') AS dashed FROM (SELECT page_index, path_id, coalesce(dashes, '') AS dashes FROM paths)"))
def _is_dashed(spark, sf):
    return X.paths(spark, sf).select("page_index", "path_id", G.is_dashed(F.col("dashes")).alias("dashed"))


@register("color_hex", _with("paths", "SELECT page_index, path_id, CASE WHEN has_stroke THEN '#804000' ELSE '#111827' END AS path_hex, CASE WHEN has_stroke THEN '#804000' ELSE '#000000' END AS rgb_hex FROM paths"))
def _color_hex(spark, sf):
    return X.paths(spark, sf).select(
        "page_index", "path_id", G.path_color_hex(F.col("stroke_color"), F.col("fill_color")).alias("path_hex"),
        G.rgb_to_hex(F.coalesce("stroke_color", F.array().cast("array<double>"))).alias("rgb_hex"),
    )


@register("text_color", """SELECT p_partkey AS xref, (p_partkey * 7919 % 16777216 // 65536) / 255.0::DOUBLE AS r,
  (p_partkey * 7919 % 65536 // 256) / 255.0::DOUBLE AS g, (p_partkey * 7919 % 256) / 255.0::DOUBLE AS b FROM part""")
def _text_color(spark, sf):
    packed = F.expr("cast(xref * 7919 % 16777216 as int)")
    return X.image_placements(spark, sf).select("xref", *[c.alias(n) for c, n in zip(G.text_color(packed), "rgb")])


@register("quarter_rotation", "SELECT p_partkey AS xref, CAST(((round_even((p_partkey % 720 - 360) / 90.0::DOUBLE, 0)::INTEGER % 4) + 4) % 4 * 90 AS INTEGER) AS rotation FROM part")
def _quarter(spark, sf):
    return X.image_placements(spark, sf).select("xref", G.nearest_quarter(F.expr("cast(xref % 720 - 360 as double)")).alias("rotation"))


@register("matrix_metrics", """
WITH m AS (SELECT p_partkey AS xref, CAST(p_partkey % 13 - 6 AS DOUBLE) AS a, CAST(p_partkey % 7 - 3 AS DOUBLE) AS b,
  CAST(p_partkey % 5 - 2 AS DOUBLE) AS c, CAST(p_partkey % 11 - 5 AS DOUBLE) AS d FROM part)
SELECT xref, round_even(degrees(atan2(b, a)), 6) + 0 AS rotation, round_even(sqrt(a*a+b*b), 6) AS scale_x, round_even(sqrt(c*c+d*d), 6) AS scale_y,
  round_even(a / 3, 5) + 0 AS a3 FROM m""")
def _matrix_metrics(spark, sf):
    m = X.image_placements(spark, sf).selectExpr(
        "xref", "cast(xref % 13 - 6 as double) as a", "cast(xref % 7 - 3 as double) as b", "cast(xref % 5 - 2 as double) as c", "cast(xref % 11 - 5 as double) as d"
    )
    sx, sy = G.matrix_scale(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return m.select(
        "xref", (F.bround(G.matrix_rotation(F.col("a"), F.col("b")), 6) + 0.0).alias("rotation"), F.bround(sx, 6).alias("scale_x"),
        F.bround(sy, 6).alias("scale_y"), (G.format_matrix(F.array(F.col("a") / 3))[0] + 0.0).alias("a3"),
    )


@register("text_normalize", r"SELECT event_id, lower(trim(regexp_replace('  ' || event_type || '   X' || chr(9) || 'y ', '\s+', ' ', 'g'))) AS norm FROM events")
def _text_normalize(spark, sf):
    return X.table(spark, sf, "events").select(
        "event_id", G.normalize_text(F.concat(F.lit("  "), F.col("event_type"), F.lit("   X\ty "))).alias("norm")
    )


@register("overlap_tolerance", _with("pm", "SELECT page_index, greatest(0.005::DOUBLE * least(width * (page_index % 9), height * 5), 3) AS tolerance FROM pm"))
def _tolerance(spark, sf):
    return X.page_meta(spark, sf).select("page_index", G.overlap_tolerance(F.col("width") * (F.col("page_index") % 9), F.col("height") * 5).alias("tolerance"))


@register("affine_transform", _with("paths", """SELECT page_index, path_id, least(2*x0 - 3*y0, 2*x0 - 3*y1, 2*x1 - 3*y0, 2*x1 - 3*y1) + 5 AS x0,
  least(x0 + y0, x0 + y1, x1 + y0, x1 + y1) - 7 AS y0, greatest(2*x0 - 3*y0, 2*x0 - 3*y1, 2*x1 - 3*y0, 2*x1 - 3*y1) + 5 AS x1,
  greatest(x0 + y0, x0 + y1, x1 + y0, x1 + y1) - 7 AS y1 FROM paths"""))
def _affine(spark, sf):
    new = G.transform_box(G.box(), [2, 1, -3, 1, 5, -7])
    return X.paths(spark, sf).select("page_index", "path_id", *[v.alias(k) for k, v in new.items()])


_DISPLAY = """
shown AS (SELECT p.page_index, path_id, rotation, x0, y0, x1, y1 FROM paths p JOIN pm USING (page_index))
SELECT page_index, path_id,
  2 * CASE rotation WHEN 0 THEN x0 WHEN 90 THEN 200 - y1 WHEN 180 THEN 200 - x1 ELSE y0 END AS x0,
  2 * CASE rotation WHEN 0 THEN y0 WHEN 90 THEN x0 WHEN 180 THEN 200 - y1 ELSE 200 - x1 END AS y0,
  2 * CASE rotation WHEN 0 THEN x1 WHEN 90 THEN 200 - y0 WHEN 180 THEN 200 - x0 ELSE y1 END AS x1,
  2 * CASE rotation WHEN 0 THEN y1 WHEN 90 THEN x1 WHEN 180 THEN 200 - y0 ELSE 200 - x0 END AS y1 FROM shown
"""


@register("display_transform", _with("paths pm", _DISPLAY))
def _display(spark, sf):
    rows = X.paths(spark, sf).select("page_index", "path_id", "x0", "y0", "x1", "y1").join(scan.page_metadata(X.page_meta(spark, sf)), "page_index")
    new = G.transform_box(G.box(), G.display_matrix(F.col("rotation"), F.col("width"), F.col("height"), 2.0))
    return rows.select("page_index", "path_id", *[(v + 0.0).alias(k) for k, v in new.items()])


@register("geometry_points", _with("paths", """SELECT page_index, path_id, CASE kind WHEN 'l' THEN 2 ELSE 4 END AS n_points, CASE kind WHEN 'qu' THEN x1 ELSE x0 END AS first_x,
  CASE kind WHEN 'l' THEN y1 WHEN 'qu' THEN y0 ELSE y1 END AS last_y FROM paths"""))
def _geometry_points(spark, sf):
    def points(*names):
        return F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in names])

    quad = F.when(F.col("kind") == "qu", points(("x1", "y1"), ("x1", "y0"), ("x0", "y1"), ("x0", "y0")))
    line = F.when(F.col("kind") == "l", points(("x0", "y0"), ("x1", "y1")))
    found = G.geometry_points(quad, line, G.box())
    return X.paths(spark, sf).select(
        "page_index", "path_id", F.size(found).alias("n_points"), found[0]["x"].alias("first_x"), F.element_at(found, -1)["y"].alias("last_y")
    )


@register("item_metadata", _with("paths", """
SELECT page_index, path_id, concat_ws(chr(10), 'kind: ' || kind, 'shape: path',
  'bbox: ' || concat_ws(', ', round_even(x0, 2), round_even(y0, 2), round_even(x1, 2), round_even(y1, 2)),
  'fill_rule: ' || fill_rule, 'label: ' || layer) AS shown FROM paths"""))
def _item_metadata(spark, sf):
    items = X.paths(spark, sf).select(
        "page_index", "path_id", F.col("kind").alias("item_kind"), "x0", "y0", "x1", "y1", F.col("layer").alias("label"),
        F.create_map(F.lit("fill_rule"), F.col("fill_rule"), F.lit("shape"), F.lit("path")).alias("metadata"),
    )
    return scan.item_metadata(items).select("page_index", "path_id", scan.format_metadata(F.col("metadata"), ["kind", "shape"]).alias("shown"))


_GAP2 = "(pow(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2))"


@register("rect_gap", _with("paths", """
nxt AS (SELECT *, lead(x0) OVER w AS nx0, lead(y0) OVER w AS ny0, lead(x1) OVER w AS nx1, lead(y1) OVER w AS ny1 FROM paths WINDOW w AS (PARTITION BY page_index ORDER BY path_id))
SELECT page_index, path_id, round_even(sqrt(pow(greatest(x0 - nx1, nx0 - x1, 0), 2) + pow(greatest(y0 - ny1, ny0 - y1, 0), 2)), 6) AS gap FROM nxt WHERE nx0 IS NOT NULL"""))
def _rect_gap(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("page_index").orderBy("path_id")
    rows = X.paths(spark, sf).select("page_index", "path_id", *G.box().values(), *[F.lead(c).over(w).alias(f"n{c}") for c in G.box()])
    return rows.where("nx0 is not null").select("page_index", "path_id", F.bround(G.rect_gap(G.box(), G.box("n")), 6).alias("gap"))


@register("bbox_union", _with("paths", "SELECT page_index, layer_key, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM paths GROUP BY ALL"))
def _bbox_union(spark, sf):
    return X.paths(spark, sf).groupBy("page_index", "layer_key").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


@register("image_metrics", _with("images", """SELECT xref, x1 AS display_width, y1 AS display_height, x1 * y1 AS display_area,
  CASE WHEN width_px > 0 AND height_px > 0 THEN width_px * height_px END AS pixel_count,
  CASE WHEN height_px > 0 THEN round_even(width_px / height_px, 4) END AS aspect_ratio,
  coalesce(colorspace_name, CAST(n_components AS VARCHAR)) AS colorspace, has_mask,
  CASE WHEN x1 > 0 THEN CAST(CASE quarter WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 ELSE -90 END AS DOUBLE) END AS rotation,
  CASE WHEN x1 > 0 THEN round_even(width_px / x1 * 72, 2) END AS dpi_x, CASE WHEN y1 > 0 THEN round_even(height_px / y1 * 72, 2) END AS dpi_y,
  compressed_bytes, round_even(compressed_bytes / 1024, 2) AS compressed_kb FROM images"""))
def _image_metrics(spark, sf):
    return scan.image_metrics(X.image_placements(spark, sf))


@register("annot_items", _with("images", """SELECT xref, CAST(0 AS DOUBLE) AS x, x1 AS width, y1 AS height, x1 * y1 AS area,
  CASE WHEN y1 > 0 THEN round_even(x1 / y1, 4) END AS aspect_ratio,
  CASE WHEN colorspace_name IS NOT NULL THEN 1 ELSE 0 END + 1 AS n_attributes, colorspace_name AS author FROM images"""))
def _annot_items(spark, sf):
    rows = X.image_placements(spark, sf).selectExpr(
        "0L as page_index", "xref", "'note' as kind", "x0", "y0", "x1", "y1", "colorspace_name as author", "cast(null as string) as contents",
        "cast(null as string) as subject", "1.0D as opacity", "cast(null as string) as created", "cast(null as string) as modified",
    )
    return scan.annotation_items(rows).select(
        "xref", "x", "width", "height", "area", "aspect_ratio", F.size("attributes").alias("n_attributes"), F.col("attributes")["author"].alias("author")
    )


# -- filters, pairs, clustering -----------------------------------------------------------

_B = "page_index, layer_key, color_key"
_ON = "a.page_index = b.page_index AND a.layer_key = b.layer_key AND a.color_key = b.color_key"
_AREA = "greatest(x1 - x0, 0) * greatest(y1 - y0, 0)"
_ROWS = f"{_B}, path_id, group_id"
_INTER = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0)"
_AA, _AB = "((a.x1 - a.x0) * (a.y1 - a.y0))", "((b.x1 - b.x0) * (b.y1 - b.y0))"
_APART = f"NOT ({_INTER} > 0 AND {_AA} > 0 AND {_AB} > 0 AND ({_INTER} >= {_AA} - 1e-9 OR {_INTER} >= {_AB} - 1e-9))"
_NEAR8 = f"{_GAP2} <= 64"
_OVERLAP = f"{_GAP2} <= 9 AND {_APART}"
_ALIKE = (
    "abs((a.x1-a.x0)-(b.x1-b.x0)) <= 0.35::DOUBLE * greatest(a.x1-a.x0, b.x1-b.x0, 1e-6::DOUBLE) "
    "AND abs((a.y1-a.y0)-(b.y1-b.y0)) <= 0.35::DOUBLE * greatest(a.y1-a.y0, b.y1-b.y0, 1e-6::DOUBLE)"
)


def _components(name: str, nodes: str, node: str, test: str) -> str:
    """CTEs that end in ``name_c (bucket, n, c)``: components of the nodes under a test."""
    return f"""
{name}_n AS (SELECT {_B}, {node} AS n, x0, y0, x1, y1 FROM {nodes}),
{name}_e AS (SELECT a.page_index, a.layer_key, a.color_key, a.n AS a, b.n AS b FROM {name}_n a JOIN {name}_n b ON {_ON} AND a.n <> b.n AND {test}),
{name}_r({_B}, n, r) AS (SELECT {_B}, n, n FROM {name}_n UNION SELECT a.page_index, a.layer_key, a.color_key, a.n, b.b FROM {name}_r a JOIN {name}_e b ON {_ON} AND a.r = b.a),
{name}_c AS (SELECT {_B}, n, min(r) AS c FROM {name}_r GROUP BY {_B}, n)"""


def _merged(name: str, rows: str, node: str, test: str) -> str:
    """CTE ``name``: the rows with the group ids of their nodes' components."""
    if node == "path_id":
        nodes = rows
        head = ""
    else:
        nodes = f"{name}_g"
        head = f"{name}_g AS (SELECT {_B}, group_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM {rows} GROUP BY {_B}, group_id),"
    return f"""{head}{_components(name, nodes, node, test)},
{name} AS (SELECT a.* EXCLUDE (group_id), b.c AS group_id FROM {rows} a JOIN {name}_c b ON {_ON} AND a.{node} = b.n)"""


_START = f"start AS (SELECT *, path_id AS group_id, count(*) OVER (PARTITION BY {_B}, seq) AS drawing_paths FROM paths)"
_SPATIAL = f"{_START}, {_merged('sp', 'start', 'path_id', _NEAR8)}"


def _start(spark, sf):
    return clustering.singletons(joins.with_drawing_stats(X.paths(spark, sf), BUCKET))


def _spatial(spark, sf):
    return clustering.cluster_spatial(_start(spark, sf))


def _rows(df):
    return df.select(*BUCKET, "path_id", "group_id")


_ALONE = f"count(*) OVER (PARTITION BY {_B}, seq) = 1 AND kind IN ('re', 'qu')"


@register("filter_layout_panels", _with("paths", f"SELECT {_B}, path_id FROM (SELECT *, {_ALONE} AS gone FROM paths) WHERE NOT gone"))
def _f_panels(spark, sf):
    return clustering.filter_layout_panels(_start(spark, sf))[0].select(*BUCKET, "path_id")


@register("filter_large_bbox", _with("paths", f"SELECT {_B}, path_id FROM paths WHERE {_AREA} <= 0.2::DOUBLE * 40000"))
def _f_large(spark, sf):
    return clustering.filter_large_bbox(_start(spark, sf), X.page_meta(spark, sf))[0].select(*BUCKET, "path_id")


def _group_filter(rows: str, test: str) -> str:
    return f"""(SELECT {rows}.*, min(x0) OVER g AS gx0, min(y0) OVER g AS gy0, max(x1) OVER g AS gx1, max(y1) OVER g AS gy1
  FROM {rows} WINDOW g AS (PARTITION BY {_B}, group_id)) WHERE {test}"""


_GROUP_OK = "greatest(gx1 - gx0, 0) * greatest(gy1 - gy0, 0) <= 0.2::DOUBLE * 40000"
_GW, _GH = "greatest(gx1 - gx0, 1e-6::DOUBLE)", "greatest(gy1 - gy0, 1e-6::DOUBLE)"
_RATIO_OK = f"greatest({_GW}, {_GH}) / least({_GW}, {_GH}) <= 10"


@register("filter_large_group_bbox", _with("paths", f"{_SPATIAL} SELECT {_ROWS} FROM {_group_filter('sp', _GROUP_OK)}", True))
def _f_group(spark, sf):
    return _rows(clustering.filter_large_group_bbox(_spatial(spark, sf), X.page_meta(spark, sf))[0])


@register("filter_aspect_ratio", _with("paths", f"{_SPATIAL} SELECT {_ROWS} FROM {_group_filter('sp', _RATIO_OK)}", True))
def _f_ratio(spark, sf):
    return _rows(clustering.filter_aspect_ratio(_spatial(spark, sf))[0])


def _boxes(spark, sf):
    return X.paths(spark, sf).select(*BUCKET, "path_id", "x0", "y0", "x1", "y1")


def _pairs_sql(test: str) -> str:
    return _with("paths", f"SELECT a.page_index, a.layer_key, a.color_key, a.path_id AS a, b.path_id AS b FROM paths a JOIN paths b ON {_ON} AND a.path_id < b.path_id AND {test}")


@register("spatial_pairs", _pairs_sql(_NEAR8))
def _spatial_pairs(spark, sf):
    return joins.spatial_pairs(_boxes(spark, sf), BUCKET, "path_id", 8.0)


@register("overlap_pairs", _pairs_sql(_OVERLAP))
def _overlap_pairs(spark, sf):
    return joins.overlap_pairs(_boxes(spark, sf), BUCKET, "path_id", F.lit(3.0))


@register("dimension_pairs", _pairs_sql(_ALIKE))
def _dimension_pairs(spark, sf):
    return joins.dimension_pairs(_boxes(spark, sf), BUCKET, "path_id", 0.35)


@register("item_stats", _with("paths", f"SELECT {_B}, seq, count(*) AS n_paths, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM paths GROUP BY {_B}, seq"))
def _item_stats(spark, sf):
    return X.paths(spark, sf).groupBy(*BUCKET, "seq").agg(
        F.count(F.lit(1)).alias("n_paths"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


@register("connected_components", _with("paths", f"{_START}, {_components('cc', 'start', 'path_id', _NEAR8)} SELECT {_B}, n AS node, c AS component FROM cc_c WHERE n IN (SELECT a FROM cc_e b WHERE b.page_index = cc_c.page_index AND b.layer_key = cc_c.layer_key AND b.color_key = cc_c.color_key)", True))
def _connected(spark, sf):
    return clustering.components(joins.spatial_pairs(_boxes(spark, sf), BUCKET, "path_id", 8.0), BUCKET)


@register("cluster_spatial", _with("paths", f"{_SPATIAL} SELECT {_ROWS} FROM sp", True))
def _c_spatial(spark, sf):
    return _rows(_spatial(spark, sf))


@register("two_documents", _with("paths", f"{_SPATIAL} SELECT 'd' || page_index % 2 AS doc_path, page_index // 2 AS page_index, layer_key, color_key, path_id, group_id FROM sp", True))
def _two_documents(spark, sf):
    """The pages dealt to two documents, whose pages have the same numbers."""
    paths = X.paths(spark, sf).withColumn("doc_path", F.concat(F.lit("d"), F.expr("page_index % 2"))).withColumn("page_index", F.expr("page_index div 2"))
    bucket = clustering.bucket_of(paths)
    groups = clustering.cluster_spatial(clustering.singletons(joins.with_drawing_stats(paths, bucket)))
    return groups.select(*bucket, "path_id", "group_id")


_SEQ = f"""
gaps AS (SELECT *, CASE WHEN seq - lag(seq) OVER w > 3 THEN 1 ELSE 0 END AS jump FROM sp WINDOW w AS (PARTITION BY {_B}, group_id ORDER BY seq, path_id)),
runs AS (SELECT *, sum(jump) OVER (PARTITION BY {_B}, group_id ORDER BY seq, path_id ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
sq AS (SELECT * EXCLUDE (group_id, jump, run), min(path_id) OVER (PARTITION BY {_B}, group_id, run) AS group_id FROM runs)"""


@register("cluster_by_seq", _with("paths", f"{_SPATIAL}, {_SEQ} SELECT {_ROWS} FROM sq", True))
def _c_seq(spark, sf):
    return _rows(clustering.cluster_by_seq(_spatial(spark, sf)))


@register("cluster_spatial_uf", _with("paths", f"{_SPATIAL}, {_SEQ}, {_merged('uf', 'sq', 'group_id', _NEAR8)} SELECT {_ROWS} FROM uf", True))
def _c_uf(spark, sf):
    return _rows(clustering.cluster_spatial_union_find(clustering.cluster_by_seq(_spatial(spark, sf))))


@register("group_overlapping_path", _with("paths", f"{_START}, {_merged('ov', 'start', 'path_id', _OVERLAP)} SELECT {_ROWS} FROM ov", True))
def _c_overlap_path(spark, sf):
    return _rows(clustering.group_overlapping(_start(spark, sf), X.page_meta(spark, sf)))


@register("group_overlapping_cluster", _with("paths", f"{_SPATIAL}, {_merged('ov', 'sp', 'group_id', _OVERLAP)} SELECT {_ROWS} FROM ov", True))
def _c_overlap_cluster(spark, sf):
    return _rows(clustering.group_overlapping(_spatial(spark, sf), X.page_meta(spark, sf), scope="cluster"))


@register("cluster_by_dimension", _with("paths", f"{_SPATIAL}, {_merged('dm', 'sp', 'group_id', _ALIKE)} SELECT {_ROWS} FROM dm", True))
def _c_dimension(spark, sf):
    return _rows(clustering.cluster_by_dimension(_spatial(spark, sf)))


@register("cluster_by_item_count", _with("paths", f"""{_START},
gaps AS (SELECT *, CASE WHEN drawing_paths - lag(drawing_paths) OVER w > 2 THEN 1 ELSE 0 END AS jump FROM start WINDOW w AS (PARTITION BY {_B} ORDER BY drawing_paths, path_id)),
runs AS (SELECT *, sum(jump) OVER (PARTITION BY {_B} ORDER BY drawing_paths, path_id ROWS UNBOUNDED PRECEDING) AS run FROM gaps)
SELECT {_B}, path_id, min(path_id) OVER (PARTITION BY {_B}, run) AS group_id FROM runs"""))
def _c_count(spark, sf):
    return _rows(clustering.cluster_by_item_path_count(_start(spark, sf)))


@register("cluster_by_item_bbox", _with("paths", f"""
dr AS (SELECT {_B}, seq, min(path_id) AS lead_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM paths GROUP BY {_B}, seq),
{_components('ib', 'dr', 'lead_id', _ALIKE)}
SELECT p.page_index, p.layer_key, p.color_key, p.path_id, ib_c.c AS group_id FROM paths p
  JOIN dr USING ({_B}, seq) JOIN ib_c ON ib_c.page_index = dr.page_index AND ib_c.layer_key = dr.layer_key AND ib_c.color_key = dr.color_key AND ib_c.n = dr.lead_id""", True))
def _c_item_bbox(spark, sf):
    return _rows(clustering.cluster_by_item_bbox(_start(spark, sf)))


# -- chains -------------------------------------------------------------------------------

_CHAIN = f"""{_START},
p0 AS (SELECT *, {_ALONE} AS gone FROM start),
k0 AS (SELECT * EXCLUDE (gone) FROM p0 WHERE NOT gone), d0 AS (SELECT * FROM p0 WHERE gone),
k1 AS (SELECT * FROM k0 WHERE {_AREA} <= 0.2::DOUBLE * 40000), d1 AS (SELECT * FROM k0 WHERE {_AREA} > 0.2::DOUBLE * 40000),
{_merged('k2', 'k1', 'path_id', _NEAR8)},
k6 AS (SELECT * EXCLUDE (gx0, gy0, gx1, gy1) FROM {_group_filter('k2', _GROUP_OK)}), d6 AS (SELECT * FROM {_group_filter('k2', f'NOT ({_GROUP_OK})')}),
k7 AS (SELECT * EXCLUDE (gx0, gy0, gx1, gy1) FROM {_group_filter('k6', _RATIO_OK)}), d7 AS (SELECT * FROM {_group_filter('k6', f'NOT ({_RATIO_OK})')})"""
_DROPS = f"""dropped AS (SELECT {_B}, seq, path_id, path_id AS group_id, 0 AS step_index, 'filter_layout_panels' AS step FROM d0
  UNION ALL SELECT {_B}, seq, path_id, path_id, 1, 'filter_large_bbox' FROM d1
  UNION ALL SELECT {_B}, seq, path_id, group_id, 6, 'filter_large_group_bbox' FROM d6
  UNION ALL SELECT {_B}, seq, path_id, group_id, 7, 'filter_aspect_ratio' FROM d7)"""
CUSTOM_ORDER = ("cluster_spatial", "cluster_by_seq", "cluster_spatial_union_find", "filter_large_group_bbox")
CUSTOM_PARAMS = {"cluster_spatial": {"threshold": 4.0, "unknown": 1}, "cluster_by_seq": {"max_gap": 2}, "filter_large_group_bbox": {"max_area_fraction": 0.1}}


def _default_chain(spark, sf):
    return chain.run_chain(X.paths(spark, sf), X.page_meta(spark, sf))


@register("cluster_chain_default", _with("paths", f"{_CHAIN} SELECT {_ROWS} FROM k7", True))
def _chain_default(spark, sf):
    return _rows(_default_chain(spark, sf)[-1][1])


@register("classify", _with("paths", f"{_CHAIN} SELECT {_B}, group_id, count(*) AS n_paths FROM k7 GROUP BY {_B}, group_id", True))
def _classify(spark, sf):
    return chain.classify(_default_chain(spark, sf)).groupBy(*BUCKET, "group_id").agg(F.count(F.lit(1)).alias("n_paths"))


@register("cluster_chain_custom", _with("paths", f"""{_START}, {_merged('sp', 'start', 'path_id', f'{_GAP2} <= 16')}, {_SEQ.replace('> 3 THEN', '> 2 THEN')},
{_merged('uf', 'sq', 'group_id', _NEAR8)} SELECT {_ROWS} FROM {_group_filter('uf', _GROUP_OK.replace('0.2', '0.1'))}""", True))
def _chain_custom(spark, sf):
    return _rows(chain.run_chain(X.paths(spark, sf), X.page_meta(spark, sf), CUSTOM_ORDER, CUSTOM_PARAMS)[-1][1])


@register("cluster_drop_log", _with("paths", f"{_CHAIN}, {_DROPS} SELECT {_B}, step_index, step, path_id, group_id FROM dropped", True))
def _drop_log(spark, sf):
    return chain.step_log(_default_chain(spark, sf)).where("status = 'dropped'").drop("status")


def _count_sql() -> str:
    parts = [f"SELECT 0 AS step_index, 'filter_layout_panels' AS step, 'kept' AS status, {_B}, group_id FROM k0", f"SELECT 1, 'filter_large_bbox', 'kept', {_B}, group_id FROM k1"]
    parts += [f"SELECT {i}, '{s}', 'kept', {_B}, group_id FROM k2" for i, s in ((2, "cluster_spatial"), (3, "none"), (4, "none"), (5, "none"))]
    parts += [f"SELECT 6, 'filter_large_group_bbox', 'kept', {_B}, group_id FROM k6", f"SELECT 7, 'filter_aspect_ratio', 'kept', {_B}, group_id FROM k7"]
    parts.append(f"SELECT step_index, step, 'dropped', {_B}, group_id FROM dropped")
    return _with("paths", f"""{_CHAIN}, {_DROPS}, log AS ({' UNION ALL '.join(parts)})
SELECT step_index, step, status, count(DISTINCT ({_B}, group_id)) AS n_groups, count(*) AS n_paths FROM log GROUP BY ALL""", True)  # fmt: skip


@register("cluster_step_counts", _count_sql())
def _step_counts(spark, sf):
    return aggregates.step_counts(chain.step_log(_default_chain(spark, sf)), BUCKET)


def _members(df):
    return df.withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))


@register("text_clusters", _with("paths", f"""{_CHAIN} SELECT {_B}, group_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  count(*) AS n_paths, string_agg(CAST(path_id AS VARCHAR), ',' ORDER BY path_id) AS members FROM k7 GROUP BY {_B}, group_id""", True))
def _text_clusters(spark, sf):
    return _members(aggregates.text_clusters(chain.classify(_default_chain(spark, sf)), BUCKET))


@register("drawing_vectors", _with("paths", f"""{_CHAIN}, {_DROPS}, lost AS (SELECT p.* FROM paths p JOIN dropped d USING (page_index, path_id))
SELECT page_index, seq, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, count(*) AS n_paths, min(layer_key) AS layer_key, min(color_key) AS color_key,
  min(stroke_width) AS stroke_width, coalesce(min(dashes), '') <> '' AND NOT starts_with(trim(coalesce(min(dashes), '')), '[]') AS dashed,
  string_agg(CAST(path_id AS VARCHAR), ',' ORDER BY path_id) AS members FROM lost GROUP BY page_index, seq""", True))
def _drawing_vectors(spark, sf):
    return _members(aggregates.build_drawings(chain.all_dropped(_default_chain(spark, sf))))


@register("drawing_dashed_counts", _with("paths", "SELECT coalesce(dashes, '') <> '' AND NOT starts_with(trim(coalesce(dashes, '')), '[]') AS dashed, count(DISTINCT (page_index, seq)) AS n FROM paths GROUP BY 1"))
def _dashed_counts(spark, sf):
    return aggregates.build_drawings(X.paths(spark, sf)).groupBy("dashed").agg(F.count(F.lit(1)).alias("n"))


@register("layer_counts", _with("paths", "SELECT layer_key, count(*) AS n FROM paths GROUP BY 1"))
def _layer_counts(spark, sf):
    return X.paths(spark, sf).groupBy("layer_key").agg(F.count(F.lit(1)).alias("n"))


@register("layer_color_counts", _with("paths", f"SELECT {_B}, count(*) AS n FROM paths GROUP BY ALL"))
def _layer_color_counts(spark, sf):
    return X.paths(spark, sf).groupBy(*BUCKET).agg(F.count(F.lit(1)).alias("n"))


@register("kind_counts", _with("paths", "SELECT kind, layer_key, count(*) AS n FROM paths GROUP BY ALL"))
def _kind_counts(spark, sf):
    return X.paths(spark, sf).groupBy("kind", "layer_key").agg(F.count(F.lit(1)).alias("n"))


@register("cluster_size_stats", _with("paths", f"""{_SPATIAL} SELECT count(*) AS n_groups, min(n) AS least, median(n) AS median, avg(n) AS mean, max(n) AS most
  FROM (SELECT count(*) AS n FROM sp GROUP BY {_B}, group_id)""", True))
def _size_stats(spark, sf):
    return aggregates.size_stats(_spatial(spark, sf), BUCKET)


@register("cluster_centroids", _with("paths", f"{_SPATIAL} SELECT {_B}, group_id, (min(x0) + max(x1)) / 2 AS cx, (min(y0) + max(y1)) / 2 AS cy FROM sp GROUP BY {_B}, group_id", True))
def _centroids(spark, sf):
    return aggregates.centroids(_spatial(spark, sf), BUCKET)


# -- facets and access ------------------------------------------------------------------

_FACETS = {"item_kind": ["re", "l"], "close_path": ["True", "None"], "stroke_color": [facets.NONE], "unknown": ["x"], "path_type": []}


@register("facet_filter", _with("items", "SELECT layer_key, page_index, ord FROM items WHERE item_kind IN ('re', 'l') AND close_path IS DISTINCT FROM false AND stroke_color IS NULL"))
def _facet_filter(spark, sf):
    return facets.filter_items(X.overlay_items(spark, sf), _FACETS).select("layer_key", "page_index", "ord")


@register("layer_facet_filter", _with("items", "SELECT layer_key, page_index, ord FROM items WHERE (layer_key = 'drawings' AND path_type IN ('f', 'fs')) OR (layer_key = 'images' AND has_mask)"))
def _layer_facets(spark, sf):
    chosen = {"drawings": {"path_type": ["f", "fs"]}, "images": {"has_mask": ["True"], "path_type": ["f"]}}
    return facets.filter_layers(X.overlay_items(spark, sf), ["drawings", "images"], chosen).select("layer_key", "page_index", "ord")


@register("facet_options", _with("items", """SELECT DISTINCT page_index, 'stroke_color' AS facet, coalesce(stroke_color, '__none__') AS value FROM items
UNION ALL SELECT DISTINCT page_index, 'fill_color', coalesce(fill_color, '__none__') FROM items"""))
def _facet_options(spark, sf):
    return facets.color_options(X.overlay_items(spark, sf))


_VIEW = access.view_rect((100.0, 60.0, 220.0, 160.0), [2.0, 0.0, 0.0, 2.0, 0.0, 0.0])


def _view_sql(view) -> str:
    x0, y0, x1, y1 = view
    return f"x0 <= {x1!r}::DOUBLE AND x1 >= {x0!r}::DOUBLE AND y0 <= {y1!r}::DOUBLE AND y1 >= {y0!r}::DOUBLE"


@register("viewport_query", _with("items", f"SELECT layer_key, page_index, ord FROM items WHERE {_view_sql(_VIEW)}"))
def _viewport(spark, sf):
    return access.viewport_query(X.overlay_items(spark, sf), _VIEW).select("layer_key", "page_index", "ord")


_VIEW2 = (80.0, 40.0, 150.0, 110.0)


@register("viewport_delta", _with("items", f"""SELECT layer_key, page_index, ord, CASE WHEN {_view_sql(_VIEW2)} THEN 'draw' ELSE 'delete' END AS change FROM items
  WHERE ({_view_sql(_VIEW)}) <> ({_view_sql(_VIEW2)})"""))
def _delta(spark, sf):
    return access.viewport_delta(X.overlay_items(spark, sf), _VIEW, _VIEW2, ["layer_key", "page_index", "ord"])


@register("hit_test", _with("paths", f"""{_SPATIAL} SELECT page_index, category, group_id FROM (SELECT page_index, CASE WHEN layer_key = '' THEN 0 ELSE 1 END AS category, group_id FROM sp
  WHERE x0 - 2.5 <= 90 AND x1 + 2.5 >= 90 AND y0 - 2.5 <= 90 AND y1 + 2.5 >= 90)
  QUALIFY row_number() OVER (PARTITION BY page_index ORDER BY category, group_id) = 1""", True))
def _hit_test(spark, sf):
    groups = _spatial(spark, sf).withColumn("category", F.when(F.col("layer_key") == "", 0).otherwise(1))
    return access.hit_test(groups, ["page_index"], 90.0, 90.0, 2.5)


@register("topmost_hit", _with("items", """SELECT page_index, layer_key, ord FROM items WHERE x0 <= 90 AND x1 >= 90 AND y0 <= 90 AND y1 >= 90
  QUALIFY row_number() OVER (PARTITION BY page_index ORDER BY layer_key DESC, ord DESC) = 1"""))
def _topmost(spark, sf):
    return access.topmost(X.overlay_items(spark, sf), ["page_index"], 90.0, 90.0, ["layer_key", "ord"])


# -- readings and drawing ------------------------------------------------------------------


@register("rotation_fanout", _with("readings", "SELECT cluster_id, CAST(i AS INTEGER) AS rotation_index, i * 45.0::DOUBLE AS angle FROM (SELECT DISTINCT cluster_id FROM readings), range(8) t(i)"))
def _fanout(spark, sf):
    return voting.rotation_fanout(X.readings(spark, sf).select("cluster_id").distinct())


_TRIM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
_VOTE = f"""
seen AS (SELECT *, lower({_TRIM}) AS norm FROM readings WHERE {_TRIM} <> ''),
grouped AS (SELECT cluster_id, norm, sum(confidence) AS total, avg(confidence) AS mean, min(rotation_index) AS first FROM seen GROUP BY ALL),
won AS (SELECT * FROM grouped QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY total DESC, first) = 1),
shown AS (SELECT s.cluster_id, s.norm, s.text FROM seen s QUALIFY row_number() OVER (PARTITION BY s.cluster_id, s.norm ORDER BY s.confidence DESC, s.rotation_index) = 1),
voted AS (SELECT cluster_id, coalesce(shown.text, '') AS text, coalesce(mean, 0) AS confidence FROM (SELECT DISTINCT cluster_id FROM readings)
  LEFT JOIN won USING (cluster_id) LEFT JOIN shown USING (cluster_id, norm))"""


@register("ocr_vote", _with("readings", f"{_VOTE} SELECT cluster_id, text, round_even(confidence, 6) AS confidence FROM voted"))
def _vote(spark, sf):
    return voting.vote_exact(X.readings(spark, sf)).select("cluster_id", "text", F.bround("confidence", 6).alias("confidence"))


_VOTE_FUZZY = _VOTE.replace(f"lower({_TRIM}) AS norm FROM readings", "kind AS norm FROM misread").replace("FROM readings)", "FROM misread)")


@register("ocr_vote_fuzzy", f"WITH misread AS ({X.MISREAD_SQL}), {_VOTE_FUZZY} SELECT cluster_id, text, round_even(confidence, 6) AS confidence FROM voted")
def _vote_fuzzy(spark, sf):
    return voting.vote_fuzzy(X.misread(spark, sf)).select("cluster_id", "text", F.bround("confidence", 6).alias("confidence"))


@register("ocr_pass_fail", _with("readings", f"{_VOTE} SELECT trim(text) <> '' AS passed, count(*) AS n FROM voted GROUP BY 1"))
def _pass_fail(spark, sf):
    return voting.vote_exact(X.readings(spark, sf)).groupBy((F.trim("text") != "").alias("passed")).agg(F.count(F.lit(1)).alias("n"))


@register("best_rotation", _with("readings", """SELECT cluster_id, CAST(round_even(rotation_index * 45.0::DOUBLE, 0) AS INTEGER) % 360 AS rotation_used FROM readings
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, rotation_index) = 1"""))
def _best_rotation(spark, sf):
    return voting.best_rotation(X.readings(spark, sf))


@register("ocr_combine_boxes", _with("words", """
boxes AS (SELECT page_index, ord // 10 AS line, ord, text, x0, y0, x1, y1, CAST(ord % 7 AS DOUBLE) AS score FROM words)
SELECT page_index, line, string_agg(text, ' ' ORDER BY x0, ord) AS text, round_even(avg(score), 6) AS confidence, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
FROM boxes GROUP BY page_index, line"""))
def _combine(spark, sf):
    boxes = X.words(spark, sf).withColumn("line", F.expr("ord div 10")).withColumn("score", F.expr("cast(ord % 7 as double)"))
    return voting.combine_boxes(boxes, ["page_index", "line"]).withColumn("confidence", F.bround("confidence", 6))


@register("cluster_canvas", _with("paths", f"""{_SPATIAL}, boxed AS (SELECT {_B}, group_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
  greatest(4, coalesce(max(stroke_width), 0)) AS pad FROM sp GROUP BY {_B}, group_id)
SELECT {_B}, group_id, pad, pad - x0 AS shift_x, pad - y0 AS shift_y, x1 - x0 + 2 * pad AS width, y1 - y0 + 2 * pad AS height, 300.0::DOUBLE / 72 AS scale FROM boxed""", True))
def _canvas(spark, sf):
    return drawlist.cluster_canvas(_spatial(spark, sf), BUCKET)


@register("path_draw_style", _with("paths", """SELECT page_index, path_id, has_stroke AS drawable, coalesce(stroke_width, 1) AS width, coalesce(closed, true) AS closed,
  CASE WHEN has_stroke THEN '#804000' ELSE '#111827' END AS color FROM paths"""))
def _draw_style(spark, sf):
    return drawlist.draw_styles(X.paths(spark, sf))


_RESULTS = f"""{_VOTE}, turned AS (SELECT cluster_id, CAST(round_even(rotation_index * 45.0::DOUBLE, 0) AS INTEGER) % 360 AS rotation_used FROM readings
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY confidence DESC, rotation_index) = 1),
results AS (SELECT cluster_id // 16 AS page_index, cluster_id AS ord, text, rotation_used, CAST(cluster_id % 16 * 10 AS DOUBLE) AS x0,
  CAST(cluster_id % 9 * 20 + cluster_id % 7 AS DOUBLE) AS y1, CAST(cluster_id % 7 AS DOUBLE) AS high FROM voted JOIN turned USING (cluster_id))"""


@register("reconstruction_drawlist", _with("paths words spans readings", f"""{_MATCH}, {_RESULTS},
dr AS (SELECT page_index, seq, min(x0) AS x, min(y0) AS y, min(stroke_width) AS stroke_width FROM paths GROUP BY page_index, seq)
SELECT page_index, 0 AS z, seq AS ord, 'drawing' AS item, '' AS text, x, y, coalesce(stroke_width, 1) AS size, 0 AS rotation FROM dr
UNION ALL SELECT page_index, 1, ord, 'word', text, x0, y1, greatest(font_size, 1),
  CAST(((round_even({_ANGLE} / 90, 0)::INTEGER % 4) + 4) % 4 * 90 AS INTEGER) FROM matched
UNION ALL SELECT page_index, 2, ord, 'result', text, x0, y1, greatest(high, 4), CAST(((round_even(rotation_used / 90, 0)::INTEGER % 4) + 4) % 4 * 90 AS INTEGER) FROM results WHERE trim(text) <> ''"""))
def _reconstruction(spark, sf):
    words = _matched(spark, sf, "ord", "text", *G.box()).withColumn("angle", G.point_angle(F.lit(0.0), F.lit(0.0), F.col("dir_x"), F.col("dir_y")))
    words = words.withColumn("origin_x", F.lit(None).cast("double")).withColumn("origin_y", F.lit(None).cast("double"))
    voted = voting.vote_exact(X.readings(spark, sf)).join(voting.best_rotation(X.readings(spark, sf)), "cluster_id")
    results = voted.selectExpr(
        "cluster_id div 16 as page_index", "cluster_id as ord", "text", "rotation_used", "cast(cluster_id % 16 * 10 as double) as x0",
        "cast(cluster_id % 9 * 20 as double) as y0", "cast(cluster_id % 9 * 20 + cluster_id % 7 as double) as y1",
    )
    return drawlist.reconstruction(aggregates.build_drawings(X.unnumbered_paths(spark, sf), "line"), words, results)
