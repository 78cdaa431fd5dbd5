"""Scan-shaped operators: from nested page records to flat relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, StructField, StructType

from pagelattice.functions import geometry as G

OPCODES = ("l", "re", "qu", "c")
#: What identifies a page: pages of several documents also have their document.
PAGE = ("doc_path", "page_index")
_STYLE = ("stroke_opacity", "fill_opacity", "stroke_width", "dashes", "closed", "fill_rule")


def page_keys(df: DataFrame) -> list[str]:
    """Those of the page's key columns that a relation has."""
    return [c for c in PAGE if c in df.columns]


def prune_pages(pages: DataFrame, page_index: int) -> DataFrame:
    """One page by its original index; the predicate reaches the scan."""
    return pages.where(F.col("page_index") == page_index)


def lookup_pages(pages: DataFrame, indices: Sequence[int] | None = None) -> DataFrame:
    """All pages, or those given. An index that no page has raises an error when the result is read.

    The check is a part of the plan - each wanted index is left-joined to its pages - so
    the pages are scanned once and nothing runs while planning.
    """
    if indices is None:
        return pages
    wanted = pages.sparkSession.createDataFrame([(int(i),) for i in sorted(set(indices))], "__wanted long")
    found = wanted.join(pages.where(F.col("page_index").isin(list(indices))), F.col("page_index") == F.col("__wanted"), "left")
    absent = F.when(F.col("page_index").isNull(), F.raise_error(F.concat(F.lit("page out of range: "), F.col("__wanted").cast("string"))))
    return found.where(F.coalesce(absent.cast("boolean"), F.lit(True))).select(*[F.col(f"`{c}`") for c in pages.columns])


def page_metadata(pages: DataFrame) -> DataFrame:
    """Page numbers, rotation modulo 360 and size; sizes of rotated pages are not swapped."""
    return pages.select(
        *page_keys(pages), "page_number", F.pmod(F.col("raw_rotation"), F.lit(360)).alias("rotation"), "width", "height"
    )


def reading_order(words: DataFrame) -> DataFrame:
    """``seq``: the 0-based rank in the page by line (half-even rounded top), then left edge, then source order."""
    order = Window.partitionBy(*page_keys(words)).orderBy(F.bround("y0"), "x0", "ord")
    return words.withColumn("seq", (F.row_number().over(order) - 1).cast("long"))


def flatten_spans(blocks: DataFrame) -> DataFrame:
    """Spans of text blocks (type 0) with defaults; blank spans are dropped.

    Spans without an ordinal of their own get the 0-based one of their place in the page,
    by ``block_ord`` and the places in the block; dropped spans count.
    """
    page = page_keys(blocks)
    numbered = "span_ord" in blocks.schema["lines"].dataType.elementType.elementType.names
    if numbered:
        lines = blocks.where(F.col("type") == 0).select(*page, F.explode("lines").alias("spans"))
        spans = lines.select(*page, F.explode("spans").alias("s"), F.col("s.span_ord").alias("span_ord"))
    else:
        lines = blocks.where(F.col("type") == 0).select(*page, "block_ord", F.posexplode("lines").alias("line", "spans"))
        spans = lines.select(*page, "block_ord", "line", F.posexplode("spans").alias("at", "s"))
        order = Window.partitionBy(*page).orderBy("block_ord", "line", "at")
        spans = spans.withColumn("span_ord", (F.row_number().over(order) - 1).cast("long"))
    return spans.where(F.col("s.text").rlike(r"\S")).select(
        *page, "span_ord", "s.x0", "s.y0", "s.x1", "s.y1", "s.text",
        F.coalesce("s.font", F.lit("")).alias("font"), F.coalesce("s.size", F.lit(0.0)).alias("size"), F.coalesce("s.flags", F.lit(0)).alias("flags"),
        F.coalesce("s.dir.x", F.lit(1.0)).alias("dir_x"), F.coalesce("s.dir.y", F.lit(0.0)).alias("dir_y"),
    )


def extract_paths(drawings: DataFrame) -> DataFrame:
    """One row per drawing item of a known opcode; unknown ones keep their index in the count.

    The box encloses the item's points (control points of curves). Colours are rounded
    to three places and an empty layer is null. The drawing's style is carried along, null
    where the drawings lack a column.
    """
    page = page_keys(drawings)
    kinds = {"closed": "boolean", "dashes": "string", "fill_rule": "string"}
    style = [F.col(c) if c in drawings.columns else F.lit(None).cast(kinds.get(c, "double")).alias(c) for c in _STYLE]
    fill = F.col("fill_color") if "fill_color" in drawings.columns else F.lit(None).cast("array<double>")
    items = drawings.select(
        *page, "seq", F.size("items").alias("operation_count"), F.when(F.col("layer") != "", F.col("layer")).alias("layer"),
        G.round_color(F.col("stroke_color")).alias("stroke_color"), G.round_color(fill).alias("fill_color"), *style, F.posexplode("items").alias("item_index", "item"),
    ).where(F.col("item.op").isin(*OPCODES))
    points = F.col("item.points")

    def edge(pick, axis):
        return pick(F.transform(points, lambda p: p[axis]))

    return items.select(
        *page, "seq", F.col("item_index").cast("long").alias("item_index"), F.col("item.op").alias("kind"), points.alias("points"), "layer",
        "stroke_color", "fill_color", *_STYLE, "operation_count",
        edge(F.array_min, "x").alias("x0"), edge(F.array_min, "y").alias("y0"), edge(F.array_max, "x").alias("x1"), edge(F.array_max, "y").alias("y1"),
    )


def number_paths(paths: DataFrame) -> DataFrame:
    """``path_id``: the 0-based ordinal of a path in its page, by drawing and item."""
    order = Window.partitionBy(*page_keys(paths)).orderBy("seq", "item_index")
    return paths.withColumn("path_id", (F.row_number().over(order) - 1).cast("long"))


def color_key(paths: DataFrame) -> DataFrame:
    """``color_key``: stroke and fill colours and opacities as one text; absent parts are ``-``."""
    def shown(c: str):
        found = F.col(c)
        return F.coalesce(F.array_join(F.transform(found, lambda v: v.cast("string")), ",") if c.endswith("color") else found.cast("string"), F.lit("-"))

    return paths.withColumn("color_key", F.concat_ws("/", *[shown(c) for c in ("stroke_color", "fill_color", "stroke_opacity", "fill_opacity")]))


def drawing_metrics(paths: DataFrame) -> DataFrame:
    """Per-kind measures of path items: angle and length of lines, sides of quads, control polygon of curves, area of rectangles."""
    p = F.col("points")
    angle = G.point_angle(p[0]["x"], p[0]["y"], p[1]["x"], p[1]["y"])
    quad = G.quad_metadata(p)
    return paths.select(
        *page_keys(paths), "seq", "item_index", "kind", "operation_count",
        F.when(F.col("kind") == "l", F.bround(angle, 3)).when(F.col("kind") == "qu", quad["angle"]).alias("angle"),
        F.when(F.col("kind") == "l", F.bround(G.line_length(p[0]["x"], p[0]["y"], p[1]["x"], p[1]["y"]), 3))
        .when(F.col("kind") == "c", F.bround(G.path_length(p), 3)).alias("length"),
        F.when(F.col("kind") == "qu", quad["width"]).when(F.col("kind") == "re", F.bround(F.col("x1") - F.col("x0"), 3)).alias("width"),
        F.when(F.col("kind") == "qu", quad["height"]).when(F.col("kind") == "re", F.bround(F.col("y1") - F.col("y0"), 3)).alias("height"),
        F.when(F.col("kind") == "re", F.bround((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), 3)).alias("area"),
    )


def image_metrics(images: DataFrame) -> DataFrame:
    """Display size, pixel count, aspect, colour space, placement matrix and effective resolution."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    pixels = F.when((F.col("width_px") > 0) & (F.col("height_px") > 0), F.col("width_px") * F.col("height_px"))
    q = F.col("quarter")
    a = F.when(q == 0, w).when(q == 2, -w).otherwise(F.lit(0.0))
    b = F.when(q == 1, w).when(q == 3, -w).otherwise(F.lit(0.0))
    return images.select(
        "xref",
        F.bround(w, 3).alias("display_width"), F.bround(h, 3).alias("display_height"), F.bround(w * h, 3).alias("display_area"),
        pixels.alias("pixel_count"), F.when(F.col("height_px") > 0, F.bround(F.col("width_px") / F.col("height_px"), 4)).alias("aspect_ratio"),
        F.coalesce("colorspace_name", F.col("n_components").cast("string")).alias("colorspace"), "has_mask",
        F.bround(F.when(w > 0, G.matrix_rotation(a, b)), 3).alias("rotation"),
        G.effective_dpi(F.col("width_px"), w).alias("dpi_x"), G.effective_dpi(F.col("height_px"), h).alias("dpi_y"),
        "compressed_bytes", F.bround(F.col("compressed_bytes") / 1024, 2).alias("compressed_kb"),
    )


def annotation_items(annotations: DataFrame) -> DataFrame:
    """Annotations with box metadata and a map of the attributes that are set."""
    rect = G.rect_metadata(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    optional = F.create_map(*[x for c in ("author", "contents", "subject", "opacity", "created", "modified") for x in (F.lit(c), F.col(c).cast("string"))])
    return annotations.select(
        *page_keys(annotations), "xref", "kind", *[v.alias(k) for k, v in rect.items()], F.map_filter(optional, lambda _, v: v.isNotNull()).alias("attributes")
    )


def overlay_text(matched: DataFrame) -> DataFrame:
    """Text items of matched words: rounded orientation and box; unmatched words are plain rectangles."""
    rect = G.rect_metadata(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    spanned = F.col("orientation_source") == "text-span"
    return matched.select(
        *page_keys(matched), "ord", "text", F.when(spanned, "quad").otherwise("rect").alias("shape"),
        G.places(F.when(spanned, G.point_angle(F.lit(0.0), F.lit(0.0), F.col("dir_x"), F.col("dir_y"))).otherwise(F.lit(0.0)), 3).alias("angle"),
        G.places(F.col("dir_x"), 5).alias("dir_x"), G.places(F.col("dir_y"), 5).alias("dir_y"), G.places(F.col("font_size"), 3).alias("font_size"), "font",
        *[v.alias(k) for k, v in rect.items()],
    )


def show_value(value: Column, kind: DataType) -> Column:
    """A value as a viewer shows it: three places, Yes or No, structs in round and arrays in square brackets."""
    def inner(part: Column, kind: DataType) -> Column:
        return F.coalesce(show_value(part, kind), F.lit(""))

    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(value.isNotNull(), F.format_string("%.3f", value))
    if isinstance(kind, BooleanType):
        return F.when(value, F.lit("Yes")).when(~value, F.lit("No"))
    if isinstance(kind, StructType):
        parts = [inner(value[f.name], f.dataType) for f in kind.fields]
        return F.when(value.isNotNull(), F.concat(F.lit("("), F.concat_ws(", ", *parts), F.lit(")")))
    if isinstance(kind, ArrayType):
        return F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: inner(x, kind.elementType)), ", "), F.lit("]"))
    return value.cast("string")


def item_metadata(items: DataFrame) -> DataFrame:
    """Stored metadata over defaults: kind, shape, the box to two places; quad, angle, points and label where there are any.

    Points have two places too, and are shown by ``show_value``.
    """
    def places(c: str) -> Column:
        rounded = F.transform(F.col(c), lambda p: F.struct(F.bround(p["x"], 2).alias("x"), F.bround(p["y"], 2).alias("y")))
        return show_value(rounded, ArrayType(StructType([StructField("x", DoubleType()), StructField("y", DoubleType())])))

    optional = {"quad": places, "angle": lambda c: show_value(F.col(c).cast("double"), DoubleType()), "points": places}
    geometry = [x for c, show in optional.items() if c in items.columns for x in (F.lit(c), show(c))]
    shown = F.concat_ws(", ", *[F.bround(F.col(c), 2).cast("string") for c in ("x0", "y0", "x1", "y1")])
    base = F.create_map(F.lit("kind"), F.col("item_kind"), F.lit("shape"), F.lit("rect"), F.lit("bbox"), shown, *geometry, F.lit("label"), F.col("label"))
    stored = F.coalesce(F.col("metadata"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    fresh = F.map_filter(base, lambda k, v: v.isNotNull() & ~F.map_contains_key(stored, k))
    return items.withColumn("metadata", F.map_concat(fresh, stored))


def format_metadata(metadata, preferred: Sequence[str] = (), pretty: bool = False):
    """A metadata map as lines ``key: value``: preferred keys first, then the others by name; nulls are skipped.

    ``pretty`` shows ``font_size`` as ``Font Size``.
    """
    keys = F.filter(F.array(*[F.lit(k) for k in preferred]) if preferred else F.array().cast("array<string>"), lambda k: F.map_contains_key(metadata, k))
    rest = F.array_sort(F.array_except(F.map_keys(metadata), keys))
    lines = F.transform(F.concat(keys, rest), lambda k: F.when(metadata[k].isNotNull(), F.concat(F.initcap(F.translate(k, "_", " ")) if pretty else k, F.lit(": "), metadata[k])))
    return F.array_join(lines, "\n")
