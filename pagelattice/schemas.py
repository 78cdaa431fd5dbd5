"""Schemas of the page relations. Boxes are four double columns; a colour is an array of
components, null where there is none."""

from __future__ import annotations

from pyspark.sql.types import StructType

_BOX = "x0 double, y0 double, x1 double, y1 double"
_POINT = "struct<x: double, y: double>"

PAGES = StructType.fromDDL(f"doc_path string, page_index long, page_number long, {_BOX}, rotation int, width double, height double")
WORDS = StructType.fromDDL(
    f"doc_path string, page_index long, ord long, text string, {_BOX}, quad array<{_POINT}>, angle double, dir_x double, dir_y double, font string, "
    "font_size double, color int, flags int, origin_x double, origin_y double, ascender double, descender double, orientation_source string, seq long"
)
TEXT_RUNS = StructType.fromDDL(f"doc_path string, page_index long, words array<long>, {_BOX}, quad array<{_POINT}>, font string, font_size double, color int")
PATHS = StructType.fromDDL(
    f"doc_path string, page_index long, seq long, item_index long, path_id long, kind string, fill_rule string, points array<{_POINT}>, {_BOX}, "
    "stroke_color array<double>, fill_color array<double>, stroke_opacity double, fill_opacity double, stroke_width double, dashes string, "
    "closed boolean, layer string, layer_key string, color_key string"
)
DRAWINGS = StructType.fromDDL(
    f"doc_path string, page_index long, seq long, {_BOX}, n_paths long, layer_key string, color_key string, stroke_width double, dashed boolean, members array<long>"
)
TEXT_RESULTS = StructType.fromDDL(
    f"doc_path string, page_index long, members array<long>, text string, confidence double, {_BOX}, rotation_used int"
)
IMAGES = StructType.fromDDL(f"doc_path string, page_index long, xref long, {_BOX}, width_px long, height_px long, image_bytes binary")
ANNOTATIONS = StructType.fromDDL(
    f"doc_path string, page_index long, xref long, kind string, {_BOX}, author string, contents string, subject string, opacity double, created string, modified string"
)
JUNCTIONS = StructType.fromDDL("doc_path string, page_index long, x double, y double, directions array<double>")
LINES = StructType.fromDDL("doc_path string, page_index long, x0 double, y0 double, x1 double, y1 double, width double, color array<double>")
OVERLAY_ITEMS = StructType.fromDDL(
    f"layer_key string, page_index long, ord long, item_kind string, path_type string, stroke_color string, fill_color string, close_path boolean, "
    f"has_mask boolean, {_BOX}, label string, attrs map<string, string>, metadata map<string, string>"
)
CLUSTER_LOG = StructType.fromDDL("page_index long, layer_key string, color_key string, step_index int, step string, path_id long, group_id long, status string")
