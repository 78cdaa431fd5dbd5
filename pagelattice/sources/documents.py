"""Page documents as a source: binary files in, nested page rows out.

``read_pages(list_documents(spark, path))`` yields one row per page with its words, text
blocks and drawings in the nested shape that ``pagelattice.operators.scan`` flattens.
Parsing needs the optional ``pymupdf`` library
on the executors; without it reading raises ``ImportError``. Files are listed with
Spark's binary reader, so any store Spark reads will do. A file that cannot be parsed
gives one row with ``error`` set and no content.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

PAGE_SCHEMA = """
doc_path string, page_index long, page_number long, x0 double, y0 double, x1 double, y1 double, raw_rotation int, width double, height double,
words array<struct<ord: long, text: string, x0: double, y0: double, x1: double, y1: double>>,
blocks array<struct<type: int, lines: array<array<struct<text: string, x0: double, y0: double, x1: double, y1: double, font: string, size: double, flags: int, dir: struct<x: double, y: double>>>>>>,
drawings array<struct<seq: long, layer: string, stroke_color: array<double>, fill_color: array<double>, stroke_opacity: double, fill_opacity: double, stroke_width: double, dashes: string, closed: boolean, fill_rule: string, items: array<struct<op: string, points: array<struct<x: double, y: double>>>>>>,
error string
"""


def list_documents(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """``path, content`` of the documents under a folder, one row per file."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def _page_rows(path: str, content: bytes, only: int | None) -> Iterator[dict]:
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        if only is not None and not 0 <= only < len(doc):
            raise IndexError(f"page {only} is outside 0..{len(doc) - 1}")
        for number in range(len(doc)) if only is None else [only]:
            page = doc[number]
            media = page.mediabox
            yield {
                "doc_path": path, "page_index": number, "page_number": number + 1, "x0": media.x0, "y0": media.y0, "x1": media.x1, "y1": media.y1,
                "raw_rotation": page.rotation, "width": media.width, "height": media.height, "words": _words(page), "blocks": _blocks(page),
                "drawings": _drawings(page), "error": None,
            }


def _words(page) -> list[dict]:
    return [{"ord": i, "text": w[4], "x0": w[0], "y0": w[1], "x1": w[2], "y1": w[3]} for i, w in enumerate(page.get_text("words"))]


def _blocks(page) -> list[dict]:
    out = []
    for block in page.get_text("dict")["blocks"]:
        lines = []
        for line in block.get("lines", ()):
            x, y = line.get("dir", (1.0, 0.0))
            lines.append([
                {
                    "text": s["text"], "x0": s["bbox"][0], "y0": s["bbox"][1], "x1": s["bbox"][2], "y1": s["bbox"][3], "font": s.get("font"),
                    "size": s.get("size"), "flags": s.get("flags"), "dir": {"x": x, "y": y},
                }
                for s in line["spans"]
            ])
        out.append({"type": block["type"], "lines": lines})
    return out


def _corners(value) -> list[dict]:
    """Points of one operand: a point, the two corners of a rectangle, or a quad's four."""
    if hasattr(value, "ul"):
        return [{"x": p.x, "y": p.y} for p in (value.ul, value.ur, value.lr, value.ll)]
    if hasattr(value, "x0"):
        return [{"x": value.x0, "y": value.y0}, {"x": value.x1, "y": value.y1}]
    return [{"x": value.x, "y": value.y}]


def _drawings(page) -> list[dict]:
    out = []
    for seq, d in enumerate(page.get_drawings()):
        items = [{"op": op, "points": [p for v in rest for p in (_corners(v) if hasattr(v, "x") or hasattr(v, "x0") or hasattr(v, "ul") else [])]} for op, *rest in d["items"]]
        out.append({
            "seq": seq, "layer": d.get("layer"), "stroke_color": d.get("color"), "fill_color": d.get("fill"), "stroke_opacity": d.get("stroke_opacity"),
            "fill_opacity": d.get("fill_opacity"), "stroke_width": d.get("width"), "dashes": d.get("dashes"), "closed": d.get("closePath"),
            "fill_rule": d.get("type"), "items": items,
        })
    return out


def read_pages(documents: DataFrame, page_index: int | None = None) -> DataFrame:
    """Pages of ``path, content`` rows; ``page_index`` keeps one page of each under its original number."""
    schema = StructType.fromDDL(PAGE_SCHEMA)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = list(_page_rows(path, content, page_index))
                except (ImportError, IndexError):
                    raise
                except Exception as e:  # a broken file is reported in its own row
                    rows = [{"doc_path": path, "error": f"{type(e).__name__}: {e}"[:500]}]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return documents.select("path", "content").mapInArrow(run, schema)


def page_words(pages: DataFrame) -> DataFrame:
    """Flat words of read pages."""
    return pages.select("doc_path", "page_index", F.inline("words"))


def page_blocks(pages: DataFrame) -> DataFrame:
    """Text and image blocks of read pages, as ``scan.flatten_spans`` takes them."""
    return pages.select("doc_path", "page_index", F.posexplode("blocks").alias("block_ord", "b")).select("doc_path", "page_index", "block_ord", "b.type", "b.lines")


def page_drawings(pages: DataFrame) -> DataFrame:
    """Drawings of read pages, as ``scan.extract_paths`` takes them."""
    return pages.select("doc_path", "page_index", F.inline("drawings"))
