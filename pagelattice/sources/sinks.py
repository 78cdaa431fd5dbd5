"""Sinks: page pictures, and logging of stages."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

LOGGER = "pagelattice"


def configure_logging(verbosity: int = 0) -> logging.Logger:
    """The root logger of this package with one handler, however often it is called."""
    log = logging.getLogger(LOGGER)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
        log.addHandler(handler)
    log.setLevel(logging.WARNING if verbosity < 0 else logging.DEBUG if verbosity > 0 else logging.INFO)
    return log


def stage_logger(stage: str) -> logging.Logger:
    return logging.getLogger(f"{LOGGER}.{stage}")


def rasterize_pages(documents: DataFrame, dpi: int = 150, renderer: Callable[[bytes, int], list[bytes]] | None = None) -> DataFrame:
    """``path, page_index, image, error``: every page of ``path, content`` rows as one picture.

    ``renderer`` turns a document's bytes and a resolution into its pages' pictures; the
    default needs the optional ``pymupdf`` library. A file that cannot be drawn gives one
    row with its ``error`` and no picture.
    """
    if dpi <= 0:
        raise ValueError("the resolution must be positive")

    def default(content: bytes, dpi: int) -> list[bytes]:
        import pymupdf

        with pymupdf.open(stream=content, filetype="pdf") as doc:
            return [page.get_pixmap(dpi=dpi).tobytes("png") for page in doc]

    draw = renderer or default

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    images = draw(bytes(content), dpi)
                except ImportError:
                    raise
                except Exception as e:  # a broken file is reported in its own row
                    yield pd.DataFrame({"path": [path], "page_index": [None], "image": [None], "error": [f"{type(e).__name__}: {e}"[:500]]})
                    continue
                yield pd.DataFrame({"path": [path] * len(images), "page_index": range(len(images)), "image": images, "error": None})

    return documents.select("path", "content").mapInPandas(run, "path string, page_index long, image binary, error string")


def rasterize_zoomed(documents: DataFrame, zoom: float = 1.0, renderer: Callable[[bytes, int], list[bytes]] | None = None) -> DataFrame:
    """``rasterize_pages`` at a zoom of the page's own size (72 points an inch), kept in 0.25..6 like ``geometry.zoom_step``."""
    return rasterize_pages(documents, round(72 * min(6.0, max(0.25, zoom))), renderer)


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with a row count that is gathered as it runs, without another pass."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
