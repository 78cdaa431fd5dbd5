"""Session helpers: the shared scratch folder and tables written into it."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no folder and driver and executors are one process, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A cluster must name one: files that each machine writes to its own disk cannot be read back.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not found and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (found or f"{LOCAL_CHECKPOINTS}/{spark.sparkContext.applicationId}").rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage like ``checkpoint()``, evaluates the input exactly once, and
    survives the loss of executors. The shuffle files of the write go with it, as nothing
    reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What each operator keeps in a Python worker between tasks, as functions that drop it.
_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, forget: Callable[[], None]) -> None:
    """A worker serves one operator after the other; ``forget`` runs once another one begins there."""
    _KEPT[owner] = forget


def _trim() -> None:
    """Give freed memory back to the system, which allocators keep otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _enter(owner: str) -> None:
    for other, forget in _KEPT.items():
        if other != owner:
            forget()
    _trim()


@contextmanager
def tidied() -> Iterator[None]:
    """The driver's counterpart of ``tidy``: what operators keep goes after a computation there, and freed memory with it."""
    try:
        yield
    finally:
        for forget in _KEPT.values():
            forget()
        _trim()


def tidy(owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, in a worker that holds no other operator's caches, and no freed memory after it."""

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(owner)
        try:
            yield from run(batches)
        finally:
            _trim()

    return alone
