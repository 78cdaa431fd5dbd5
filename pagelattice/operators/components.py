"""Connected components of an edge table, by alternating large-star and small-star
contraction (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014).

Edges are first contracted where they lie: each run of a bounded number of edges becomes
the stars of its own components, which connect the same nodes with fewer edges. Every
later step is an aggregation with map-side combine and one equi-join; nothing is collected
to the driver but row counts. What is left is finished by one task once it is one run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from pagelattice.runtime import discard, materialize

#: Edges that one task contracts at a time.
RUN = 1 << 16


def _sortable(values: pa.Array) -> list:
    """Python values in Spark's order: structs are tuples, nulls within them come first."""
    if not pa.types.is_struct(values.type):
        return values.to_pylist()
    return list(zip(*[[(x is not None, x) for x in part.to_pylist()] for part in values.flatten()]))


def _stars(run: list[pa.RecordBatch]) -> pa.RecordBatch:
    """``(u, v)``: every node of a run of edges ``(u, v)`` but the smallest of its component, with that one."""
    ends = pa.concat_arrays([*[b.column(0) for b in run], *[b.column(1) for b in run]])
    keys = _sortable(ends)
    where = dict(zip(reversed(keys), range(len(keys) - 1, -1, -1)))
    order = sorted(where)
    rank = {k: i for i, k in enumerate(order)}
    lead = list(range(len(order)))

    def top(i: int) -> int:
        while lead[i] != i:
            lead[i] = i = lead[lead[i]]
        return i

    half = len(keys) // 2
    for a, b in zip(keys[:half], keys[half:]):
        x, y = top(rank[a]), top(rank[b])
        lead[max(x, y)] = min(x, y)
    links = [(i, top(i)) for i in range(len(order)) if top(i) != i]
    at = [pa.array([where[order[e[k]]] for e in links], pa.int64()) for k in (0, 1)]
    return pa.RecordBatch.from_arrays([ends.take(at[0]), ends.take(at[1])], names=["u", "v"])


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, RUN):
            part = batch.slice(at, RUN)
            if size + part.num_rows > RUN:
                yield _stars(held)
                held, size = [], 0
            held.append(part)
            size += part.num_rows
    if size:
        yield _stars(held)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point the larger (or smaller-or-equal) neighbours of each node at its minimum."""
    if large:
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        sym = edges  # stored with u > v
    lowest = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = sym.join(lowest, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return (
        out.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60, within: str | None = None) -> DataFrame:
    """Return ``(node, component)`` for every node on an edge; ``component`` is the smallest node.

    Rows with a null end and self loops are ignored. ``within`` names a column that is equal
    for all edges of a component, as a page is; edges are brought together by it, so that
    most components are found at once. Raises ``RuntimeError`` if the edges have not
    settled after ``max_rounds`` rounds (each at least halves the paths).
    """
    pairs = edges.where(F.col(src) != F.col(dst))
    if within is not None:
        pairs = pairs.hint("rebalance", F.col(within))  # a large part is split again, which contraction allows
    pairs = pairs.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    kind = pairs.schema["u"].dataType
    schema = StructType([StructField("u", kind), StructField("v", kind)])
    now = materialize(pairs.mapInArrow(_contract, schema).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        state = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if 0 < state["n"] <= RUN:
            now = materialize(now.coalesce(1).mapInArrow(_contract, schema), "cc")  # a run's size at most
            state = None
        if state is None or state["n"] == 0 or (state["n"], state["h"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = (state["n"], state["h"])
        following = materialize(_star(_star(now, large=True), large=False), "cc")
        discard(now)
        now = following
    raise RuntimeError("the components did not settle")
