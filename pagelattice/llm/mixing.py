"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Rows of each source are put in a seeded random order and cut into blocks. One block is
emitted per slot. Block k of a source of weight w may run from slot floor(k / w) (its
release) and must run before slot ceil((k + 1) / w) (its deadline); among the released
blocks the one with the earliest deadline runs. On one processor this meets every
window, so at any slot every source is less than one block from its target share
(Baruah et al., "Proportionate Progress", 1996).

Weights are taken as exact rational numbers, so the deviation does not grow with the
rows. When a source runs out, the weights of the remaining ones are rescaled (a new
phase): progress is counted in a virtual time v in which every source of weight w has
been due w * v blocks, and slot sum(min(w * v, blocks)) belongs to v. Windows follow from
it by whole-number arithmetic; as the fluid schedule fills every slot and keeps every
window, earliest deadline first keeps them too, over all phases. The driver lays out one
entry per block, not per row, and the rows find theirs by a join. It lays out ``MAX_BLOCKS``
at most, whatever the size of the corpus: blocks of larger corpora hold more rows.
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_right
from fractions import Fraction
from itertools import accumulate
from math import lcm

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelattice.operators.ranking import bucket_count, bucketed_rank
from pagelattice.runtime import materialize

BLOCK_ROWS = 32
#: Bound of the driver's schedule, but for one block more of each source; beyond it blocks hold more rows.
MAX_BLOCKS = 1 << 19
SEED = "mix-1"
#: Without given weights a source weighs its row count to this power.
TEMPERATURE = 0.5


def exact_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportions of ``weights``."""
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*(x.denominator for x in exact.values()))
    return {s: x.numerator * (unit // x.denominator) for s, x in exact.items()}


def timetable(blocks: dict[str, int], weights: dict[str, float]) -> tuple[list[str], dict[str, array]]:
    """The sources, and columns ``source`` (its index), ``block, release, deadline, phase`` by slot.

    Every block has a slot in its window, so before the first source ends, and after
    every end against the rescaled weights, no source is a whole block off its target.
    """
    whole = exact_weights({s: weights[s] for s, n in blocks.items() if n})
    names = sorted(whole)
    weight, count = [whole[s] for s in names], [blocks[s] for s in names]
    ending: dict[Fraction, list[int]] = {}
    for i, (n, w) in enumerate(zip(count, weight)):
        ending.setdefault(Fraction(n, w), []).append(i)
    ends = sorted(ending)  # in virtual time; phase p lasts until ends[p]
    gone = [0, *accumulate(sum(count[i] for i in ending[e]) for e in ends)]
    left = [sum(weight) - x for x in (0, *accumulate(sum(weight[i] for i in ending[e]) for e in ends))]
    out = {c: array("q") for c in ("source", "block", "release", "deadline", "phase")}
    coming = [(0, i, 0, 0) for i in range(len(names))]  # release, source, block, phase
    ready: list[tuple] = []
    for t in range(sum(count)):
        while coming and coming[0][0] <= t:
            release, i, k, phase = heapq.heappop(coming)
            w, after = weight[i], phase
            if (k + 1) * ends[phase].denominator >= ends[phase].numerator * w:
                after = bisect_right(ends, Fraction(k + 1, w), phase)
            slots, part = divmod((k + 1) * left[after], w)
            following = gone[after] + slots
            heapq.heappush(ready, (following + (part > 0), i, k, release, phase, following, after))
        deadline, i, k, release, phase, following, after = heapq.heappop(ready)
        for c, x in zip(out.values(), (i, k, release, deadline, phase)):
            c.append(x)
        if k + 1 < count[i]:
            heapq.heappush(coming, (following, i, k + 1, after))
    return names, out


def _slots(counts: dict[str, int], weights: dict[str, float], block_rows: int) -> list[tuple]:
    """A row for each source: its name and, by block, slot, release, deadline, phase and the position of the first row."""
    names, at = timetable({s: -(-n // block_rows) for s, n in counts.items()}, weights)
    left, out, start = [counts[s] for s in names], [([], [], [], [], []) for _ in names], 0
    for slot, (i, release, deadline, phase) in enumerate(zip(at["source"], at["release"], at["deadline"], at["phase"])):
        for column, x in zip(out[i], (slot, release, deadline, phase, start)):
            column.append(x)
        rows = min(left[i], block_rows)
        left[i], start = left[i] - rows, start + rows
    return [(s, *columns) for s, columns in zip(names, out)]


_COLUMNS = ("slot", "release", "deadline", "phase", "start")


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    seed: str = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep_columns: bool = False,
    position: str = "__position",
    max_blocks: int = MAX_BLOCKS,
) -> DataFrame:
    """Give every row its place in a sequence that follows the target weights.

    ``weights`` maps sources to positive numbers; sources it lacks share the stratum
    of the key ``""`` (weight 1 unless given). Without ``weights`` every source counts
    rows ** ``TEMPERATURE``. A null source is in the stratum of the empty one. Any number
    of sources is mixed, each to its own weight. Blocks hold ``block_rows`` rows, or as
    many as make ``max_blocks`` blocks of all rows where that is more.

    Returns ``doc_id, source, block, slot, release, deadline, phase, position``
    (release and deadline in slots; position gapless from 0), or with
    ``keep_columns`` the columns of ``docs`` and ``position``. Nothing is dropped
    or repeated: repeated rows keep a place each, null ids and texts are ordinary
    values, an empty table gives no rows.
    """
    spark = docs.sparkSession
    known = sorted(weights) if weights else None
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    key = F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string"), F.xxhash64(F.col(text_col)).cast("string"))
    picked = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")] if keep_columns else []
    rows = docs.select(
        F.col(id_col).alias("__id"),
        (F.when(source.isin(known), source).otherwise(F.lit("")) if known else source).alias("__source"),
        F.md5(key).alias("__h"),
        *picked,
    )
    if not keep_columns:
        rows = materialize(rows, "mix")
    counts = {r["__source"]: r["n"] for r in rows.groupBy("__source").agg(F.count(F.lit(1)).alias("n")).collect()}
    weigh = {s: (weights.get(s, 1.0) if weights else n**TEMPERATURE) for s, n in counts.items()}
    total = sum(counts.values())
    block_rows = max(block_rows, -(-total // max_blocks))
    buckets = bucket_count(total)
    rows = rows.withColumn("__b", F.shiftright(F.conv(F.substring("__h", 1, 8), 16, 10).cast("long") * F.lit(buckets), 32).cast("int"))
    ranked = bucketed_rank(rows, ["__source"], "__b", ["__h", "__id"], "__rank").withColumn(
        "__block", F.expr(f"__rank div {block_rows}L")
    )
    # max_blocks and a block more for each source at most; Spark chooses the join
    kinds = ", ".join(f"__{c} array<{kind}>" for c, kind in zip(_COLUMNS, ("long", "long", "long", "int", "long")))
    plan = spark.createDataFrame(_slots(counts, weigh, block_rows), f"__source string, {kinds}")
    plan = plan.select("__source", F.posexplode(F.arrays_zip(*[f"__{c}" for c in _COLUMNS])).alias("__block", "__at")).select("__source", "__block", "__at.*")
    timed = ranked.join(plan, ["__source", "__block"]).withColumn("__position", F.col("__start") + F.expr(f"__rank % {block_rows}L"))
    if keep_columns:
        return timed.select("__row.*", F.col("__position").alias(position))
    return timed.select(
        F.col("__id").alias("doc_id"),
        F.col("__source").alias("source"),
        F.col("__block").alias("block"),
        F.col("__slot").alias("slot"),
        F.col("__release").alias("release"),
        F.col("__deadline").alias("deadline"),
        F.col("__phase").alias("phase"),
        F.col("__position").alias("position"),
    )


def in_mixed_order(docs: DataFrame, **params) -> DataFrame:
    """The rows and columns of ``docs``, laid out over partitions in the mixed order."""
    spark = docs.sparkSession
    at = "__position"
    while at.lower() in (c.lower() for c in docs.columns):
        at += "_"
    placed = mix(docs, keep_columns=True, position=at, **params)
    return laid_out(placed, at, docs.count()).drop(at)


def laid_out(placed: DataFrame, position: str, total: int) -> DataFrame:
    """Equal runs of the sequence, one to a partition, in order between and within them."""
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = F.expr(f"cast((`{position}` * {parts}L) div {max(total, 1)}L as int)")
    return placed.repartitionById(parts, run).sortWithinPartitions(position)


def read_in_order(docs: DataFrame, position: str = "position") -> DataFrame:
    """Files that hold ``in_mixed_order`` rows, with the place of each row in the sequence.

    Spark deals files to tasks by size, so the sequence is taken from the part numbers
    in the file names and the rows' indexes in the files.
    """
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    try:
        rows = docs.select("*", name.alias("__file"), row.alias("__row"))
    except AnalysisException:  # not read from files
        rows = materialize(docs, "mix").select("*", name.alias("__file"), row.alias("__row"))
    part = F.regexp_extract("__file", r"^part-(\d+)", 1).try_cast("long")
    before = Window.partitionBy().orderBy(part, "__file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("__file").agg((F.max("__row") + 1).alias("__n"))  # one row a file
    files = files.select("__file", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(files), "__file").withColumn(position, F.col("__before") + F.col("__row")).drop("__file", "__row", "__before")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
