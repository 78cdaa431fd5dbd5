"""SimHash near-duplicates with pigeonring candidate filtering.

Two 64-bit fingerprints within ``max_bits`` differ little on a ring of ``segments``
bit segments: some start exists from which every chain of l consecutive segments has
at most floor(l * max_bits / segments) differing bits (Qin and Xiao, "Pigeonring",
VLDB 2018). Chains with budget zero must be equal, which makes them join keys; the
longer chains prune the joined pairs, and the full ring is the Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.operators.components import connected_components
from pagelattice.runtime import materialize

SHINGLE = 3
SEED = 42
BITS = 64
MAX_BITS = 2
SEGMENTS = 5
_CHUNK = 1 << 15
#: Up to so many ids that go are broadcast, 9 MB, instead of moving the texts to them.
FEW_IDS = 1 << 20


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the word shingles; null and wordless texts give zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return 0
    if len(words) <= shingle:
        grams: Iterator[bytes] = iter([b" ".join(words)])
        total = 1
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        total = len(words) - shingle + 1
    digest, counts, left = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), total
    while left:
        n = min(left, _CHUNK)
        hashes = np.fromiter((digest(g, SEED) for g in islice(grams, n)), np.uint64, n)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
        left -= n
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of given unsigned 64-bit hashes; none give zero."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = np.ascontiguousarray(hashes[at : at + _CHUNK])
        counts += np.add.reduce(np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        out = np.empty(len(texts), np.uint64)
        for i in range(len(texts)):
            out[i] = fingerprint(texts[i].as_py())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` per row; ``fp`` holds the 64 bits as a signed long."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return ids.mapInArrow(_fingerprint_batches, "id long, fp long")


def _segments(segments: int) -> list[tuple[int, int]]:
    """(first bit, width) of each ring segment."""
    cuts = [i * BITS // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def chains(max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> list[list[tuple[int, int]]]:
    """For each start on the ring, ``(mask, budget)`` of the chains of 1 to ``segments`` segments."""
    if segments <= max_bits:
        raise ValueError("more segments than differing bits are needed")
    masks = [((1 << w) - 1) << a for a, w in _segments(segments)]
    return [
        [(sum(masks[(i + j) % segments] for j in range(n)), n * max_bits // segments) for n in range(1, segments + 1)]
        for i in range(segments)
    ]


def near_pairs(distinct: DataFrame, max_bits: int = MAX_BITS, segments: int = SEGMENTS) -> DataFrame:
    """All pairs ``(a, b)``, a < b, of distinct fingerprints (column ``fp``) within ``max_bits``.

    The key of a start holds every chain whose budget is zero; the join condition
    holds the others. A pair found from several starts is reported once. A bucket can
    only hold fingerprints that differ outside its key, and each has at most
    sum(C(64, k), k <= max_bits) true partners, so links stay linear in the input.
    """
    rings = chains(max_bits, segments)
    keys, later = [], []
    for i, ring in enumerate(rings):
        equal = [mask for mask, budget in ring if budget == 0][-1]
        keys.append(F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_signed(equal))).alias("part")))
        # the last chain of each budget implies the shorter ones of that budget
        last = {budget: mask for mask, budget in ring if budget}
        later.append(sorted(last.items()))
    probes = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.start", "k.part")
    left, right = probes.alias("l"), probes.alias("r")
    diff = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    near = (F.col("l.start") == F.col("r.start")) & (F.col("l.part") == F.col("r.part")) & (F.col("l.fp") < F.col("r.fp"))
    for step in range(len(later[0])):
        budget = later[0][step][0]
        mask = F.element_at(F.array(*[F.lit(_signed(x[step][1])) for x in later]), F.col("l.start") + 1)
        near &= F.bit_count(diff.bitwiseAND(mask)) <= budget
    return left.join(right, near).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    max_bits: int = MAX_BITS,
    segments: int = SEGMENTS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Equal fingerprints collapse to one class before any pair is made, so copies cost
    one row. Null and empty texts have fingerprint zero and link like any other.
    ``component_id`` is the smallest non-null id reachable; rows with a null id take
    part and get the component's id, null if no member has an id. Repeated rows give
    repeated results. Other columns are ignored; an empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "simhash")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least_id"))
    comps = connected_components(near_pairs(prints.select("fp").distinct(), max_bits, segments), "a", "b")
    labelled = classes.join(comps.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least_id", F.coalesce("component", "fp").alias("component")
    )
    least = labelled.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = labelled.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its near-duplicate component.

    Rows with a null id cannot be told apart and stay. Of rows that repeat a kept
    id one of each text stays, the first by all columns. The columns are those of ``docs``.
    """
    return least_of_each(docs, near_duplicates(docs, id_col=id_col, text_col=text_col, **params), id_col, text_col)


def least_of_each(docs: DataFrame, near: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near`` (``doc_id, component_id``) names by their component's id, as in ``keep_first``.

    The ids that go, and those of several rows, are anti-joined: texts move only where these are many.
    """
    ids = near.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__id"))
    ids = ids.agg(F.count(F.lit(1)).alias("__rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("__kept"))
    apart = materialize(ids.where((F.col("__rows") > 1) | ~F.col("__kept")).select("__id", (F.col("__kept") & (F.col("__rows") > 1)).alias("__again")), "apart")
    if apart.count() <= FEW_IDS:
        apart = F.broadcast(apart)
    same = docs[id_col].cast("long") == apart["__id"]
    once = docs.join(apart, same, "left_anti")  # rows with a null id among them
    again = docs.join(apart.where("__again"), same, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    again = again.groupBy(F.col(id_col).alias("__i"), F.col(text_col).alias("__t")).agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return once.unionByName(again)


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
