"""Near duplicates by the Jaccard similarity of word shingles, for the corpus pipeline.

Candidates come from two searches, and every one is verified on all shingles at a
similarity of 0.8 before it is linked:

* SimHash fingerprints of the same shingles, searched by pigeonring chains
  (``simhash.near_pairs``), find most near copies but by far not all: two of 64 bits are a
  narrower limit than a similarity of 0.8.
* Two sets of similarity 0.8 share one of the first n - ceil(0.8 n) + 1 elements of each in
  any common order (prefix filtering; Chaudhuri et al., "A Primitive Operator for Similarity
  Joins in Data Cleaning", ICDE 2006), at places that leave room for the overlap they need.
  This search is complete. Its order puts the commonest shingles last, so that passages
  which many documents share seldom lie in a prefix; any order gives the same links.

Documents that share a prefix shingle are not all paired. Each is compared to one pivot of
the shingle first, then, while that joins components, to further pivots. At last all pairs
are compared that share a prefix shingle and are still in different components. A pair within
one component cannot change the result, so components are those of all links, while a
group of copies costs links in its size and not its square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelattice.llm import simhash
from pagelattice.operators.components import connected_components
from pagelattice.runtime import discard, keeps, materialize, tidy

SHINGLE = 5
SEED = 42
#: Bound of the list of common shingles that is sent to the executors; it shapes the order only.
HOT = 1 << 16
#: A shingle is common from so many documents on, and from this share of all of them.
HOT_LEAST, HOT_SHARE = 32, 1 << 14
#: Common shingles are dealt into so many parts, each with a pivot of its own.
SALTS = 32
#: All pairs across components are made once there are so few of them for each shared shingle;
#: before that, for so many turns at most and while a share of them links, members are
#: compared to more pivots, of so many orders.
PAIRS_A_TOKEN, TURNS, ORDERS, YIELD = 8, 4, 16, 0.05
#: Classes of shingles whose parities are compared, a multiple of 64.
PARITIES = 256
#: Up to so many ids are broadcast, 8 MB, instead of moving the texts to them.
FEW_IDS = 1 << 20
_HELD = 1 << 19
_SLICE = 256
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class _Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1 << 16:
            self.clear()
        found = xxhash.xxh64_intdigest(word, SEED)
        if len(word) <= 64:
            self[word] = found
        return found


_WORDS = _Words()
keeps(__name__, _WORDS.clear)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the word shingles in order; shorter texts are one shingle, wordless ones have none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII case and white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - shingle + 1)
    out = np.full(n, np.uint64(min(len(words), shingle)), np.uint64)
    for k in range(min(len(words), shingle)):
        out = out * _STEP + h[k : k + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, as signed longs."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def _prefix(n: int) -> int:
    """How many first elements of ``n`` are enough at similarity 0.8."""
    return n - (4 * n + 4) // 5 + 1 if n else 0


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches, so that few documents' sets are held at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE):
            yield batch.slice(at, _SLICE)


def _kinds(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64))


def _parities(s: np.ndarray, classes: int) -> np.ndarray:
    odd = np.bincount(s & (classes - 1), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *found])))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that several documents of a bounded run share, with how many do."""
    held: list[np.ndarray] = []

    def counted() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(h[n > 2]), pa.array(n[n > 2].astype(np.int64))], names=["h", "n"])

    size = 0
    for batch in batches:
        for text in batch.column(0):
            held.append(shingles(text.as_py()))
            size += len(held[-1])
            if size >= _HELD:
                yield counted()
                size = 0
    yield counted()


def common_shingles(texts: DataFrame) -> np.ndarray:
    """The commonest shingles of the column ``text``, rarest first, ``HOT`` at most; runs of all documents are counted."""
    counts = texts.select("text").mapInArrow(tidy(__name__, _repeated), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    least = max(HOT_LEAST, texts.count() // HOT_SHARE)
    top = counts.where(F.col("n") >= least).orderBy(F.desc("n"), "h").limit(HOT)
    return np.array([r["h"] for r in top.collect()][::-1], np.int64)


def _sketches(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """``(id, kind, n, fp, sketch, hot, bits, wide)``: a set's hash, size, fingerprint and prefix, whose last ``hot`` elements are common.

    ``bits`` holds the parity of the elements in each of ``PARITIES`` classes, ``wide`` that
    in the next power of two of ``n`` classes: as many bits of two sets differ as
    elements do at most (Sandes et al., "Bitmap Filter", 2020).
    """
    order = np.argsort(common)
    shared = texts.sparkSession.sparkContext.broadcast((common[order], order))  # at most HOT entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rank = shared.value
        for batch in sliced(batches):
            sets, fps, sketch, hot, bits, wide = [], [], [], [], [], []
            for text in batch.column(1):
                s = shingle_hashes(text.as_py())
                fps.append(simhash.majority(s))
                s = np.unique(s.view(np.int64))
                at = np.searchsorted(known, s)
                is_common = known[np.minimum(at, len(known) - 1)] == s if len(known) else np.zeros(len(s), bool)
                cold, want = s[~is_common], _prefix(len(s))
                sets.append(s)
                bits.append(_parities(s, PARITIES))
                wide.append(_parities(s, max(PARITIES, 1 << (len(s) - 1).bit_length()) if len(s) else PARITIES))
                if want <= len(cold):
                    sketch.append(cold[:want])
                    hot.append(0)
                else:
                    last = s[is_common]
                    last = last[np.argsort(rank[at[is_common]])][: want - len(cold)]
                    sketch.append(np.concatenate([cold, last]))
                    hot.append(len(last))
            columns = [
                batch.column(0), _kinds(sets), pa.array([len(s) for s in sets], pa.int32()), pa.array(np.array(fps, np.uint64).view(np.int64)),
                _lists(sketch), pa.array(hot, pa.int32()), _lists(bits), _lists(wide),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "kind", "n", "fp", "sketch", "hot", "bits", "wide"])

    return texts.mapInArrow(tidy(__name__, run), "id long, kind long, n int, fp long, sketch array<long>, hot int, bits array<long>, wide array<long>")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [shingles(x.as_py()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([_kinds(sets), _lists(sets)], names=["kind", "grams"])


def _fits(na: str, xa: str, nb: str, xb: str) -> Column:
    """Whether two sets that first meet at these places of their orders leave room for the overlap they need.

    It holds at the first element two similar sets have in common, so a pair is kept if it holds at any.
    """
    need = F.ceil((F.col(na) + F.col(nb)) * 4 / 9)
    return (F.col(na) - F.col(xa) >= need) & (F.col(nb) - F.col(xb) >= need)


def _alike(na: str, bits_a: str, nb: str, bits_b: str) -> Column:
    """Whether the parities leave a similarity of 0.8 open."""
    apart = sum((F.bit_count(F.col(bits_a)[k].bitwiseXOR(F.col(bits_b)[k])) for k in range(PARITIES // 64)), F.lit(0))
    return 9 * apart <= F.col(na) + F.col(nb)


def _ordered(a: str, na: str, b: str, nb: str) -> list[Column]:
    """``a, b, na, nb`` with the smaller kind first."""
    first = F.col(a) < F.col(b)
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(first, F.col(na)).otherwise(F.col(nb)).alias("na"), F.when(first, F.col(nb)).otherwise(F.col(na)).alias("nb")]


def shared_tokens(prints: DataFrame) -> DataFrame:
    """``(h, part, kind, n, at, pivot)`` of prefix elements that more than one kind has; written once."""
    kinds = prints.where("n > 0").groupBy("kind").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "hot")])
    exploded = kinds.select("kind", "n", "hot", F.size("sketch").alias("m"), F.posexplode("sketch").alias("at", "h"))
    is_hot = F.col("at") >= F.col("m") - F.col("hot")
    tokens = exploded.select("h", F.when(is_hot, F.pmod("kind", F.lit(SALTS))).otherwise(-1).cast("int").alias("part"), "kind", "n", "at")
    tokens = tokens.repartition("h", "part")  # counted and joined in this one layout
    found = tokens.groupBy("h", "part").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("kind", "n", "at")).alias("pivot"))
    found = found.where((F.col("m") > 1) | (F.col("part") >= 0)).drop("m")
    return materialize(tokens.join(found, ["h", "part"]).select("h", "part", "kind", "n", "at", "pivot"), "copies")


def pivot_pairs(shared: DataFrame) -> DataFrame:
    """Each kind with the pivot of its shingle's part, and the parts' pivots with the first one."""
    own = shared.select("kind", "n", "at", F.col("pivot.kind").alias("p"), F.col("pivot.n").alias("np"), F.col("pivot.at").alias("xp"))
    parts = shared.where("part >= 0").select("h", "pivot").distinct()
    first = parts.groupBy("h").agg(F.min("pivot").alias("p"))
    heads = parts.join(first, "h").select("pivot.*", F.col("p.kind").alias("p"), F.col("p.n").alias("np"), F.col("p.at").alias("xp"))
    return own.unionByName(heads).where((F.col("kind") != F.col("p")) & _fits("n", "at", "np", "xp")).select(*_ordered("kind", "n", "p", "np")).distinct()


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """Kinds whose fingerprints lie on one pigeonring chain; equal fingerprints are paired with one of them."""
    kinds = prints.where("n > 0").select("kind", "n", "fp").distinct()
    of = kinds.groupBy("fp").agg(F.min(F.struct("kind", "n")).alias("k"))
    near = simhash.near_pairs(of.select("fp"))
    equal = kinds.join(of, "fp").select("kind", "n", F.col("k.kind").alias("p"), F.col("k.n").alias("np"))
    apart = near.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b")
    apart = apart.select(F.col("x.kind").alias("kind"), F.col("x.n").alias("n"), F.col("y.kind").alias("p"), F.col("y.n").alias("np"))
    close = (5 * F.col("n") >= 4 * F.col("np")) & (5 * F.col("np") >= 4 * F.col("n"))
    return equal.unionByName(apart).where((F.col("kind") != F.col("p")) & close).select(*_ordered("kind", "n", "p", "np"))


def open_tokens(shared: DataFrame, comps: DataFrame, parities: DataFrame) -> DataFrame:
    """``(h, kind, n, at, component, largest, outside, members, bits)`` of shingles whose members are in several components.

    ``largest`` is the component with most of the shingle's members, ``outside`` the number of the others.
    """
    own = shared.join(comps.withColumnRenamed("node", "kind"), "kind", "left").withColumn("component", F.coalesce("component", "kind"))
    own = own.select("h", "kind", "n", "at", "component")
    sizes = own.groupBy("h", "component").agg(F.count(F.lit(1)).alias("m"))
    top = sizes.groupBy("h").agg(F.max(F.struct("m", "component")).alias("top"), F.sum("m").alias("members"), F.count(F.lit(1)).alias("k"))
    top = top.where("k > 1").select("h", F.col("top.component").alias("largest"), (F.col("members") - F.col("top.m")).alias("outside"), "members")
    return materialize(own.join(top, "h").join(parities, "kind"), "copies")


def more_pivot_pairs(opened: DataFrame, turn: int) -> DataFrame:
    """Members outside a shingle's largest component with a pivot inside it, another one each turn."""
    order = F.xxhash64("kind", F.pmod("h", F.lit(ORDERS)), F.lit(turn))
    pivots = opened.where("component = largest").groupBy("h").agg(F.min_by(F.struct("kind", "n", "at", "bits"), order).alias("p"))
    out = opened.where("component <> largest").join(pivots, "h")
    out = out.select("kind", "n", "at", "bits", F.col("p.kind").alias("p"), F.col("p.n").alias("np"), F.col("p.at").alias("xp"), F.col("p.bits").alias("bp"))
    return out.where(_fits("n", "at", "np", "xp") & _alike("n", "bits", "np", "bp")).select(*_ordered("kind", "n", "p", "np")).distinct()


def cross_pairs(opened: DataFrame) -> DataFrame:
    """Pairs of kinds that share a shingle, are in different components and may overlap enough.

    Of a shingle's members those outside its largest component are paired with all others.
    """
    x = opened.where("component <> largest").select("h", F.col("kind").alias("x"), F.col("n").alias("nx"), F.col("at").alias("ax"), F.col("component").alias("cx"), F.col("bits").alias("bx"))
    y = opened.select("h", F.col("kind").alias("y"), F.col("n").alias("ny"), F.col("at").alias("ay"), F.col("component").alias("cy"), F.col("bits").alias("by"), "largest")
    once = (F.col("cy") == F.col("largest")) | (F.col("x") < F.col("y"))
    met = x.join(y, "h").where((F.col("cx") != F.col("cy")) & once & _fits("nx", "ax", "ny", "ay") & _alike("nx", "bx", "ny", "by"))
    return met.select(*_ordered("x", "nx", "y", "ny")).distinct()


def pruned(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs whose wide parities leave a similarity of 0.8 open; no set is moved for the others.

    Sizes of a pair are within a fifth, so one has at most twice the classes of the other,
    and two of its halves fold into the fewer classes.
    """
    def folded(c: str, to: Column) -> Column:
        half = F.transform(F.sequence(F.lit(0), to - 1), lambda i: F.col(c)[i].bitwiseXOR(F.col(c)[i + to]))
        return F.when(F.size(c) == to, F.col(c)).otherwise(half)

    both = pairs.join(wide.toDF("a", "wa"), "a").join(wide.toDF("b", "wb"), "b")
    to = F.least(F.size("wa"), F.size("wb"))
    apart = F.aggregate(F.zip_with(folded("wa", to), folded("wb", to), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return both.where(9 * apart <= F.col("na") + F.col("nb")).select("a", "b", "na", "nb")


class _Verifier:
    """Checks pairs on all shingles; the sets of kinds are read from the documents once each."""

    def __init__(self, docs: DataFrame, narrow: DataFrame, wide: DataFrame, id_col: str, text_col: str) -> None:
        self.docs, self.narrow, self.wide, self.id_col, self.text_col = docs, narrow, wide, id_col, text_col
        self.sets: DataFrame | None = None
        self.tables: list[DataFrame] = []

    def _read(self, wanted: DataFrame) -> None:
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("kind"), "kind", "left_anti")
        wanted = materialize(wanted, "copies")
        # one document of each kind; of repeated ids and null ones all are read
        ids = self.narrow.join(wanted, "kind", "left_semi").groupBy("kind").agg(F.min("id").alias("id"))
        ids = materialize(ids.where("id is not null").select(F.col("id").alias("__id")).distinct(), "copies")
        if ids.count() <= FEW_IDS:
            ids = F.broadcast(ids)
        named = self.docs.join(ids, F.col(self.id_col).cast("long") == F.col("__id"), "left_semi")
        texts = named.unionByName(self.docs.where(F.col(self.id_col).isNull())).select(F.col(self.text_col).cast("string").alias("text"))
        sets = texts.mapInArrow(tidy(__name__, _whole), "kind long, grams array<long>").join(wanted, "kind", "left_semi").dropDuplicates(["kind"])
        self.tables.append(materialize(sets, "copies"))
        self.sets = self.tables[-1] if self.sets is None else self.sets.unionByName(self.tables[-1])

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``(a, b, na, nb)`` whose shingle sets have a similarity of 0.8 or more, as ``(a, b)``."""
        pairs = materialize(pruned(pairs, self.wide), "copies")
        self._read(pairs.select(F.col("a").alias("kind")).union(pairs.select("b")).distinct())
        both = pairs.join(self.sets.toDF("a", "ga"), "a").join(self.sets.toDF("b", "gb"), "b")
        same = F.size(F.array_intersect("ga", "gb"))
        return materialize(both.where(9 * same >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"), "copies")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, component_id)`` per row: the smallest id reachable over pairs of similarity 0.8.

    Equal sets collapse to one kind before any pair is made. Null and wordless texts
    are equal to each other and to nothing else.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    prints = materialize(_sketches(texts, common_shingles(texts)), "copies")
    narrow = prints.select("id", "kind")
    shared = shared_tokens(prints)
    parities = prints.groupBy("kind").agg(F.first("bits").alias("bits"))
    wide = prints.groupBy("kind").agg(F.first("wide").alias("wide"))
    check = _Verifier(docs, narrow, wide, id_col, text_col)
    links = check.links(materialize(pivot_pairs(shared).union(fingerprint_pairs(prints)).distinct(), "copies"))
    comps = materialize(connected_components(links, "a", "b"), "copies")
    few = PAIRS_A_TOKEN * shared.count()
    for turn in range(TURNS + 1):
        opened = open_tokens(shared, comps, parities)
        cost = opened.groupBy("h").agg(F.first(F.col("outside") * F.col("members")).alias("c")).agg(F.sum("c")).first()[0] or 0
        if cost <= few or turn == TURNS:
            break
        pairs = materialize(more_pivot_pairs(opened, turn), "copies")
        links = check.links(pairs)
        found = links.count()
        comps = materialize(connected_components(comps.toDF("a", "b").unionByName(links), "a", "b"), "copies")
        if found < YIELD * pairs.count():
            opened = open_tokens(shared, comps, parities) if found else opened
            break
    links = check.links(materialize(cross_pairs(opened), "copies"))
    comps = connected_components(comps.toDF("a", "b").unionByName(links), "a", "b")
    named = (
        narrow.groupBy("kind")
        .agg(F.min("id").alias("least_id"))
        .join(comps.withColumnRenamed("node", "kind"), "kind", "left")
        .select("kind", "least_id", F.coalesce("component", "kind").alias("component"))
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_kind = named.join(least, "component").select("kind", "component_id")
    out = materialize(narrow.join(of_kind, "kind").select(F.col("id").alias("doc_id"), "component_id"), "copies")
    for done in (prints, shared, *check.tables):
        discard(done)
    return out


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component; other rules as in ``simhash.keep_first``."""
    return simhash.least_of_each(docs, near_copies(docs, id_col, text_col), id_col, text_col)
