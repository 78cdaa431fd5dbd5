"""Toxicity: a convolutional text classifier over hashed word embeddings, in numpy.

A word is the sum of the embeddings of its hash and of its first 4 to 7 bytes' hashes.
Filters of widths 1, 2 and 3 run over the words; each is max-pooled over eight
interleaved segments of the text, and its three largest segment values go, with the
text's length, through one hidden layer. Word hashes of a whole batch are differences of
one running polynomial sum, so no word is ever a Python object.

The embeddings start from the log-odds of a bounded sample of labelled rows and are trained
on it with all else by Adam. Where there are more labelled rows, rounds over all of them
follow: shards of rows train the shared arrays apart, whose mean is the next round's start.
Scores are scaled on a part of the labelled rows that the fit does not see, which also gives
a threshold for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.runtime import discard, keeps, materialize, tidied, tidy

BUCKETS = 1 << 16
DIM, FILTERS, WIDTHS, HIDDEN = 8, 8, (1, 2, 3), 16
SEGMENTS, RUN, TOP = 8, 4, 3
PREFIXES = (4, 5, 6, 7)
#: Bounds of the labelled sample the fit begins with: rows of either class, characters
#: of a text and of all texts of a class.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS, TRAIN_TOTAL = 2500, 4500, 200_000, 24_000_000
THRESHOLD = 0.3
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 64, 0.01, 1e-4, 7
#: Rounds over all labelled rows and their rate; characters of a shard, and shards at most.
ROUNDS, ROUND_RATE, SHARD_CHARS, SHARDS = 2, 0.002, 8_000_000, 32
#: Characters of the sample that come to the driver at a time, more or less.
FETCH_CHARS = 1_000_000
#: Bits of the filter of labelled ids at most, and steps of a logit in the scale's counts.
ID_BITS, STEPS = 1 << 26, 256
#: Languages with fewer labelled rows of either class aside from the fit keep ``THRESHOLD``.
LEAST_ROWS = 12
_PIECE = 1 << 20

_FOLD = bytes.maketrans(
    bytes(range(128)), bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(128))
)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POW: list[np.ndarray] = []
keeps(__name__, _POW.clear)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, _PIECE + 1)
        _POW[:] = [_powers(int(_BASE), size), _powers(pow(int(_BASE), -1, 1 << 64), size)]
    return _POW[0], _POW[1]


def _buckets(sums: np.ndarray, k: int) -> np.ndarray:
    """Buckets of polynomial sums; ``k`` tells whole words from prefixes."""
    h = sums + np.uint64(k + 1)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return 1 + (h % np.uint64(BUCKETS - 1)).astype(np.int32)


def word_units(folded: bytes) -> np.ndarray:
    """(words, 1 + prefixes) buckets of the words of folded bytes; bucket 0 stands for no word."""
    data = np.frombuffer(folded, np.uint8)
    solid = data != 32
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.empty((len(start), 1 + len(PREFIXES)), np.int32)
    if not len(start):
        return out
    power, inverse = _tables(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    back, base = inverse[start], total[start]
    for k, n in enumerate((None, *PREFIXES)):
        stop = end if n is None else np.minimum(end, start + n)
        out[:, k] = _buckets((total[stop] - base) * back, k)
    return out


def long_word_units(folded: bytes, start: int, end: int) -> np.ndarray:
    """The same row of one word of any length: its sum is carried from piece to piece."""
    out = word_units(folded[start : min(end, start + max(PREFIXES))])
    total, ahead = 0, 1
    step = pow(int(_BASE), _PIECE, 1 << 64)
    for at in range(start, end, _PIECE):
        data = np.frombuffer(folded, np.uint8, min(end - at, _PIECE), at).astype(np.uint64) + np.uint64(1)
        total += int((data * _tables(len(data))[0][: len(data)]).sum(dtype=np.uint64)) * ahead
        ahead = ahead * step % (1 << 64)
    out[0, 0] = _buckets(np.array([total % (1 << 64)], np.uint64), 0)[0]
    return out


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def _pieces(folded: bytes) -> Iterator[tuple[np.ndarray, bool]]:
    """Word units of bounded pieces of a long text, cut at spaces, and which are the last; a longer word is a piece."""
    at = 0
    while len(folded) - at > _PIECE:
        cut = folded.rfind(b" ", at, at + _PIECE)
        if cut > at:
            yield word_units(folded[at:cut]), False
        else:
            start = at + (folded[at] == 32)
            cut = folded.find(b" ", start)
            cut = len(folded) if cut < 0 else cut
            yield long_word_units(folded, start, cut) if cut > start else word_units(b""), False
        at = cut
    yield word_units(folded[at:]), True


class Network:
    """The classifier's arrays; ``pooled`` and ``score`` are what executors run."""

    def __init__(self, rng: np.random.Generator) -> None:
        n = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32)
        self.embed[0] = 0
        self.conv = rng.normal(0, 0.3, (DIM, FILTERS * sum(WIDTHS))).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.hidden = rng.normal(0, 0.15, (n * TOP + 1, HIDDEN)).astype(np.float32)
        self.hidden_bias = np.zeros(HIDDEN, np.float32)
        self.out = rng.normal(0, 0.3, HIDDEN).astype(np.float32)
        self.out_bias = np.full(1, -2.0, np.float32)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}

    def responses(self, units: np.ndarray) -> np.ndarray:
        """Filter values at each start; the last ``max(WIDTHS) - 1`` rows of ``units`` are only looked into."""
        e = self.embed[units[:, 0]]
        for k in range(1, units.shape[1]):
            e += self.embed[units[:, k]]
        y = e @ self.conv
        n, out, at = len(units) - max(WIDTHS) + 1, [], 0
        for w in WIDTHS:
            part = y[:n, at : at + FILTERS].copy()
            for o in range(1, w):
                part += y[o : o + n, at + o * FILTERS : at + (o + 1) * FILTERS]
            out.append(part)
            at += w * FILTERS
        return np.concatenate(out, axis=1)

    def pooled(self, folded: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, segments, filters) maxima before the bias, and word counts; no words give zero responses."""
        best = np.full((len(folded), SEGMENTS, FILTERS * len(WIDTHS)), -np.inf, np.float32)
        count = np.zeros(len(folded), np.int64)
        group, held = [], 0
        for i, text in enumerate(folded):
            if len(text) > _PIECE:
                tail = np.empty((0, 1 + len(PREFIXES)), np.int32)
                for units, last in _pieces(text):
                    units = np.concatenate([tail, units])
                    first = count[i] - len(tail)
                    count[i] = first + len(units)
                    if last:
                        units = np.concatenate([units, np.zeros((max(WIDTHS) - 1, units.shape[1]), np.int32)])
                    tail = units[len(units) - (max(WIDTHS) - 1) :] if len(units) >= max(WIDTHS) - 1 else units
                    if len(units) >= max(WIDTHS):
                        self._pool(units, np.full(len(units) - max(WIDTHS) + 1, i), np.arange(first, first + len(units) - max(WIDTHS) + 1), best)
                continue
            group.append(i)
            held += len(text)
            if held > _PIECE // 2:
                self._group(folded, group, best, count)
                group, held = [], 0
        self._group(folded, group, best, count)
        best[~np.isfinite(best)] = 0
        return best, count

    def _group(self, folded: list[bytes], group: list[int], best: np.ndarray, count: np.ndarray) -> None:
        if not group:
            return
        joined = b" ".join(folded[i] for i in group)
        units = word_units(joined)
        sizes = np.array([len(folded[i]) + 1 for i in group])
        data = np.frombuffer(joined, np.uint8) != 32
        starts = np.flatnonzero(data & ~np.concatenate([[False], data[:-1]])) if len(data) else np.empty(0, np.int64)
        doc = np.searchsorted(np.cumsum(sizes), starts, side="right")
        n = np.bincount(doc, minlength=len(group))
        count[group] = n
        pad = max(WIDTHS) - 1
        place = np.arange(len(units)) + pad * doc
        spaced = np.zeros((len(units) + pad * len(group), units.shape[1]), np.int32)
        spaced[place] = units
        if not len(units):
            return
        word = np.arange(len(units)) - (np.cumsum(n) - n)[doc]
        self._pool(spaced, np.array(group)[doc], word, best, place)

    def _pool(self, units: np.ndarray, doc: np.ndarray, word: np.ndarray, best: np.ndarray, place: np.ndarray | None = None) -> None:
        y = self.responses(units)
        if place is not None:
            y = y[place]
        key = doc * SEGMENTS + word // RUN % SEGMENTS
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        y, key = np.maximum.reduceat(y, begin, axis=0), key[begin]
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        y, key = np.maximum.reduceat(y[order], begin, axis=0), key[begin]
        flat = best.reshape(-1, best.shape[2])
        flat[key] = np.maximum(flat[key], y)

    def logits(self, pooled: np.ndarray, count: np.ndarray) -> np.ndarray:
        top = np.sort(pooled, axis=1)[:, : -TOP - 1 : -1]
        x = np.maximum(top + self.bias, 0).reshape(len(pooled), -1)
        x = np.concatenate([x, np.log1p(count)[:, None].astype(np.float32) / 10], axis=1)
        return np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias[0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        z = self.scale * self.logits(*self.pooled([fold(t) for t in texts])).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    # -- fitting ---------------------------------------------------------------------

    def start_from(self, units: list[np.ndarray], y: np.ndarray) -> None:
        """Put each bucket's smoothed log-odds, in standard errors, into the first dimension."""
        with_toxic, with_clean = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for u, label in zip(units, y):
            (with_toxic if label else with_clean)[np.unique(u)] += 1
        a, b = y.sum() + 1, (1 - y).sum() + 1
        odds = np.log((with_toxic + 0.1) / (a - with_toxic + 0.1)) - np.log((with_clean + 0.1 * b / a) / (b - with_clean + 0.1 * b / a))
        z = odds / np.sqrt(1 / (with_toxic + 0.1) + 1 / (with_clean + 0.1 * b / a))
        self.embed[:, 0] = np.clip(z, -4, 8) / 4
        self.embed[0] = 0
        self.conv[0, 0] = 0.5
        self.hidden[0 : TOP * FILTERS * len(WIDTHS) : FILTERS * len(WIDTHS)] = np.abs(self.hidden[0 : TOP * FILTERS * len(WIDTHS) : FILTERS * len(WIDTHS)])

    def fit(self, units: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
        steps = _Adam(self)
        for epoch in range(EPOCHS):
            order = rng.permutation(len(units))
            for s in range(0, len(order), BATCH):
                at = order[s : s + BATCH]
                steps.take([units[i] for i in at], y[at], weight[at], RATE * (1 - 0.9 * epoch / EPOCHS))

    def _gradients(self, units: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        n, f, pad = len(units), FILTERS * len(WIDTHS), max(WIDTHS) - 1
        spaced = np.concatenate([np.concatenate([u, np.zeros((pad, u.shape[1]), np.int32)]) for u in units])
        r = self.responses(spaced)
        pooled, where = np.full((n, SEGMENTS, f), 0, np.float32), np.full((n, SEGMENTS, f), -1)
        at = 0
        for i, u in enumerate(units):
            part = r[at : at + len(u)]
            if len(u):
                seg = np.arange(len(u)) // RUN % SEGMENTS
                for k in range(min(SEGMENTS, -(-len(u) // RUN))):
                    rows = np.flatnonzero(seg == k)
                    best = part[rows].argmax(axis=0)
                    where[i, k] = at + rows[best]
                    pooled[i, k] = part[rows[best], np.arange(f)]
            at += len(u) + pad
        ranks = np.argsort(pooled, axis=1)[:, : -TOP - 1 : -1]
        top = np.take_along_axis(pooled, ranks, axis=1) + self.bias
        spot = np.take_along_axis(where, ranks, axis=1)
        x = np.concatenate([np.maximum(top, 0).reshape(n, -1), np.log1p([len(u) for u in units])[:, None] / 10], axis=1).astype(np.float32)
        pre = x @ self.hidden + self.hidden_bias
        h = np.maximum(pre, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias[0], -30, 30)))
        d = ((p - y) * weight / n).astype(np.float32)
        dh = np.outer(d, self.out) * (pre > 0)
        dx = (dh @ self.hidden.T)[:, :-1].reshape(n, TOP, f) * (top > 0)
        grads = {"out": h.T @ d, "out_bias": np.array([d.sum()]), "hidden": x.T @ dh, "hidden_bias": dh.sum(0), "bias": dx.sum((0, 1))}
        live = np.nonzero((spot >= 0) & (dx != 0))
        rows, cols, g = spot[live], live[2], dx[live]
        grads["conv"], grads["embed"] = np.zeros_like(self.conv), np.zeros_like(self.embed)
        for k, w in enumerate(WIDTHS):
            mine = cols // FILTERS == k
            for o in range(w):
                column = FILTERS * (sum(WIDTHS[:k]) + o) + cols[mine] % FILTERS
                ids = spaced[rows[mine] + o]
                e = self.embed[ids].sum(axis=1)
                np.add.at(grads["conv"].T, column, e * g[mine][:, None])
                back = self.conv.T[column] * g[mine][:, None]
                for u in range(ids.shape[1]):
                    np.add.at(grads["embed"], ids[:, u], back)
        return grads


_ARRAYS = ("embed", "conv", "bias", "hidden", "hidden_bias", "out", "out_bias")


class _Adam:
    """Steps of a network's arrays along their gradients, with running moments."""

    def __init__(self, net: Network) -> None:
        self.net, self.step = net, 0
        self.moment = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in _ARRAYS}

    def take(self, units: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        self.step += 1
        grads = self.net._gradients(units, y, weight)
        for k in _ARRAYS:
            g, (m, v), p = grads[k], self.moment[k], getattr(self.net, k)
            g = g + DECAY * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-6)
        self.net.embed[0] = 0


def train(texts: list[str | None], labels: list[int], langs: list[str | None], weights: list[float] | None = None, seed: int = SEED) -> Network:
    """Fit on four fifths of the rows; scale scores and set the languages' thresholds on the rest."""
    rng = np.random.default_rng(seed)
    net, y = Network(rng), np.array(labels, np.float64)
    weight = np.ones(len(y)) if weights is None else np.array(weights)
    if not 0 < y.sum() < len(y):  # no rows or one class: its smoothed share is the score of every text
        net.out[:], net.out_bias[:] = 0, 0
        net.shift = float(np.log((y.sum() + 0.05) / (len(y) - y.sum() + 0.95)))
        return net
    units = [word_units(fold(t)) for t in texts]
    aside = rng.permutation(len(y)) % 5 == 0
    if not 0 < y[aside].sum() < aside.sum() or not 0 < y[~aside].sum() < (~aside).sum():
        aside[:] = False
    fit = np.flatnonzero(~aside)
    net.start_from([units[i] for i in fit], y[fit])
    net.fit([units[i] for i in fit], y[fit], weight[fit], rng)
    if aside.any():
        rows = np.flatnonzero(aside)
        z = net.logits(*net.pooled([fold(texts[i]) for i in rows])).astype(np.float64)
        net.scale, net.shift = _platt(z, y[rows], weight[rows])
        score = 1 / (1 + np.exp(-(net.scale * z + net.shift)))
        for lang in sorted({langs[i] for i in rows} - {None}):
            mine = np.array([langs[i] == lang for i in rows])
            if min(y[rows][mine].sum(), (1 - y[rows][mine]).sum()) >= LEAST_ROWS:
                net.thresholds[lang] = _threshold(score[mine], y[rows][mine], weight[rows][mine])
    return net


def _platt(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Logistic scaling by Newton steps, with targets kept off 0 and 1."""
    n1, n0 = (w * y).sum(), (w * (1 - y)).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(w * (p - t) * z).sum() + 1e-2 * (a - 1), (w * (p - t)).sum()])
        q = w * p * (1 - p)
        h = np.array([[(q * z * z).sum() + 1e-2, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -2, 2)
    return float(max(a, 0.05)), float(b)


def _threshold(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Middle of the range of thresholds with the best F1."""
    grid = np.arange(0.05, 0.96, 0.01)
    f1 = np.array([2 * (w * y * (score >= t)).sum() / ((w * y).sum() + (w * (score >= t)).sum()) for t in grid])
    return float(np.median(grid[f1 >= f1.max() - 1e-12]))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """Fit on the labelled rows that are not held out.

    ``train`` begins with a sample, the labels of lowest hash, ``TRAIN_TOXIC`` toxic and
    ``TRAIN_CLEAN`` others at most, as far as ``TRAIN_TOTAL`` characters of a class go
    without texts above ``TRAIN_CHARS``; its ids are joined to ``docs`` by broadcast, so only
    the sample's texts move, to the driver part by part. If that is not all, ``train_on_all`` goes on.
    """
    with tidied():  # of what the fit holds, the driver keeps the network only
        return _fit_on(docs, labels, id_col, text_col, lang_col)


def _fit_on(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> Network:
    known = (
        labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("toxic").cast("int").alias("__toxic"))
        .where(F.col("__id").isNotNull() & F.col("__toxic").isin(0, 1) & ~held_out(F.col("__id")))
        .groupBy("__id")
        .agg(F.max("__toxic").alias("__toxic"))
    )
    rank = F.xxhash64("__id")
    totals = {r["__toxic"]: r["n"] for r in known.groupBy("__toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [known.where(F.col("__toxic") == k).orderBy(rank, "__id").limit(n) for k, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN))]
    sample = picked[0].unionByName(picked[1])  # TRAIN_TOXIC + TRAIN_CLEAN rows at most
    every = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("g"))
    texts = every.where(F.length(F.coalesce("t", F.lit(""))) <= TRAIN_CHARS)
    sized = every.select("__id", F.length("t").alias("n")).join(F.broadcast(sample), "__id").groupBy("__id", "__toxic").agg(F.max(F.coalesce("n", F.lit(0))).alias("n"))
    spent = {0: 0, 1: 0}
    ids, left_out = [], sum(totals.values()) > sum(min(totals.get(k, 0), n) for k, n in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)))
    for r in sized.orderBy(rank, "__id").collect():
        if r["n"] <= TRAIN_CHARS:
            spent[r["__toxic"]] += r["n"]
        if r["n"] <= TRAIN_CHARS and spent[r["__toxic"]] <= TRAIN_TOTAL:
            ids.append((r["__id"], r["__toxic"]))
        else:
            left_out = True
    chosen = docs.sparkSession.createDataFrame(ids, "__id long, __toxic int")
    # of a repeated id the least text counts, whatever the order of the rows
    parts = max(1, sum(min(n, TRAIN_TOTAL) for n in spent.values()) // FETCH_CHARS)
    least = texts.join(F.broadcast(chosen), "__id").repartition(parts, "__id").groupBy("__id", "__toxic").agg(F.min(F.struct("t", "g")).alias("r"))
    rows = sorted(least.select("__id", "__toxic", "r.*").toLocalIterator(), key=lambda r: r["__id"])
    seen = {k: max(1, sum(r["__toxic"] == k for r in rows)) for k in (0, 1)}
    weigh = {k: totals.get(k, 1) / seen[k] for k in (0, 1)}
    mean = sum(weigh[r["__toxic"]] for r in rows) / max(1, len(rows))
    net = train([r["t"] for r in rows], [r["__toxic"] for r in rows], [r["g"] for r in rows], [weigh[r["__toxic"]] / mean for r in rows])
    if left_out and isinstance(net, Network):
        train_on_all(net, every, known, sum(totals.values()))
    return net


def _listed(known: DataFrame, n: int):
    """A column that is true for all ids of ``known`` and few others: a bitmap of hashes, ``ID_BITS`` at most."""
    bits = min(ID_BITS, 1 << max(10, (8 * n).bit_length()))
    place = F.pmod(F.xxhash64("__id"), F.lit(bits))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[batch.column(0).to_numpy()] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(seen).tobytes()], pa.binary())], names=["m"])

    bitmap = np.zeros(bits // 8, np.uint8)
    for r in known.select(place.alias("b")).coalesce(8).mapInArrow(mark, "m binary").collect():
        bitmap |= np.frombuffer(bytes(r["m"]), np.uint8)
    shared = known.sparkSession.sparkContext.broadcast(bitmap)  # 8 MB at most

    @F.arrow_udf("boolean")
    def listed(b: pa.Array) -> pa.Array:
        b = b.to_numpy()
        return pa.array((shared.value[b >> 3] >> (7 - (b & 7)).astype(np.uint8) & 1).astype(bool))

    return listed(place)


def train_on_all(net: Network, texts: DataFrame, known: DataFrame, n: int) -> None:
    """Train ``net`` on over all ``n`` ``known`` ids with a text, then scale its scores and set its thresholds.

    A shard's rows come in the order of their hashes, so the result does not depend on how
    the tables lie. A fifth of the rows is aside from the fit; the scale and the thresholds
    come from all of them, counted by steps of the logit. Texts above a piece of
    ``_PIECE`` bytes are only looked at where they are aside.
    """
    spark = texts.sparkSession
    mine = texts.where(F.col("__id").isNotNull() & ~held_out(F.col("__id")) & _listed(known, n))
    size = mine.agg(F.sum(F.length("t"))).first()[0] or 0
    shards = max(1, min(SHARDS, -(-size // SHARD_CHARS)))
    # labels and texts of an id meet in its shard, so texts move once; of a repeated id the least text counts
    both = known.select("__id", "__toxic", F.lit(None).cast("struct<t:string,g:string>").alias("r")).unionByName(
        mine.select("__id", F.lit(None).cast("int").alias("__toxic"), F.struct("t", "g").alias("r"))
    )
    order = F.xxhash64("__id", F.lit(SEED))
    rows = (
        both.withColumn("shard", F.pmod(F.xxhash64("__id"), F.lit(shards)).cast("int"))
        .repartition(shards, "shard")
        .groupBy("shard", "__id")
        .agg(F.max("__toxic").alias("__toxic"), F.min("r").alias("r"))
        .where(F.col("__toxic").isNotNull() & F.col("r").isNotNull())
        .select("shard", "__toxic", "r.t", "r.g", (F.pmod(order, F.lit(5)) == 0).alias("aside"), order.alias("at"), "__id")
        .sortWithinPartitions("shard", "at", "__id")
        .persist(StorageLevel.DISK_ONLY)
    )
    try:
        for _ in range(ROUNDS):
            _round(net, rows.where("not aside").select("shard", "__toxic", "t"))
        _rescale(net, rows.where("aside").select("g", "__toxic", "t"))
    finally:
        rows.unpersist()


def _round(net: Network, rows: DataFrame) -> None:
    """Every shard trains the arrays on its rows; their mean by rows is the new state."""
    shared = rows.sparkSession.sparkContext.broadcast({k: getattr(net, k) for k in _ARRAYS})  # about 2 MB

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own, steps, units, y, held, n = None, None, None, [], [], 0, 0

        def flush() -> None:
            nonlocal units, y, held
            if units:
                steps.take(units, np.array(y, np.float64), np.ones(len(y)), ROUND_RATE)
            units, y, held = [], [], 0

        def result() -> pa.RecordBatch:
            flush()
            data = b"".join(getattr(own, k).tobytes() for k in _ARRAYS)
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["shard", "n", "arrays"])

        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(0)[i].as_py()
                if shard != at:
                    if at is not None and n:
                        yield result()
                    at, own, n = shard, Network.__new__(Network), 0
                    for k in _ARRAYS:
                        setattr(own, k, shared.value[k].copy())
                    steps = _Adam(own)
                folded = fold(batch.column(2)[i].as_py())
                if len(folded) > _PIECE:
                    continue
                if len(units) == BATCH or held + len(folded) > _PIECE:
                    flush()
                units.append(word_units(folded))
                y.append(batch.column(1)[i].as_py())
                held, n = held + len(folded), n + 1
        if at is not None and n:
            yield result()

    found = materialize(rows.mapInArrow(tidy(__name__, learn), "shard int, n long, arrays binary"), "toxicity-round")
    total, sums = 0, {k: np.zeros(getattr(net, k).shape) for k in _ARRAYS}
    for r in found.orderBy("shard").toLocalIterator():  # one shard's arrays after the other, SHARDS at most
        at, total = 0, total + r["n"]
        for k in _ARRAYS:
            p = getattr(net, k)
            sums[k] += r["n"] * np.frombuffer(r["arrays"], p.dtype, p.size, at).reshape(p.shape)
            at += p.nbytes
    if total:
        for k in _ARRAYS:
            setattr(net, k, (sums[k] / total).astype(getattr(net, k).dtype))
    discard(found)
    shared.destroy()


def _rescale(net: Network, rows: DataFrame) -> None:
    """Scale and thresholds from the rows' logits, counted by language, label and step."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                z = shared.value.logits(*shared.value.pooled([fold(t) for t in batch.column(2).to_pylist()])).astype(np.float64)
                step = np.floor(np.clip(z, -30, 30) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(step)], names=["g", "toxic", "step"])

    counts = rows.mapInArrow(tidy(__name__, place), "g string, toxic int, step int").groupBy("g", "toxic", "step").agg(F.count(F.lit(1)).alias("n")).collect()
    counts.sort(key=lambda r: (r["g"] or "", r["toxic"], r["step"]))
    shared.destroy()
    y, w = np.array([r["toxic"] for r in counts], np.float64), np.array([r["n"] for r in counts], np.float64)
    z, lang = (np.array([r["step"] for r in counts], np.float64) + 0.5) / STEPS, [r["g"] for r in counts]
    if not 0 < (w * y).sum() < w.sum():
        return
    net.scale, net.shift = _platt(z, y, w)
    score = 1 / (1 + np.exp(-(net.scale * z + net.shift)))
    net.thresholds = {}
    for g in sorted(set(lang) - {None}):
        own = np.array([x == g for x in lang])
        if min((w * y)[own].sum(), (w * (1 - y))[own].sum()) >= LEAST_ROWS:
            net.thresholds[g] = _threshold(score[own], y[own], w[own])


_SLICE = 512


def score_rows(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, score, predicted, lang_threshold, rejected)`` per row.

    ``predicted`` is 1 from a score of ``THRESHOLD`` on; ``rejected`` uses the threshold
    of the row's language (the common one for null and rare languages). Null and empty
    texts get the score of a text without words. Null ids and repeated rows pass
    through; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # the arrays above: about 2 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                score = shared.value.score(batch.column(1).to_pylist())
                limit = [shared.value.thresholds.get(g, THRESHOLD) for g in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(limit, pa.float64())], names=["doc_id", "score", "lang_threshold"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("g"))
    return rows.mapInArrow(tidy(__name__, run), "doc_id long, score double, lang_threshold double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "lang_threshold",
        (F.col("score") >= F.col("lang_threshold")).alias("rejected"),
    )


def without_toxic(docs: DataFrame, net: Network, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` below the threshold of their language; columns are those of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(at, _SLICE)
                score = shared.value.score(batch.column(text_at).to_pylist())
                limit = [shared.value.thresholds.get(g, THRESHOLD) for g in batch.column(lang_at).to_pylist()]
                yield batch.filter(pa.array(score < np.array(limit)))

    return docs.mapInArrow(tidy(__name__, run), docs.schema)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_rows(docs, fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
