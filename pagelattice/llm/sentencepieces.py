"""SentencePiece encoding and decoding by a streaming Viterbi over the piece lattice.

An automaton reads the text once and names the pieces that end at each character; one
forward pass over them keeps, for each boundary in a window of the longest piece's
length, the best arc that ends there. A boundary through which the backpointers of all
boundaries of the window pass can no longer change, so its ids are committed and what
lies before it is forgotten: memory is bounded for texts of any length.

* Unigram models: arcs carry the piece scores, the path with the largest sum wins.
* BPE models: an arc may follow another only if merging the two pieces' characters in
  score order gives exactly these two pieces back. A sequence of pieces is the BPE
  result if and only if all its neighbours are compatible so, hence one arc survives at
  every boundary and the path is the merge result, id by id.

Words whose ends no piece can cross are hard boundaries of every path; their ids are
kept in a bounded cache.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain
from math import inf
from operator import add

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.runtime import keeps, tidy

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Entries of a cache's generation: at most four of these and the pairs' stay in a worker, about 150 MB.
CACHE_ENTRIES = 100_000
CACHE_KEY = 64
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one protocol-buffer message."""
    at, end = 0, len(data)

    def varint(at: int) -> tuple[int, int]:
        x = shift = 0
        while True:
            b = data[at]
            at, x, shift = at + 1, x | (b & 127) << shift, shift + 7
            if b < 128:
                return x, at

    while at < end:
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("not a SentencePiece model")
        yield tag >> 3, value


class Codec:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, model: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.dummy_prefix, squeeze, charsmap, escape = UNIGRAM, False, True, True, b"", True
        for no, value in _fields(model):
            if no == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        piece = v.decode("utf-8")
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif no == 2:
                spec = dict(_fields(value))
                self.kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif no == 3:
                spec = dict(_fields(value))
                charsmap, self.dummy_prefix, squeeze, escape = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if self.kind not in (UNIGRAM, BPE) or charsmap or squeeze or not escape or any(k == USER for _, _, k in self.pieces):
            raise ValueError("only identity-normalised unigram and BPE models are supported")
        self.ids = {p: i for i, (p, _, k) in enumerate(self.pieces) if k == NORMAL}
        self.scores = [s for _, s, _ in self.pieces]
        self.single = {p for p in self.ids if len(p) == 1}
        if self.kind == BPE and not self.single.issuperset(chain.from_iterable(self.ids)):
            raise ValueError("a piece holds a character that is no piece itself")
        #: finds all pieces that end at a character, the longest first
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        #: of pieces; at -1 that of an unknown character, at -2 that of no arc
        self.lengths = [*(len(p) for p, _, _ in self.pieces), 0, 1]
        self.unk = next(i for i, (_, _, k) in enumerate(self.pieces) if k == UNKNOWN)
        self.unk_score = min(self.scores[i] for i in self.ids.values()) - 10.0
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(self.pieces) if k == BYTE}
        self.longest = max(map(len, self.ids))
        #: Neighbours within pieces: a path has a boundary between any two other characters.
        self.linked = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        #: No piece crosses from a word into the next one's space / holds a line feed.
        self.word_bounded = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.line_bounded = not any("\n" in p for p in self.ids if len(p) > 1)
        self.surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, _, k in self.pieces
        ]
        #: by piece, the turn of its merge, the best score's first (-1: a single character)
        turn_of = {score: turn for turn, score in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.turns = [turn_of[s] if k == NORMAL and len(p) > 1 else -1 for p, s, k in self.pieces]
        self._halves_of: dict[int, tuple[int, int, bool] | None] = {}
        #: by the left piece, whether a right one keeps apart from it
        self._pairs: defaultdict[int, dict[int, bool]] = defaultdict(dict)
        self._known_pairs = 0
        self._bare, self._word = _Words(self, ""), _Words(self, SPACE)
        self._newline = tuple(self._stream("\n"))

    # -- the lattice ---------------------------------------------------------------

    def _merged(self, text: str, least: int = 1) -> list[str]:
        """Merge neighbours by the best score, leftmost first, until no piece results or ``least`` parts are left."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > least:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or scores[found] > best):
                    best, at = scores[found], i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, piece: int) -> tuple[int, int, bool] | None:
        """The pieces of the last merge that makes ``piece``, and whether all its merges come in the order of
        their turns; none if merging its characters does not give it."""
        if piece in self._halves_of:
            return self._halves_of[piece]
        text, found = self.pieces[piece][0], None
        if len(text) == 1:
            found = -1, -1, True
        elif len(parts := self._merged(text, 2)) == 2:
            a, b = self.ids[parts[0]], self.ids[parts[1]]
            in_turn = self.turns[piece] > max(self.turns[a], self.turns[b])
            found = a, b, in_turn and self._halves(a)[2] and self._halves(b)[2]
        self._halves_of[piece] = found
        return found

    def _apart(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces gives these two pieces.

        The merges of either are undone, the latest first: what then meets between them had
        until the merge just undone to become a piece itself.
        """
        a, b = self._halves(left), self._halves(right)
        if a is None or b is None:
            return False
        pieces, ids, turns = self.pieces, self.ids, self.turns
        if not (a[2] and b[2]):
            want = [pieces[left][0], pieces[right][0]]
            return self._merged("".join(want)) == want
        limit = inf
        while True:
            across = ids.get(pieces[left][0] + pieces[right][0])
            if across is not None and turns[across] < limit:
                return False
            if turns[left] > turns[right]:
                limit, left = turns[left], self._halves(left)[1]
            elif turns[right] >= 0:  # of equal merges the left one comes first
                limit, right = turns[right] + 1, self._halves(right)[0]
            else:
                return True

    def _compatible(self, left: int, right: int, row: dict[int, bool]) -> bool:
        """Whether piece ``left`` (-1: a text start or an unknown character) keeps apart from ``right``; noted in its ``row``."""
        ok = self._apart(left, right) if left >= 0 else self._halves(right) is not None
        if self._known_pairs >= 4 * CACHE_ENTRIES:
            self._pairs.clear()
            self._known_pairs = 0
        self._known_pairs += 1
        row[right] = ok
        return ok

    def _spell(self, piece: str, after_unknown: bool) -> tuple[int, ...]:
        if self.byte_fallback:
            return tuple(self.byte_ids[b] for b in piece.encode("utf-8", "surrogatepass"))
        return () if after_unknown else (self.unk,)  # a run of unknown characters is one unknown piece

    def _found(self, text: str) -> Iterator[tuple[int, int]]:
        """``(place of the last character, piece)`` of all pieces in ``text``, which is read part by part.

        Each part is searched with what a piece may reach back to: the library's own way to go
        on in another string (``set``) crashes.
        """
        step = 4 * self.longest
        for start in range(0, len(text), step):
            before = min(start, self.longest - 1)
            for at, piece in self.automaton.iter(text[start - before : start + step]):
                if at >= before:
                    yield start - before + at, piece

    def _back(self, text: str, base: int, arc: list[int], k: int, unknown: bool) -> list[int]:
        """Ids of the path to boundary ``base + k``; ``unknown``: an unknown character was the last before it."""
        lengths, path, at = self.lengths, [], base
        while k:
            path.append(arc[k])
            k -= lengths[arc[k]]
        path.reverse()
        if -1 not in path:
            return path
        out: list[int] = []
        for piece in path:
            at += lengths[piece]
            out += (piece,) if piece >= 0 else self._spell(text[at - 1], unknown)
            unknown = piece < 0
        return out

    def _word_ids(self, text: str) -> tuple[int, ...]:
        """Ids of a short text of known characters under a BPE model: what ``_runs`` does, without its window."""
        pairs, lengths, k = self._pairs, self.lengths, len(text)
        arc, after = [-1] * (k + 1), [pairs[-1]] * (k + 1)
        got = 0
        for at, piece in self.automaton.iter(text):  # the longest piece that fits
            if at < got:
                continue
            start = at + 1 - lengths[piece]
            row = after[start]
            ok = row.get(piece)
            if ok is None:
                ok = self._compatible(arc[start], piece, row)
            if ok:
                got = at + 1
                arc[got], after[got] = piece, pairs[piece]
        path = []
        while k:
            path.append(arc[k])
            k -= lengths[arc[k]]
        path.reverse()
        return tuple(path)

    def _stream(self, text: str) -> Iterator[int]:
        """Ids of ``text`` (spaces escaped), committed as soon as no later character can change them."""
        return chain.from_iterable(self._runs(text))

    def _runs(self, text: str) -> Iterator[list[int]]:
        end = len(text)
        if not end:
            return
        pairs, lengths, scores, longest, bpe = self._pairs, self.lengths, self.scores, self.longest, self.kind == BPE
        most = 4 * longest
        # of boundary base + k: the piece of its surviving arc (-1: an unknown character, -2: none), its sum or what is known to follow it
        arc, best, after = [-1], [0.0], [pairs[-1]]
        base, j, k, got, unknown = 0, 0, 1, False, False  # boundary base + k, behind character j, is open; whether it has got an arc
        found = self.automaton.iter(text) if end <= most else self._found(text)
        for at, piece in chain(found, ((end, -1),)):
            if j < at:  # no further piece ends with character j
                while j < at:
                    if not got:
                        odd = text[j] not in self.single
                        arc.append(-1 if odd else -2)
                        if bpe:
                            after.append(pairs[arc[k]])
                        else:
                            best.append(best[k - 1] + self.unk_score)
                    elif not bpe and text[j] not in self.single and best[k - 1] + self.unk_score > best[k]:
                        arc[k], best[k] = -1, best[k - 1] + self.unk_score
                    j += 1
                    k += 1
                    got = False
                    if k > most:
                        live = {x for x in range(k - longest, k) if arc[x] != -2}
                        while len(live) > 1:  # every later path goes through one of these
                            x = max(live)
                            live.remove(x)
                            live.add(x - lengths[arc[x]])
                        x = live.pop()
                        if x:
                            yield self._back(text, base, arc, x, unknown)
                            unknown = arc[x] == -1
                            arc, best, after, base, k = arc[x:], best[x:], after[x:], base + x, k - x
                if at == end:
                    break
            if bpe:
                if got:  # from the longest piece that fits
                    continue
                start = k - lengths[piece]
                ok = after[start].get(piece)
                if ok is None:
                    ok = self._compatible(arc[start], piece, after[start])
                if ok:
                    arc.append(piece)
                    after.append(pairs[piece])
                    got = True
            else:
                start = k - lengths[piece]
                total = best[start] + scores[piece]
                if not got:
                    arc.append(piece)
                    best.append(total)
                    got = True
                elif total > best[k]:
                    arc[k], best[k] = piece, total
        yield self._back(text, base, arc, k - 1, unknown)

    # -- whole texts ---------------------------------------------------------------

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty text has none."""
        if not text:
            return []
        if not self.word_bounded or not self.dummy_prefix:
            return list(self._stream((SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)))
        if "  " in text or SPACE in text or text[0] == " ":
            spaced = SPACE + text.replace(" ", SPACE)
            return list(chain.from_iterable(map(self._bare.__getitem__, re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", spaced))))
        if not self.line_bounded or "\n" not in text:
            return list(chain.from_iterable(map(self._word.__getitem__, text.split(" "))))
        out: list[int] = []
        for k, line in enumerate(text.split("\n")):
            words = line.split(" ")
            if k:
                out += self._newline
                out += self._bare[words.pop(0)]
            elif not line:
                out += self._word[""]
                continue
            out += chain.from_iterable(map(self._word.__getitem__, words))
        return out

    def decode(self, ids) -> str:
        """The text of ids: bytes of byte pieces are joined, broken UTF-8 gives U+FFFD."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


class RecentCache(dict):
    """A bounded cache of ``compute(key)``: when full it becomes the older generation,
    from which keys that are asked for again move back. Long keys are not kept."""

    def __init__(self) -> None:
        self.older: dict = {}

    def compute(self, key: str):
        raise NotImplementedError

    def __missing__(self, key: str):
        found = self.older.get(key)
        if found is None:
            found = self.compute(key)
        if len(key) <= CACHE_KEY:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[key] = found
        return found


class _Words(RecentCache):
    """Ids of words after ``lead``."""

    def __init__(self, codec: Codec, lead: str) -> None:
        super().__init__()
        self.codec, self.lead = codec, lead

    def compute(self, word: str) -> tuple[int, ...]:
        codec, text = self.codec, self.lead + word
        if len(text) > CACHE_KEY or not codec.byte_fallback:
            return tuple(codec._stream(text))
        linked, next_to = codec.linked, [*map(add, text, text[1:])]
        if linked.issuperset(next_to):
            return codec._word_ids(text) if codec.kind == BPE and len(text) > 1 else tuple(codec._stream(text))
        cuts = [i for i, two in enumerate(next_to, 1) if two not in linked]
        bare, out = codec._bare, list(self[text[len(self.lead) : cuts[0]]] if cuts[0] >= len(self.lead) else ())
        for a, b in zip(cuts, [*cuts[1:], len(text)]):
            out += bare[text[a:b]]
        return tuple(out)


_CODECS: dict[int, Codec] = {}
keeps(__name__, _CODECS.clear)


def _codec(model: bytes) -> Codec:
    key = zlib.crc32(model)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def load_model(path: str = MODEL_PATH) -> bytes:
    """The model file, read by the driver; its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return f.read()


_SLICE = 512


def encode_rows(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded_crc32, round_trip)`` and the columns ``keep`` per row of ``docs``.

    The ids are decoded again: ``decoded_crc32`` is the CRC-32 of the decoded UTF-8
    text and ``round_trip`` whether it equals the input (texts that hold U+2581
    themselves decode to spaces, as the format defines). Null and empty texts have no
    ids. Null ids and repeated rows pass through; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(load_model() if model is None else model)  # a vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                counts, crcs, same, ids = [], [], [], []
                for text in batch.column(1).to_pylist():
                    found = codec.encode(text)
                    decoded = codec.decode(found)
                    ids.append(np.array(found, np.int32))
                    counts.append(len(found))
                    crcs.append(zlib.crc32(decoded.encode("utf-8", "surrogatepass")))
                    same.append(decoded == (text or ""))
                offsets = np.zeros(len(counts) + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))),
                        pa.array(crcs, pa.int64()),
                        pa.array(same, pa.bool_()),
                        *batch.columns[2:],
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded_crc32", "round_trip", *keep],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(tidy(__name__, run), "doc_id long, n_tokens long, ids array<int>, decoded_crc32 long, round_trip boolean" + more)


def decode_rows(encoded: DataFrame, model: bytes | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` per row of ids; null ids give the empty text, ids outside the vocabulary raise."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(load_model() if model is None else model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                texts = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(tidy(__name__, run), "doc_id long, text string")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
