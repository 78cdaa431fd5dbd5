"""Token counts by a linear longest-match automaton (Song et al., "Fast WordPiece
Tokenization", 2021).

A trie holds the word-initial pieces under one root and the others under a second.
Every node knows how many pieces greedy longest-match has surely cut off when its path
cannot be continued, and the node of what is left over. A word is counted in one pass
over its characters, without backtracking and without building its pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelattice.llm.sentencepieces import NORMAL, SPACE, Codec, RecentCache, load_model

_UNKNOWN = 1 << 40


class Automaton:
    """``initial`` pieces start a word, ``later`` ones continue it (both without markers)."""

    def __init__(self, initial: set[str], later: set[str]) -> None:
        #: node * 2**21 + code point -> node; node 0 starts a word, node 1 continues it
        self.step: dict[int, int] = {}
        piece, parent = [False, False], [(0, 0), (0, 0)]
        for root, words in ((0, initial), (1, later)):
            for word in sorted(words):
                at = root
                for ch in word:
                    edge = at << 21 | ord(ch)
                    if edge not in self.step:
                        self.step[edge] = len(piece)
                        piece.append(False)
                        parent.append((at, ord(ch)))
                    at = self.step[edge]
                piece[at] = at > 1
        n = len(piece)
        self.fail, self.popped = [-1] * n, [0] * n
        # the empty word-initial piece, if the vocabulary has it, lets a word start with a later piece
        self.bare_start = "" in initial
        if self.bare_start:
            self.fail[0], self.popped[0] = 1, 1
        depth = [0] * n
        for v in range(2, n):
            depth[v] = depth[parent[v][0]] + 1
        for v in sorted(range(2, n), key=depth.__getitem__):
            if piece[v]:
                self.fail[v], self.popped[v] = 1, 1
                continue
            u, ch = parent[v]
            z, cut = self.fail[u], self.popped[u]
            while z >= 0 and z << 21 | ch not in self.step:
                cut += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.step[z << 21 | ch], cut

    def count(self, word: str) -> int:
        """Pieces of the greedy longest match, or -1 if the word has none."""
        step, fail, popped = self.step, self.fail, self.popped
        at, total = 0, 0
        for ch in word:
            ch = ord(ch)
            to = step.get(at << 21 | ch)
            while to is None:
                if fail[at] < 0:
                    return -1
                total += popped[at]
                at = fail[at]
                to = step.get(at << 21 | ch)
            at = to
        while at != 1:
            if fail[at] < 0:
                return -1
            total += popped[at]
            at = fail[at]
        return total


class Counter(RecentCache):
    """Counts per word, kept up to a bound; an unknown word counts one and is marked."""

    def __init__(self, automaton: Automaton) -> None:
        super().__init__()
        self.automaton = automaton

    def compute(self, word: str) -> int:
        n = self.automaton.count(word)
        return 1 + _UNKNOWN if n < 0 else n

    def text(self, text: str | None) -> tuple[int, int, int]:
        """(words, pieces, unknown words) of a text split at Unicode white space."""
        words = (text or "").split()
        total = sum(map(self.__getitem__, words))
        return len(words), total % _UNKNOWN, total // _UNKNOWN


def vocabulary(model: bytes) -> tuple[set[str], set[str]]:
    """Word-initial and later pieces of a SentencePiece vocabulary."""
    pieces = [p for p, _, k in Codec(model).pieces if k == NORMAL]
    initial = {p[1:] for p in pieces if p[0] == SPACE and SPACE not in p[1:]}
    return initial, {p for p in pieces if SPACE not in p}


_COUNTERS: dict[int, Counter] = {}


def count_rows(docs: DataFrame, model: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_tokens, n_unknown)`` per row of ``docs``.

    A word the vocabulary cannot spell counts as one unknown token. Null and empty
    texts count zero; null ids and repeated rows pass through; other columns are
    ignored.
    """
    spark = docs.sparkSession
    model = load_model() if model is None else model
    key = zlib.crc32(model)
    shared = spark.sparkContext.broadcast(vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[key] = Counter(Automaton(*shared.value))
        count = _COUNTERS[key].text
        for batch in batches:
            rows = [count(x.as_py()) for x in batch.column(1)]
            parts = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.int64()) for x in parts]], names=["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
