import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelattice.llm import simhash


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abAB é\t\n ßİ\x1c.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_fingerprint_edges():
    assert simhash.fingerprint(None) == simhash.fingerprint("") == simhash.fingerprint(" \t\n") == 0
    long_text = " ".join(f"w{i * 7919 % 1000}" for i in range(70_000))  # over the chunk of hashes
    assert simhash.fingerprint(long_text) == plain(long_text)


def _components(prints, bits):
    ids = list(range(len(prints)))
    label = ids[:]
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if bin(prints[i] ^ prints[j]).count("1") <= bits and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def _clouds(seed, n):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        base = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        out.append(base)
        for _ in range(int(rng.integers(0, 6))):
            x = out[-1] if rng.random() < 0.5 else base
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                x ^= 1 << int(b)
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("bits", "segments"), [(2, 5), (2, 3), (3, 7), (1, 4), (0, 2)])
def test_near_pairs_miss_nothing(spark, bits, segments):
    prints = _clouds(bits * 10 + segments, 60)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = {tuple(sorted((r.a % 2**64, r.b % 2**64))) for r in simhash.near_pairs(frame, bits, segments).collect()}
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if bin(a ^ b).count("1") <= bits}
    assert got == want


def test_segments_must_exceed_bits():
    with pytest.raises(ValueError):
        simhash.chains(3, 3)


def _check(rows, texts):
    prints = [plain(t) for _, t in texts]
    label = _components(prints, 2)
    least = {}
    for (i, _), c in zip(texts, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(texts, prints, label)), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in rows), key=str) == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    _check(simhash.op4_simhash(spark, sf).collect(), [(r.doc_id, r.text) for r in docs])


def test_odd_rows(odd_docs, no_docs):
    _check(simhash.near_duplicates(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert simhash.near_duplicates(no_docs).collect() == []


def test_keep_first(odd_docs, no_docs):
    out = simhash.keep_first(odd_docs)
    assert out.columns == odd_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 8, 9, 10]
    assert ids.count(None) == 2
    assert simhash.keep_first(no_docs).collect() == []


def test_clash(odd_docs):
    extra = odd_docs.withColumnRenamed("h", "__kept").withColumnRenamed("position", "__rows")
    assert simhash.keep_first(extra).columns == extra.columns
    assert simhash.keep_first(extra).count() == 8
