import zlib

import numpy as np
import pytest

from pagelattice import runtime
from pagelattice.llm import toxicity as T


def _units_plain(text):
    """Word buckets one by one."""
    out, mask = [], (1 << 64) - 1
    for word in T.fold(text).split():
        row = []
        for k, n in enumerate((None, *T.PREFIXES)):
            h = sum((b + 1) * pow(int(T._BASE), i, 1 << 64) for i, b in enumerate(word[:n])) + k + 1 & mask
            h ^= h >> 32
            h = h * int(T._MIX) & mask
            h ^= h >> 29
            row.append(1 + h % (T.BUCKETS - 1))
        out.append(row)
    return out


def test_units():
    for text in ("", "a", "Hello, WORLD! idiot's 123", "réeux éé\n\tx", "%%% ###", "x" * 300):
        assert T.word_units(T.fold(text)).tolist() == _units_plain(text)


def test_pooling_by_batch_by_text_and_by_piece(monkeypatch):
    net = T.Network(np.random.default_rng(0))
    texts = ["one two three", "", "a", "w " * 500, "the quick brown fox " * 90, "x y"] * 3
    folded = [T.fold(t) for t in texts]
    best, count = net.pooled(folded)
    assert count.tolist() == [len(t.split()) for t in texts]
    for i, f in enumerate(folded):
        one, _ = net.pooled([f])
        assert np.allclose(one[0], best[i], atol=1e-6)
    monkeypatch.setattr(T, "_PIECE", 97)
    cut, n = net.pooled(folded)
    assert n.tolist() == count.tolist()
    assert np.allclose(cut, best, atol=1e-6)


def test_words_longer_than_a_piece(monkeypatch):
    """A word of any length is one word with the hash of all its bytes."""
    text = "abc " + "x" * 1000 + " def" + "y" * 300 + "  z " + "w" * 97
    whole = T.word_units(T.fold(text)).tolist()
    monkeypatch.setattr(T, "_PIECE", 97)
    runs = list(T._pieces(T.fold(text)))
    assert [last for _, last in runs] == [False] * (len(runs) - 1) + [True]
    assert [row for units, _ in runs for row in units.tolist()] == whole


def test_pooling_against_loops():
    net = T.Network(np.random.default_rng(1))
    text = "you are a total idiot and a clown said the man to the other one there"
    u = T.word_units(T.fold(text))
    e = net.embed[u].sum(1)
    e = np.concatenate([e, np.zeros((2, T.DIM), np.float32)])
    best, _ = net.pooled([T.fold(text)])
    at = 0
    for k, w in enumerate(T.WIDTHS):
        for f in range(T.FILTERS):
            v = [sum(e[t + o] @ net.conv[:, at + o * T.FILTERS + f] for o in range(w)) for t in range(len(u))]
            for s in range(T.SEGMENTS):
                own = [x for t, x in enumerate(v) if t // T.RUN % T.SEGMENTS == s]
                assert np.isclose(best[0, s, k * T.FILTERS + f], max(own) if own else 0, atol=1e-5)
        at += w * T.FILTERS


def test_gradients():
    rng = np.random.default_rng(3)
    net = T.Network(rng)
    for name in ("embed", "conv", "bias", "hidden", "hidden_bias", "out", "out_bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.bias[:] = rng.choice([-0.1, 0.1], net.bias.shape)  # away from the kink at zero
    texts = ["good words here and there", "idiot", "one two three four five six seven eight nine ten", "a b"]
    units, y, w = [T.word_units(T.fold(t)) for t in texts], np.array([0.0, 1, 0, 1]), np.array([1.0, 2, 1, 0.5])

    def loss():
        p, n = net.pooled([T.fold(t) for t in texts])
        z = net.logits(p.astype(np.float64), n)
        return float((w * (np.logaddexp(0, z) - y * z)).sum() / len(y))

    grads = net._gradients(units, y, w)
    for name in ("conv", "bias", "hidden", "hidden_bias", "out", "out_bias"):
        p = getattr(net, name)
        for i in rng.choice(p.size, min(p.size, 12), replace=False):
            at = np.unravel_index(i, p.shape)
            old = p[at]
            p[at] = old + 1e-5
            up = loss()
            p[at] = old - 1e-5
            down = loss()
            p[at] = old
            assert np.isclose((up - down) / 2e-5, grads[name][at], rtol=0.05, atol=2e-3), name


def _labelled(n, seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}{c}" for a in "btkm" for b in "aeio" for c in ("n", "r", "st", "l")]
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(vocabulary, rng.integers(5, 150)))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(0, len(words))), str(rng.choice(["idiot", "scum", "moron", "loser"])))
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels, ["en" if i % 2 else "de" for i in range(n)]


def test_held_out_accuracy():
    net = T.train(*_labelled(900, 1))
    texts, labels, _ = _labelled(600, 2)
    score, y = net.score(texts), np.array(labels)
    assert ((score >= T.THRESHOLD) == (y == 1)).mean() > 0.98
    assert score.min() >= 0 and score.max() <= 1
    assert set(net.thresholds) <= {"en", "de"} and net.thresholds


def test_documents_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = T.op5_toxicity(spark, sf).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.3) for r in rows)
    aside = [r for r in rows if r.held_out and r.doc_id in known]
    hit = sum(r.predicted and known[r.doc_id] for r in aside)
    toxic, told = sum(known[r.doc_id] for r in aside), sum(r.predicted for r in aside)
    assert hit / told > 0.95 and hit / toxic > 0.85


def test_labels_of_held_out_rows_do_not_count(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) as toxic")
    a, b = (T.fit_on(docs, x) for x in (labels, flipped))
    assert all((getattr(a, k) == getattr(b, k)).all() for k in ("embed", "conv", "hidden", "out"))


def test_a_repeated_id_is_learnt_alike_in_any_order(spark):
    texts, labels, langs = _labelled(300, 3)
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))] + [(i, f"other text {i}", "de") for i in range(0, 300, 7)]
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    nets = [T.fit_on(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(n), known) for x, n in ((rows, 1), (rows[::-1], 5))]
    assert all((getattr(nets[0], k) == getattr(nets[1], k)).all() for k in ("embed", "conv", "hidden", "out"))


def test_the_sample_is_bounded_in_characters(spark, monkeypatch):
    texts, labels, langs = _labelled(200, 4)
    seen = []
    monkeypatch.setattr(T, "TRAIN_TOTAL", 2000)
    monkeypatch.setattr(T, "train", lambda t, y, g, w: seen.append((t, y)))
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    T.fit_on(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"))
    t, y = seen[0]
    for k in (0, 1):
        size = sum(len(x) for x, label in zip(t, y) if label == k)
        assert 0 < size <= 2000


def test_odd_rows(spark, odd_docs, no_docs):
    net = T.train(*_labelled(200, 1))
    rows = T.score_rows(odd_docs, net).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.doc_id, set()).add(r.score)
    assert len(by_text[1]) == 1 and by_text[3] == by_text[4] == by_text[7]
    assert T.score_rows(no_docs, net).collect() == []
    kept = T.without_toxic(odd_docs, net)
    assert kept.columns == odd_docs.columns
    assert kept.count() == sum(not r.rejected for r in rows)


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_labels_without_two_classes(spark, odd_docs, toxic):
    labels = spark.createDataFrame([] if toxic is None else [(i, toxic) for i in range(1, 10)], "doc_id long, toxic int")
    net = T.fit_on(odd_docs, labels)
    rows = T.score_rows(odd_docs, net).collect()
    assert {r.rejected for r in rows} == {toxic == 1}


def test_rows_beyond_the_sample_are_learnt_from(spark, monkeypatch):
    texts, labels, langs = _labelled(400, 5)
    texts[8], texts[9] = texts[8] * 40, None
    rows = [(i, t, g) for i, (t, g) in enumerate(zip(texts, langs))] + [(5, "a repeated id", "de"), (1000, "no label", "de"), (None, "no id", "de")]
    known = spark.createDataFrame(list(enumerate(labels)) + [(5000, 1)], "doc_id long, toxic int")
    for name, value in (("TRAIN_TOXIC", 30), ("TRAIN_CLEAN", 50), ("TRAIN_CHARS", 5000), ("SHARD_CHARS", 30_000)):
        monkeypatch.setattr(T, name, value)
    seen, once, rescale = [], T._round, T._rescale
    monkeypatch.setattr(T, "_round", lambda net, rows: (seen.append(("fit", rows.count())), once(net, rows)))
    monkeypatch.setattr(T, "_rescale", lambda net, rows: (seen.append(("aside", rows.count())), rescale(net, rows)))
    nets = [T.fit_on(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(n), known) for x, n in ((rows, 1), (rows[::-1], 5))]
    free = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(400))
    for at in (0, T.ROUNDS + 1):
        fit, aside = seen[at], seen[at + T.ROUNDS]
        assert (fit[0], aside[0]) == ("fit", "aside") and fit[1] + aside[1] == free and aside[1] > 20
    assert all((getattr(nets[0], k) == getattr(nets[1], k)).all() for k in T._ARRAYS)
    assert (nets[0].scale, nets[0].shift, nets[0].thresholds) == (nets[1].scale, nets[1].shift, nets[1].thresholds)
    texts, labels, _ = _labelled(300, 6)
    assert ((nets[0].score(texts) >= T.THRESHOLD) == (np.array(labels) == 1)).mean() > 0.95


def test_the_driver_holds_part_of_the_sample_at_a_time_and_nothing_after(spark, monkeypatch):
    rows = [(i, ("you idiot " if i % 2 else "kind words ") * (3 + i % 7) + str(i), "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    known = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    taken, collected, trimmed, collect, train = [], [], [], type(docs).collect, T.train
    monkeypatch.setattr(type(docs), "collect", lambda df: collected.append(df.columns) or collect(df))
    monkeypatch.setattr(T, "train", lambda *a: taken.append(a) or train(*a))
    monkeypatch.setattr(runtime, "_trim", lambda: trimmed.append(len(T._POW)))
    nets = []
    for chars in (T.FETCH_CHARS, 100):
        monkeypatch.setattr(T, "FETCH_CHARS", chars)
        nets.append(T.fit_on(docs, known))
    assert taken[0] == taken[1] and np.array_equal(nets[0].embed, nets[1].embed)
    assert collected and not any("t" in columns for columns in collected)
    assert trimmed == [0, 0]
