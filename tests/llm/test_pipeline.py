import os
from collections import Counter

import numpy as np
import pytest

import __spark_entry__
import corpus_pipeline
from pagelattice.llm import mixing, secrets, sentencepieces, toxicity
from pagelattice.runtime import materialize, shared_dir
from test_near_copies import kept_by_all_pairs as all_pairs


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, f in corpus_pipeline.STAGES:
        docs = materialize(f(spark, docs, sf), name)
        out.append(docs)
    return [x.collect() for x in out], [x.columns for x in out]


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "sentencepiece"]


def test_columns(stages):
    assert all(c == stages[1][0] for c in stages[1][:-1])


def test_toxicity(spark, sf, stages):
    first, second = stages[0][0], stages[0][1]
    net = toxicity.fit_on(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    score = net.score([r.text for r in first])
    limit = np.array([net.thresholds.get(r.lang, toxicity.THRESHOLD) for r in first])
    assert {r.doc_id for r in second} == {r.doc_id for r, s, t in zip(first, score, limit) if s < t}


def test_simhash(stages):
    before, after = stages[0][1], stages[0][2]
    kept, links = all_pairs([(r.doc_id, r.text) for r in before])
    assert links and kept == {r.doc_id for r in after}


def test_secrets_and_mixing(stages):
    before, after, mixed = stages[0][2], stages[0][3], stages[0][4]
    assert {(r.doc_id, secrets.redact(r.text), len(secrets.redact(r.text))) for r in before} == {(r.doc_id, r.text, r.n_chars) for r in after}
    assert Counter(map(tuple, after)) == Counter(map(tuple, mixed))


def test_encoding(stages):
    codec = sentencepieces._codec(sentencepieces.load_model())
    texts = {r.doc_id: r.text for r in stages[0][4]}
    assert {r.doc_id: r.ids for r in stages[0][5]} == {i: codec.encode(t) for i, t in texts.items()}


def test_run_equals_stages(spark, sf, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, sf).collect())) == sorted(map(str, stages[0][-1]))


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_nothing_else_imports_this_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for folder, _, files in os.walk(os.path.join(root, "pagelattice")):
        if "llm" not in folder.split(os.sep):
            for f in files:
                if f.endswith(".py"):
                    assert "pagelattice.llm" not in open(os.path.join(folder, f)).read()


def test_shared_folder_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or f"/tmp/checkpoints/{spark.sparkContext.applicationId}")
    out = materialize(spark.range(3), "t")
    assert out.count() == 3 and all(f"{shared_dir(spark)}/scratch/t-" in f for f in out.inputFiles())


def test_run_is_in_the_mixed_order(spark, sf, stages):
    """Rows and positions of the result follow the schedule of the redacted documents."""
    before = spark.createDataFrame(stages[0][3], "doc_id long, text string, lang string, source string, n_chars long")
    placed = mixing.mix(before).collect()
    want = [r.doc_id for r in sorted(placed, key=lambda r: r.position)]
    rows = corpus_pipeline.run(spark, sf).collect()
    assert [r.position for r in rows] == list(range(len(want)))
    assert [r.doc_id for r in rows] == want
