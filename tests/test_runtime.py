"""What Python workers keep from one operator to the next."""

import numpy as np
import pyarrow as pa
from pagelattice import runtime
from pagelattice.llm import near_copies, sentencepieces, toxicity


def test_a_worker_holds_one_operators_caches(spark):
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(40)], "doc_id long, text string").coalesce(1)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(sentencepieces._CODECS)]), pa.array([len(near_copies._WORDS)])], names=["codecs", "words"])

    assert sentencepieces.encode_rows(docs).count() == 40
    assert docs.mapInArrow(held, "codecs long, words long").first().codecs == 1
    assert len(near_copies.common_shingles(docs.select("text"))) == 0
    after = docs.mapInArrow(held, "codecs long, words long").first()
    assert after.codecs == 0 and after.words > 0


def test_a_cut_off_run_is_tidied_too(monkeypatch):
    done = []
    monkeypatch.setattr(runtime, "_trim", lambda: done.append(1))
    monkeypatch.setitem(runtime._KEPT, "other", lambda: done.append("other"))
    run = runtime.tidy(toxicity.__name__, lambda batches: iter(np.arange(3)))(iter(()))
    assert next(run) == 0
    run.close()
    assert done == ["other", 1, 1]
