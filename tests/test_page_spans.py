"""Words and spans matched within whole pages."""

import os
import shutil

import __spark_entry__ as driver
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pagelattice.functions import geometry as G
from pagelattice.operators import aggregates, joins
from pyspark.sql import functions as F

#: Bytes shuffled for each row that comes out, at most; words alone took 20.
QUERIES = {"quad_metrics": 4, "oriented_quad": 4, "word_span_match": 4, "overlay_text": 4, "reconstruction_drawlist": 8}


def _shuffled(spark, what: str = "Bytes") -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(getattr(stages.apply(i), f"shuffleWrite{what}")() for i in range(stages.size()))


@pytest.mark.parametrize("name", QUERIES)
def test_words_stay_where_their_page_is(spark, sf, name, tmp_path):
    query, before = driver.queries()[name], _shuffled(spark)
    query(spark, sf).write.parquet(f"{tmp_path}/out")
    rows = spark.read.parquet(f"{tmp_path}/out").count()
    assert rows > 10_000 and _shuffled(spark) - before < QUERIES[name] * rows


def test_lines_of_drawings_stay_where_they_lie(spark, sf, tmp_path):
    before = _shuffled(spark, "Records")
    driver.queries()["reconstruction_drawlist"](spark, sf).write.parquet(f"{tmp_path}/out")
    drawings = spark.read.parquet(f"{tmp_path}/out").where("item = 'drawing'").count()
    others = sum(pq.read_metadata(f"{sf}/{t}.parquet").num_rows * n for t, n in (("documents", 1), ("events", 2)))
    assert _shuffled(spark, "Records") - before <= 2 * drawings + others < pq.read_metadata(f"{sf}/lineitem.parquet").num_rows


def test_drawings_by_any_order(spark):
    rows = [(0, 4, 7, "a", 2.0, 5.0, None), (0, 4, 3, "b", None, 6.0, "[3] 0"), (0, 4, 9, "c", 1.0, 4.0, ""), (1, 4, 2, "d", 3.0, 1.0, "[] 0")]
    df = spark.createDataFrame(rows, "page_index long, seq long, line int, layer_key string, stroke_width double, x0 double, dashes string")
    df = df.selectExpr("*", "x0 as y0", "x0 + 1 as x1", "x0 + 2 as y1", "'-' as color_key")
    got = {r.page_index: r for r in aggregates.build_drawings(df, "line").collect()}
    assert "members" not in got[0].asDict() and [(r.layer_key, r.stroke_width, r.x0, r.y1, r.n_paths, r.dashed) for r in (got[0], got[1])] == [
        ("b", None, 4.0, 8.0, 3, True), ("d", 3.0, 1.0, 3.0, 1, False),
    ]


@pytest.mark.parametrize("name", QUERIES)
def test_repeated_and_missing_documents(spark, sf, name, tmp_path):
    for f in os.listdir(sf):
        shutil.copyfile(f"{sf}/{f}", f"{tmp_path}/{f}")
    docs = pq.read_table(f"{sf}/documents.parquet")
    rows = docs.to_pylist()[:40]
    odd = [(3, "one two  three\tfour   five \U0001f600\U0001f600 x"), (7, None), (8, ""), (None, "a b c"), (None, "d e f g h"), (-13, "i j k l m"), (9001, "   "), (9002, "x " * 3000), (9002, "yy " * 900)]
    pq.write_table(pa.Table.from_pylist(rows + [rows[0] | {"doc_id": i, "text": t} for i, t in odd], schema=docs.schema), f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for f in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{tmp_path}/{f}'")
    out = driver.queries()[name](spark, str(tmp_path))
    out.write.parquet(f"{tmp_path}/out")
    names = ", ".join(out.columns)
    con.execute(f"CREATE TABLE wanted AS SELECT {names} FROM ({driver.oracle_sql()[name]})")
    con.execute(f"CREATE VIEW got AS SELECT {names} FROM '{tmp_path}/out/*.parquet'")
    for a, b in (("wanted", "got"), ("got", "wanted")):
        assert con.execute(f"SELECT count(*) FROM (FROM {a} EXCEPT ALL FROM {b})").fetchone()[0] == 0


@pytest.mark.parametrize("pairs", [7, 1 << 19])
def test_best_spans_of_any_boxes(pairs, monkeypatch):
    monkeypatch.setattr(joins, "_PAIRS", pairs)
    rng = np.random.default_rng(3)
    for case in range(30):
        n, m = rng.integers(0, 60, 2)
        at, size = rng.integers(0, 40, (n + m, 2)), rng.choice([-1, 0, 1, 3, 9, 60], (n + m, 2))
        boxes = np.concatenate([at, at + size], axis=1).astype(float)
        if case % 3 == 0 and n + m:
            boxes[rng.integers(0, n + m)] = np.nan
        words, spans, rank = boxes[:n], boxes[n:], rng.permutation(m)
        best, top = joins.best_spans(words, spans, rank)
        for w, j, share in zip(words, best, top):
            found = []
            for k, s in enumerate(spans):
                dx, dy = min(w[2], s[2]) - max(w[0], s[0]), min(w[3], s[3]) - max(w[1], s[1])
                if dx > 0 and dy > 0 and not np.isnan([*w, *s]).any():
                    found.append((-dx * dy / max((w[2] - w[0]) * (w[3] - w[1]), 1e-9), rank[k], k))
            assert (j, share) == ((min(found)[2], -min(found)[0]) if found else (-1, 0))


def test_whole_numbers_round_as_others_do(spark):
    df = spark.createDataFrame([(x,) for x in (None, 0.0, -0.0, 7.0, -3.0, 2.0005, 2.0015, -0.0004, 1e15, 1e300, 0.1 + 0.2)], "v double")
    rows = df.selectExpr("v", "bround(v, 3) as wanted").withColumn("got", G.places(F.col("v"), 3)).collect()
    assert all(r.got == r.wanted for r in rows) and len(rows) == 11
