import zlib
from collections import Counter

from pagelattice.llm import sharding


def _check(rows, texts):
    n, k = len(rows), 24
    per = Counter(r.shard for r in rows)
    assert max(per.values(), default=0) - min((per.get(i, 0) for i in range(k)), default=0) <= 1
    for shard in per:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(per[shard]))
    assert sorted(r.position for r in rows) == list(range(n))
    assert all(r.law == "rows" and r.grown_shard is None for r in rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sharding.op3_sharding(spark, sf).collect()
    _check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    # interleaving: any prefix holds each source in proportion, within one row of each
    by_place = sorted(rows, key=lambda r: r.position)
    totals = Counter(r.source for r in rows)
    for cut in (50, 100, 150):
        seen = Counter(r.source for r in by_place[:cut])
        assert all(abs(seen[s] - cut * totals[s] / len(rows)) < 2 for s in totals)


def test_seed_and_repeat(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = {(r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(docs).collect()}
    assert a == {(r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(docs.repartition(7)).collect()}
    assert a != {(r.doc_id, r.shard, r.slot) for r in sharding.shard_rows(docs, seed="other").collect()}


def test_odd_rows(odd_docs, no_docs):
    _check(sharding.shard_rows(odd_docs).collect(), [(r.doc_id, r.text) for r in odd_docs.collect()])
    assert sharding.shard_rows(no_docs).collect() == []


def test_hot_source_spans_buckets(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id < 2500, 'hot', cast(id % 5 as string)) as source")
    rows = sharding.shard_rows(docs).collect()
    _check(rows, [(i, str(i)) for i in range(3000)])
    # a cut by position differs from a cut by fraction by one row of each of the six sources at most
    hot = Counter(r.shard for r in rows if r.source == "hot")
    assert max(hot.values()) - min(hot.values()) <= 6


def test_null_ids_and_sources_of_one_row_spread_over_buckets(spark, monkeypatch):
    """No bucket that a task ranks holds more than a few times its share."""
    largest = []
    rank = sharding.bucketed_rank

    def watched(df, group, bucket, order, out):
        sizes = df.groupBy(*group, bucket).count()
        largest.append(sizes.agg({"count": "max"}).first()[0])
        return rank(df, group, bucket, order, out)

    monkeypatch.setattr(sharding, "bucketed_rank", watched)
    docs = spark.range(20_000).selectExpr("cast(if(id % 3 = 0, null, id) as long) as doc_id", "cast(id as string) as text", "if(id % 3 = 0, 'hot', cast(id as string)) as source")
    rows = sharding.shard_rows(docs).collect()
    _check(rows, [(None if i % 3 == 0 else i, str(i)) for i in range(20_000)])
    assert max(largest) <= 3 * 20_000 / 64
