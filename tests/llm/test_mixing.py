import random
from collections import Counter
from fractions import Fraction

import pytest

from pagelattice.llm import mixing
from pagelattice.runtime import materialize


def test_exact_weights():
    assert mixing.exact_weights({"a": 0.5, "b": 0.25}) == {"a": 2, "b": 1}
    with pytest.raises(ValueError):
        mixing.exact_weights({"a": 0})


def _check(rows, n):
    assert sorted(r.position for r in rows) == list(range(n))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    order = sorted(rows, key=lambda r: r.position)
    assert [r.slot for r in order] == sorted(r.slot for r in rows)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = mixing.op7_mixing(spark, sf).collect()
    _check(rows, docs.count())
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())


def test_weights_hold_until_a_source_ends(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id < 3000, 'hot', 'cold') as source")
    rows = mixing.mix(docs, {"hot": 1, "cold": 1}, block_rows=10).collect()
    _check(rows, 4000)
    order = sorted(rows, key=lambda r: r.position)
    for cut in (20, 100, 1000, 1990):
        hot = sum(r.source == "hot" for r in order[:cut])
        assert abs(hot - cut / 2) < 10
    assert {r.source for r in order[2000:]} == {"hot"}


def test_unlisted_sources_share_a_stratum(odd_docs):
    rows = mixing.mix(odd_docs, {"a": 3, "": 1}, block_rows=2).collect()
    _check(rows, odd_docs.count())
    assert {r.source for r in rows} == {"a", ""}


def test_odd_rows_and_layout(spark, odd_docs, no_docs):
    _check(mixing.mix(odd_docs, block_rows=3).collect(), odd_docs.count())
    assert mixing.mix(no_docs).collect() == []
    extra = odd_docs.withColumnRenamed("h", "__position")
    out = mixing.in_mixed_order(extra, block_rows=3)
    assert out.columns == extra.columns
    assert Counter(map(tuple, out.collect())) == Counter(map(tuple, extra.collect()))
    assert mixing.in_mixed_order(no_docs).collect() == []


def test_blocks_grow_beyond_their_bound(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id < 4000, 'hot', 'cold') as source")
    rows = mixing.mix(docs, {"hot": 3, "cold": 1}, block_rows=1, max_blocks=100).collect()
    _check(rows, 5000)
    assert max(r.slot for r in rows) == 99 and max(Counter(r.slot for r in rows).values()) == 50


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 1 / 3, "b": 2 / 3}, {"a": 0.9999, "b": 1e-4}, {f"s{i}": random.Random(i).random() for i in range(20)}])
def test_deviation_at_every_slot(weights):
    total, n = sum(Fraction(w) for w in weights.values()), 100_000
    names, at = mixing.timetable({s: int(Fraction(w) / total * n) + 2 for s, w in weights.items()}, weights)
    share, seen = [Fraction(weights[s]) / total for s in names], [0] * len(names)
    off = [0.0] * len(names)
    for t, i in enumerate(at["source"][: n - 50], 1):
        seen[i] += 1
        off = [max(o, abs(x - t * float(w))) for o, x, w in zip(off, seen, share)]
    assert max(off) < 1 + 1e-6


@pytest.mark.parametrize("hot", [1 / 3, 0.5])
def test_deviation_is_against_the_given_weights(spark, hot):
    """A hot source among 99 or 255 others keeps its given weight, not a rounded share."""
    others = 99 if hot < 0.5 else 255
    docs = spark.range(3000 + 12 * others).selectExpr(
        "id as doc_id", "cast(id as string) as text", f"if(id < 3000, 'hot', concat('s', id % {others})) as source"
    )
    weights = {"hot": hot, **{f"s{i}": (1 - hot) / others for i in range(others)}}
    rows = mixing.mix(docs, weights, block_rows=1).collect()
    _check(rows, 3000 + 12 * others)
    seen, total = Counter(), sum(weights.values())
    for t, r in enumerate(sorted(rows, key=lambda r: r.position)[:1700], 1):
        seen[r.source] += 1
        if t % 50 == 0:
            assert all(abs(seen[s] - t * w / total) < 1 + 1e-9 for s, w in weights.items())


def test_timetable_keeps_tiny_weights_over_many_blocks():
    """Deviation stays under a block at every slot of a long schedule."""
    weights = {"hot": 1.0, "cold": 0.37, "tiny": 1e-5}
    names, at = mixing.timetable({"hot": 150_000, "cold": 60_000, "tiny": 2}, weights)
    total, seen = sum(weights.values()), [0] * 3
    for t, i in enumerate(at["source"][:190_000], 1):
        seen[i] += 1
        assert all(abs(n - t * weights[s] / total) < 1 + 1e-6 for n, s in zip(seen, names))
    assert Counter(at["source"]) == Counter({names.index("hot"): 150_000, names.index("cold"): 60_000, names.index("tiny"): 2})


def test_queries_mix_any_number_of_sources(spark, tmp_path):
    """5,000 sources, unweighted and each to a weight of its own."""
    docs = spark.range(20000).selectExpr("id as doc_id", "cast(id as string) as text", "'en' as lang", "concat('s', id % 5000) as source", "1L as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.op7_mixing(spark, str(tmp_path)).collect()
    _check(rows, 20000)
    assert len({r.source for r in rows}) == 5000
    assert mixing.in_mixed_order(docs).count() == 20000
    weights = {f"s{i}": 1 + i % 3 for i in range(5000)}
    listed = sorted(mixing.mix(docs, weights, block_rows=1).collect(), key=lambda r: r.position)
    _check(listed, 20000)
    first = Counter(weights[r.source] for r in listed[:9999])  # a slot before every weight has its whole share
    assert {w: round(n / len([x for x in weights.values() if x == w])) for w, n in first.items()} == {1: 1, 2: 2, 3: 3}


def test_order_survives_files_of_unequal_size(spark):
    """Later files are larger, so Spark reads them first; the sequence is that of ``mix`` all the same."""
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id < 600, 'x', repeat(uuid(), 20)) as text", "if(id < 600, 'cold', 'hot') as source")
    docs = materialize(docs, "t")
    want = {r.doc_id: r.position for r in mixing.mix(docs, {"cold": 9, "hot": 1}).collect()}
    written = materialize(mixing.in_mixed_order(docs, weights={"cold": 9, "hot": 1}), "t")
    assert {r.doc_id: r.position for r in mixing.read_in_order(written).collect()} == want
    assert [r.doc_id for r in written.collect()] != sorted(want, key=want.get)
