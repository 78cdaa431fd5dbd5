from pagelattice.llm import near_copies, simhash


def _grams(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept_by_all_pairs(docs):
    """Ids kept by comparing all pairs."""
    sets = {i: _grams(t) for i, t in docs}
    group = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(group[i], group[j])
            if group[i] != low or group[j] != low:
                group[i] = group[j] = low
                changed = True
    return {i for i, g in group.items() if i == g}, links


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, _ = kept_by_all_pairs([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id for r in near_copies.keep_first(docs).collect()} == kept
    assert kept < {r.doc_id for r in simhash.keep_first(docs).collect()}  # edited copies are beyond two bits


def test_limit_and_a_large_group(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    rows += [(k, " ".join([*base, f"end{k}"])) for k in range(1, 60)]  # a large group of near copies
    rows += [(100, " ".join(f"v{i}" for i in range(13))), (101, " ".join([*(f"v{i}" for i in range(12)), "x"]))]  # 8 of 10
    rows += [(102, " ".join(f"u{i}" for i in range(12))), (103, " ".join([*(f"u{i}" for i in range(11)), "x"]))]  # 7 of 9
    kept, links = kept_by_all_pairs(rows)
    assert (100, 101) in links and (102, 103) not in links
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_first(docs).collect()} == kept == {0, 100, 102, 103}


def test_a_chain_no_pivot_sees(spark, monkeypatch):
    """Each text is similar to its neighbours only, all share a passage, and turns are taken first."""
    monkeypatch.setattr(near_copies, "PAIRS_A_TOKEN", 0)
    common = " ".join(f"c{i}" for i in range(90))
    rows = [(k, common + " " + " ".join(f"t{k + i}" for i in range(30))) for k in range(0, 240, 4)]
    kept, links = kept_by_all_pairs(rows)
    assert 0 < len(links) < len(rows) * (len(rows) - 1) // 2
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in near_copies.keep_first(docs).collect()} == kept


def test_order_and_prefix_do_not_matter(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, _ = kept_by_all_pairs([(r.doc_id, r.text) for r in docs.collect()])
    monkeypatch.setattr(near_copies, "HOT_LEAST", 3)
    assert {r.doc_id for r in near_copies.keep_first(docs).collect()} == kept


def test_repeated_ids(spark):
    rows = [(1, "a b c", "z"), (1, "a b c", "y"), (1, "d e f", "x"), (2, "a b c", "w"), (None, "a b c", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    assert sorted(map(str, near_copies.keep_first(docs).collect())) == sorted(map(str, spark.createDataFrame([rows[1], rows[2], rows[4]], docs.schema).collect()))


def test_odd_rows(odd_docs, no_docs):
    out = near_copies.keep_first(odd_docs)
    assert out.columns == odd_docs.columns
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == [1, 3, 5, 8, 9, 10]
    assert near_copies.keep_first(no_docs).collect() == []
