import difflib
import logging
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from pagelattice import catalog
from pagelattice.operators import access, aggregates, drawlist, facets, joins, scan, voting
from pagelattice.plans import stages
from pagelattice.sources import documents, fixtures, sinks


def test_reading_order(spark):
    rows = [(0, 0, "c", 5.0, 10.4), (0, 1, "a", 0.0, 10.5), (0, 2, "b", 3.0, 9.6), (0, 3, "d", 0.0, 11.5)]
    words = spark.createDataFrame(rows, "page_index long, ord long, text string, x0 double, y0 double")
    got = [r.text for r in scan.reading_order(words).orderBy("seq").collect()]
    assert got == ["a", "b", "c", "d"]  # 10.5 rounds to 10, 11.5 to 12


def test_pages(spark, sf):
    pages = fixtures.page_meta(spark, sf)
    assert scan.prune_pages(pages, 3).select("page_number").first()[0] == 4
    assert scan.lookup_pages(pages, [1, 2]).count() == 2
    assert scan.lookup_pages(pages).count() == pages.count()
    found = scan.lookup_pages(pages, [0, 10_000_000])
    assert found.columns == pages.columns
    with pytest.raises(Exception, match="page out of range: 10000000"):
        found.collect()


def _span(spark, rows):
    return spark.createDataFrame(rows, "page_index long, span_ord long, font string, size double, dir_x double, dir_y double, x0 double, y0 double, x1 double, y1 double")


def test_span_match(spark):
    words = spark.createDataFrame([(0, 0, 0.0, 0.0, 10.0, 10.0), (0, 1, 50.0, 50.0, 60.0, 60.0), (1, 0, 0.0, 0.0, 10.0, 10.0)], "page_index long, ord long, x0 double, y0 double, x1 double, y1 double")
    spans = _span(spark, [(0, 0, "A", 1.0, 1.0, 0.0, 8.0, 8.0, 20.0, 20.0), (0, 1, "B", 2.0, 0.0, 1.0, 0.0, 0.0, 10.0, 10.0), (0, 2, "C", 3.0, 0.0, 1.0, 0.0, 0.0, 10.0, 10.0)])
    got = {(r.page_index, r.ord): r for r in joins.match_spans(words, spans).collect()}
    assert got[0, 0].font == "B" and got[0, 0].span_ord == 1 and got[0, 0].orientation_source == "text-span"
    for key in ((0, 1), (1, 0)):
        assert (got[key].font, got[key].font_size, got[key].dir_x, got[key].orientation_source) == ("", 0.0, 1.0, "fallback")


def test_span_match_over_many_cells(spark):
    words = spark.createDataFrame([(0, 0, 0.0, 0.0, 500.0, 500.0)], "page_index long, ord long, x0 double, y0 double, x1 double, y1 double")
    spans = _span(spark, [(0, 0, "A", 1.0, 1.0, 0.0, 0.0, 0.0, 300.0, 300.0)])
    assert joins.match_spans(words, spans).count() == 1


def test_unknown_opcodes_keep_their_index(spark):
    point = "struct<x: double, y: double>"
    rows = [(0, 1, "", [1.0, 0.12345], None, None, [("l", [(0.0, 5.0), (3.0, 1.0)]), ("sh", []), ("re", [(1.0, 1.0), (2.0, 2.0)])])]
    df = spark.createDataFrame(rows, f"page_index long, seq long, layer string, stroke_color array<double>, dashes string, stroke_width double, items array<struct<op: string, points: array<{point}>>>")
    got = scan.extract_paths(df).orderBy("item_index").collect()
    assert [(r.item_index, r.kind, r.x0, r.y0, r.x1, r.y1) for r in got] == [(0, "l", 0, 1, 3, 5), (2, "re", 1, 1, 2, 2)]
    assert got[0].layer is None and got[0].stroke_color == [1.0, 0.123] and got[0].operation_count == 3


def _items(spark):
    rows = [("drawings", 0, 0, "re", "f", "#1", None, True, None, 0.0, 0.0, 10.0, 10.0), ("drawings", 0, 1, "l", "s", None, "#2", False, None, 20.0, 20.0, 30.0, 30.0),
            ("drawings", 0, 2, "c", "fs", "#1", "#2", None, None, 5.0, 5.0, 6.0, 6.0), ("images", 0, 0, "image", None, None, None, None, True, 0.0, 0.0, 5.0, 5.0), ("text", 0, 0, "word", None, None, None, None, None, 1.0, 1.0, 2.0, 2.0)]
    return spark.createDataFrame(rows, "layer_key string, page_index long, ord long, item_kind string, path_type string, stroke_color string, fill_color string, close_path boolean, has_mask boolean, x0 double, y0 double, x1 double, y1 double")


def test_facets(spark):
    items = _items(spark)

    def ids(selected):
        return sorted((r.layer_key, r.ord) for r in facets.filter_items(items, selected).collect())

    assert len(ids({})) == 5 and len(ids({"item_kind": [], "nothing": ["x"]})) == 5
    assert ids({"item_kind": ["re", "l"]}) == [("drawings", 0), ("drawings", 1)]
    assert ids({"close_path": ["None"], "item_kind": ["c", "re"]}) == [("drawings", 2)]
    assert ids({"fill_color": [facets.NONE], "item_kind": ["re"]}) == [("drawings", 0)]
    assert ids({"path_type": ["f"]}) == [("drawings", 0)]
    assert [r.layer_key for r in facets.filter_layers(items).collect()] == ["text"]
    assert facets.filter_layers(items, ["images", "drawings"], {"images": {"has_mask": ["False"]}}).count() == 3
    options = {(r.facet, r.value) for r in facets.color_options(items).collect()}
    assert options == {("stroke_color", "#1"), ("stroke_color", facets.NONE), ("fill_color", "#2"), ("fill_color", facets.NONE)}


def test_facet_predicates_reach_the_scan(spark, tmp_path):
    _items(spark).write.parquet(str(tmp_path / "items"))
    plan = facets.filter_items(spark.read.parquet(str(tmp_path / "items")), {"item_kind": ["re"]})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "item_kind" in plan.split("PushedFilters: [")[1]


def test_access(spark):
    items = _items(spark)
    assert access.viewport_query(items, (6, 6, 8, 8)).count() == 2
    assert access.topmost(items, ["page_index"], 5.5, 5.5, ["layer_key", "ord"]).first().ord == 2
    delta = {(r.layer_key, r.ord): r.change for r in access.viewport_delta(items, (0, 0, 1, 1), (20, 20, 30, 30), ["layer_key", "ord"]).collect()}
    assert delta == {("drawings", 0): "delete", ("images", 0): "delete", ("text", 0): "delete", ("drawings", 1): "draw"}
    groups = items.withColumn("category", F.when(F.col("layer_key") == "text", 0).otherwise(1)).withColumn("group_id", F.col("ord"))
    hit = access.hit_test(groups, ["page_index"], 2.5, 2.5, 1.0).first()
    assert (hit.category, hit.group_id) == (0, 0)
    assert access.hit_test(groups, ["page_index"], 500.0, 500.0, 1.0).collect() == []
    assert access.view_rect((0, 0, 100, 100), [2, 0, 0, 2, 0, 0]) == (-10, -10, 60, 60)


def test_grid_quirks(spark):
    rows = [(0, 0, 0.0, 0.0, 1000.0, 1000.0)] + [(0, i, float(i), 0.0, float(i + 2), 2.0) for i in range(1, 8)]
    items = spark.createDataFrame(rows, "page_index long, ord long, x0 double, y0 double, x1 double, y1 double")
    assert access.grid_side(items, ["page_index"]).first().side == 2
    assert access.viewport_query(items, (0, 0, 1, 1)).count() == 2
    assert access.viewport_query_parity(items, ["page_index"], (0, 0, 1, 1)).count() == 1  # the large one is known at its centre only
    assert access.viewport_query_parity(items, ["page_index"], (600, 600, 900, 900)).count() == 8  # too many cells: everything


def _vote_by_definition(texts):
    """Groups led by their first text, the best total, the loudest member's text."""
    led, said = {}, []
    for text, sure in texts:
        plain = " ".join(text.split()).casefold()
        if plain:
            lead = next((x for x in led if difflib.SequenceMatcher(None, plain, x).ratio() >= 0.75), plain)
            led.setdefault(lead, len(said))
            said.append((lead, text, sure))
    if not said:
        return "", 0.0
    total = {x: sum(c for y, _, c in said if y == x) for x in led}
    best = max(led, key=lambda x: (total[x], -led[x]))
    mine = [(t, c) for y, t, c in said if y == best]
    return max(mine, key=lambda m: m[1])[0], sum(c for _, c in mine) / len(mine)


def test_leaders():
    assert voting.leaders(["AB12", "ab  12", "Ab1Z", "XYZQ", " ", None, "xyzq "]) == [0, 0, 0, 3, -1, -1, 3]
    assert difflib.SequenceMatcher(None, "bdcabab", "bdcbaab").ratio() != difflib.SequenceMatcher(None, "bdcbaab", "bdcabab").ratio()
    for lead, reading in (("bdcbaab", "bdcabab"), ("bdcabab", "bdcbaab")):
        near = difflib.SequenceMatcher(None, reading, lead).ratio() >= 0.75
        assert voting.leaders([lead, reading]) == [0, 0 if near else 1]


def test_fuzzy_votes(spark):
    rng = random.Random(4)
    clusters = [["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 8))] for _ in range(400)]
    texts = [[(t, rng.randint(0, 99)) for t in c] for c in clusters]
    rows = [(k, i, t, c) for k, x in enumerate(texts) for i, (t, c) in enumerate(x)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "cluster_id long, rotation_index int, text string, confidence long")
    got = {r.cluster_id: (r.text, r.confidence) for r in voting.vote_fuzzy(df).collect()}
    for k, x in enumerate(texts):
        text, sure = _vote_by_definition(x)
        assert got[k] == (text, pytest.approx(sure)), x


def test_votes_on_tables(spark):
    rows = [(1, i, t, c) for i, (t, c) in enumerate([("AB12 ", 0.6), (" ab12 ", 0.55), ("XYZQ", 0.99)])] + [(2, 0, " ", 0.9)]
    df = spark.createDataFrame(rows, "cluster_id long, rotation_index int, text string, confidence double")
    for f in (voting.vote_exact, voting.vote_fuzzy):
        got = {r.cluster_id: (r.text, round(r.confidence, 3)) for r in f(df).collect()}
        assert got == {1: ("AB12 ", 0.575), 2: ("", 0.0)}
    assert {r.cluster_id: r.rotation_used for r in voting.best_rotation(df).collect()} == {1: 90, 2: 0}


def test_rotations_and_engine(spark):
    clusters = spark.createDataFrame([(1,), (2,)], "cluster_id long")
    assert [r.angle for r in voting.rotation_fanout(clusters.limit(1), 4).orderBy("angle").collect()] == [0, 90, 180, 270]
    with pytest.raises(ValueError):
        voting.rotation_fanout(clusters, 0)
    images = voting.rotation_fanout(clusters, 2).withColumn("image", F.when(F.col("cluster_id") == 1, F.encode(F.lit("hi"), "utf-8")))

    def engine():
        return lambda image: (image.decode(), 0.5)

    got = {(r.cluster_id, r.rotation_index): (r.text, r.confidence) for r in voting.read_clusters(images, engine).collect()}
    assert got[1, 0] == ("hi", 0.5) and got[2, 1] == ("", 0.0)


def test_draw_list(spark):
    drawings = spark.createDataFrame([(0, 3, 1.0, 2.0, None)], "page_index long, seq long, x0 double, y0 double, stroke_width double")
    words = spark.createDataFrame([(0, 0, "a", 1.0, 9.0, None, None, 0.2, 91.0), (0, 1, " ", 1.0, 9.0, None, None, 5.0, 0.0)], "page_index long, ord long, text string, x0 double, y1 double, origin_x double, origin_y double, font_size double, angle double")
    results = spark.createDataFrame([(0, 7, "r", 5.0, 5.0, 6.0, 270)], "page_index long, ord long, text string, x0 double, y0 double, y1 double, rotation_used int")
    got = [tuple(r) for r in drawlist.reconstruction(drawings, words, results).orderBy("z").collect()]
    assert got == [(0, 0, 3, "drawing", "", 1.0, 2.0, 1.0, 0), (0, 1, 0, "word", "a", 1.0, 9.0, 1.0, 90), (0, 2, 7, "result", "r", 5.0, 6.0, 4.0, 270)]


def test_metadata(spark):
    df = spark.createDataFrame([("re", 0.0, 0.0, 1.234, 2.0, None, {"shape": "path", "note": None}), ("l", 0.0, 0.0, 1.0, 1.0, "L", None)], "item_kind string, x0 double, y0 double, x1 double, y1 double, label string, metadata map<string,string>")
    got = [r.m for r in scan.item_metadata(df).select(scan.format_metadata(F.col("metadata"), ["kind", "missing"]).alias("m")).collect()]
    assert got == ["kind: re\nbbox: 0.0, 0.0, 1.23, 2.0\nshape: path", "kind: l\nbbox: 0.0, 0.0, 1.0, 1.0\nlabel: L\nshape: rect"]


def _context(spark, sf, **more):
    return stages.Context(pages=fixtures.page_meta(spark, sf), words=fixtures.words(spark, sf), drawings=fixtures.raw_drawings(spark, sf), **more)


def test_stages(spark, sf):
    assert list(stages.STAGES) == ["reader", "native", "vector_extract", "layer_separation", "color_separation", "clustering", "drawing_vectors", "ocr_text_clusters"]
    out = stages.run_stages(_context(spark, sf))
    assert [s.status for s in out] == ["ok"] * 8
    assert out[-1].data.count() > 0
    cut = stages.run_stages(_context(spark, sf), "native")
    assert [s.key for s in cut] == ["reader", "native"]
    with pytest.raises(ValueError):
        stages.run_stages(_context(spark, sf), "nothing")


def test_failed_stages_are_reported(spark, sf):
    broken = stages.Context(pages=fixtures.page_meta(spark, sf), words=None, drawings=fixtures.raw_drawings(spark, sf))
    status = {s.key: s.status for s in stages.run_stages(broken, "layer_separation")}
    assert status == {"reader": "ok", "native": "error", "vector_extract": "ok", "layer_separation": "ok"}
    late = stages.Context(pages=fixtures.page_meta(spark, sf).withColumn("width", F.raise_error(F.lit("bad")).cast("double")))
    out = stages.run_stages(late, "reader", materialize=True)
    assert out[0].status == "error" and "bad" in out[0].error


def test_memo(spark):
    calls = []
    memo = stages.Memo(lambda *a: calls.append(a) or spark.range(3))
    a = memo.get([1], ["none"], {"none": {"b": 1, "a": 2}})
    assert memo.get([1], ["none"], {"none": {"a": 2, "b": 1}}) is a and len(calls) == 1
    memo.get([1], ["none"])
    assert len(calls) == 2
    memo.clear()


def test_logging():
    a, b = sinks.configure_logging(1), sinks.configure_logging(-1)
    assert a is b and len(a.handlers) == 1 and a.level == logging.WARNING
    assert sinks.stage_logger("x").parent is a


def test_documents_and_pictures(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    docs = documents.list_documents(spark, str(tmp_path))
    assert docs.count() == 1
    out = sinks.rasterize_pages(docs, 72, renderer=lambda content, dpi: [content, b"2"]).collect()
    assert [(r.page_index, bytes(r.image)) for r in out] == [(0, b"one"), (1, b"2")]
    with pytest.raises(ValueError):
        sinks.rasterize_pages(docs, 0)
    zoomed = sinks.rasterize_zoomed(docs, 100.0, renderer=lambda content, dpi: [str(dpi).encode()]).first()
    assert bytes(zoomed.image) == b"432" and zoomed.error is None

    def broken(content, dpi):
        raise RuntimeError("no page tree")

    row = sinks.rasterize_pages(docs, 72, renderer=broken).first()
    assert row.image is None and "no page tree" in row.error
    pytest.importorskip("pymupdf")
    assert documents.read_pages(docs).first().error


def _page_row(path, number, offset):
    """A row of ``PAGE_SCHEMA``: words, a block of two spans, and a drawing of more than a thousand items."""
    points = lambda *xy: [{"x": float(x), "y": float(y)} for x, y in xy]
    items = [{"op": "l", "points": points((offset + i % 40 * 4, 10 + i // 40 * 3), (offset + i % 40 * 4 + 2, 10 + i // 40 * 3))} for i in range(1100)]
    style = {"layer": None, "stroke_color": None, "stroke_opacity": None, "fill_opacity": 0.5, "stroke_width": None, "dashes": None, "closed": True, "fill_rule": "f"}
    drawings = [{"seq": 0, "fill_color": [0.1234, 0.0, 0.0], "items": items, **style}, {"seq": 1, "fill_color": [0.0, 0.0, 1.0], "items": items[:3], **style}]
    words = [{"ord": i, "text": f"{path[-5]}{i}", "x0": 10.0 * (3 - i), "y0": 5.0, "x1": 10.0 * (3 - i) + 8, "y1": 15.0} for i in range(3)]
    span = {"font": "F", "size": 9.0, "flags": 0, "dir": {"x": 1.0, "y": 0.0}, "x0": 0.0, "y0": 0.0, "x1": 40.0, "y1": 20.0}
    blocks = [{"type": 0, "lines": [[{"text": " ", **span}, {"text": path, **span}]]}]
    return {
        "doc_path": path, "page_index": number, "page_number": number + 1, "x0": 0.0, "y0": 0.0, "x1": 200.0, "y1": 200.0, "raw_rotation": 0, "width": 200.0, "height": 200.0,
        "words": words, "blocks": blocks, "drawings": drawings, "error": None,
    }


def test_two_documents_with_equal_pages(spark):
    pages = spark.createDataFrame([_page_row("/in/a.pdf", 0, 0), _page_row("/in/b.pdf", 0, 100)], documents.PAGE_SCHEMA)
    context = stages.Context(pages=pages, words=documents.page_words(pages), drawings=documents.page_drawings(pages), order=["cluster_spatial"])
    out = {s.key: s for s in stages.run_stages(context, materialize=True)}
    assert {s.status for s in out.values()} == {"ok"}
    words = {(r.doc_path, r.seq): r.text for r in out["native"].data.collect()}
    assert words == {(f"/in/{d}.pdf", k): f"{d}{2 - k}" for d in "ab" for k in range(3)}
    spans = scan.flatten_spans(documents.page_blocks(pages))
    assert {(r.doc_path, r.span_ord, r.text) for r in spans.collect()} == {("/in/a.pdf", 1, "/in/a.pdf"), ("/in/b.pdf", 1, "/in/b.pdf")}
    matched = joins.match_spans(documents.page_words(pages), spans).collect()
    assert len(matched) == 6 and all(r.span_ord == 1 and r.font == "F" for r in matched)
    paths = out["color_separation"].data
    assert paths.select("doc_path", "path_id").distinct().count() == paths.count() == 2206
    assert {r.color_key for r in paths.select("color_key").distinct().collect()} == {"-/0.123,0.0,0.0/-/0.5", "-/0.0,0.0,1.0/-/0.5"}
    groups = out["clustering"].data[-1][1].groupBy("doc_path", "color_key").agg(F.count_distinct("group_id").alias("n")).collect()
    assert len(groups) == 4 and all(r.n == 1 for r in groups)
    assert {(r.doc_path, r.layer_key, r.n) for r in out["layer_separation"].data.collect()} == {("/in/a.pdf", "", 1103), ("/in/b.pdf", "", 1103)}
    assert drawlist.draw_styles(paths).where("drawable and closed").count() == 2206
    assert aggregates.build_drawings(paths).count() == 4


def test_shown_values_and_optional_geometry(spark):
    df = spark.sql("""select 'quad' item_kind, 0D x0, 0D y0, 4D x1, 2D y1, cast(null as string) label, map('font_size', '9') metadata, 30.5D angle,
        array(named_struct('x', 1.005D, 'y', 2D), named_struct('x', cast(null as double), 'y', 3D)) quad, true flag,
        array(1, 2) numbers, cast(array() as array<double>) none, named_struct('a', 1.5D, 'b', false) pair""")
    shown = [scan.show_value(F.col(c), df.schema[c].dataType).alias(c) for c in ("angle", "flag", "numbers", "none", "pair", "label")]
    assert tuple(df.select(shown).first()) == ("30.500", "Yes", "[1, 2]", "[]", "(1.500, No)", None)
    text = scan.item_metadata(df).select(scan.format_metadata(F.col("metadata"), ["kind"], pretty=True).alias("t")).first().t
    assert text.split("\n") == ["Kind: quad", "Angle: 30.500", "Bbox: 0.0, 0.0, 4.0, 2.0", "Font Size: 9", "Quad: [(1.000, 2.000), (, 3.000)]", "Shape: rect"]


def test_streams(spark, sf, tmp_path):
    from pagelattice.streaming import pages as S

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = S.stream_table(spark, str(tmp_path / "in"), events.schema, 1)
    S.per_batch(stream, lambda df: df.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    total = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("count")).first()[0]
    assert total == events.count()
    counts = S.windowed_counts(S.stream_table(spark, str(tmp_path / "in"), events.schema), "ts", "event_type")
    query = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.sql("select sum(n) from counts").first()[0] == events.count()


def test_entry_points(spark):
    names = catalog.queries()
    assert set(catalog.oracle_sql()) <= set(names) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns


@pytest.mark.parametrize("name", ["path_extract", "word_span_match", "ocr_vote_fuzzy", "two_documents", "cluster_by_seq", "filter_aspect_ratio", "ocr_vote", "viewport_delta"])
def test_against_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("lineitem", "documents", "events", "part"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf)
    res = con.execute(catalog.oracle_sql()[name])
    order = [d[0] for d in res.description]
    want = sorted((tuple(r) for r in res.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in order) for r in df.collect()), key=str) == want


def test_command_line(spark, sf, capsys):
    from pagelattice.__main__ import main

    assert main(["--tables", sf, "--page", "3", "--final-stage", "layer_separation"], spark) == 0
    shown = capsys.readouterr().out.splitlines()
    assert shown[0] == "reader: ok" and " words: " in shown[1] and shown[-1] == "layer_separation: ok"
    with pytest.raises(SystemExit):
        main(["--tables", sf, "--final-stage", "nothing"], spark)


def test_schemas_and_observed_counts(spark):
    from pagelattice import schemas

    assert spark.createDataFrame([], schemas.PATHS).columns[:4] == ["doc_path", "page_index", "seq", "item_index"]
    df, seen = sinks.observed(spark.range(7), "seven")
    df.collect()
    assert seen.get["rows"] == 7
