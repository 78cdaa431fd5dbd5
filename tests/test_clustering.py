import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pagelattice.operators import aggregates, clustering, components, joins
from pagelattice.operators.components import connected_components
from pagelattice.plans import chain

SCHEMA = """page_index long, layer_key string, color_key string, path_id long, seq long, kind string, x0 double, y0 double, x1 double, y1 double,
stroke_width double, dashes string"""


def make(spark, boxes, seqs=None, kinds=None, page=0):
    rows = [
        (page, "", "k", i, (seqs or range(len(boxes)))[i], (kinds or ["l"] * len(boxes))[i], *map(float, b), None, None) for i, b in enumerate(boxes)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def pages(spark, side=200.0):
    return spark.createDataFrame([(p, side, side) for p in range(4)], "page_index long, width double, height double")


def start(df):
    return clustering.singletons(joins.with_drawing_stats(df, clustering.BUCKET))


def sizes(df):
    return sorted(Counter(r.group_id for r in df.collect()).values())


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.group_id, set()).add(r.path_id)
    return sorted(map(sorted, out.values()))


def test_components(spark):
    edges = spark.createDataFrame([(5, 3), (3, 9), (2, 2), (7, 8), (8, 7), (None, 1)] + [(i, i + 1) for i in range(100, 160)], "a long, b long")
    found = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert {found[i] for i in (3, 5, 9)} == {3} and {found[i] for i in (7, 8)} == {7}
    assert {found[i] for i in range(100, 161)} == {100} and 2 not in found and 1 not in found
    assert connected_components(edges.limit(0), "a", "b").collect() == []


@pytest.mark.parametrize("run", [1, 7, 64])
@pytest.mark.parametrize("within", [None, "w"])
def test_components_of_runs_of_any_size(spark, monkeypatch, run, within):
    """Contraction by small runs and star rounds together give the components of all edges."""
    monkeypatch.setattr(components, "RUN", run)
    rng = random.Random(run)
    edges = [(w, 100 * w + rng.randrange(60), 100 * w + rng.randrange(60)) for w in range(3) for _ in range(40)] + [(3, 300 + i, 301 + i) for i in range(30)]
    lead = {}
    for _, a, b in edges:
        if a != b:
            lead.setdefault(a, a), lead.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for _, a, b in edges:
            if a != b and lead[a] != lead[b]:
                lead[a] = lead[b] = min(lead[a], lead[b])
                changed = True
    df = spark.createDataFrame(edges, "w long, a long, b long").repartition(3)
    node = lambda c: F.struct(F.when(F.col("w") > 0, F.col("w")).alias("w"), F.col(c).alias("n"))
    got = components.connected_components(df.select("w", node("a").alias("a"), node("b").alias("b")), "a", "b", within=within)
    assert {r.node.n: r.component.n for r in got.collect()} == lead
    assert all((r.node.w is None) == (r.node.n < 100) for r in got.collect())


def test_spatial(spark):
    df = start(make(spark, [(0, 0, 1, 1), (1.5, 0, 2.5, 1), (50, 50, 51, 51)]))
    assert groups(clustering.cluster_spatial(df, 1.0)) == [[0, 1], [2]]
    chained = start(make(spark, [(0, 0, 1, 1), (2, 0, 3, 1), (4, 0, 5, 1)]))
    assert sizes(clustering.cluster_spatial(chained, 1.0)) == [3]
    assert clustering.cluster_spatial(df.limit(0)).collect() == []


def test_buckets_stay_apart(spark):
    a, b = make(spark, [(0, 0, 1, 1)]), make(spark, [(0, 0, 1, 1)], page=1)
    other = make(spark, [(0, 0, 1, 1)]).withColumn("layer_key", F.lit("A"))
    assert clustering.cluster_spatial(start(a.unionByName(b).unionByName(other))).count() == 3
    pairs = joins.spatial_pairs(a.unionByName(b).unionByName(other), clustering.BUCKET, "path_id", 9.0)
    assert pairs.count() == 0


def test_grid_join_finds_all_pairs_once(spark):
    boxes = [((i * 37) % 300, (i * 61) % 300, (i * 37) % 300 + i % 90, (i * 61) % 300 + i * 7 % 50) for i in range(120)]
    df = make(spark, boxes)

    def gap(a, b):
        dx, dy = max(a[0] - b[2], b[0] - a[2], 0), max(a[1] - b[3], b[1] - a[3], 0)
        return (dx * dx + dy * dy) ** 0.5

    for threshold, cell in ((8.0, 16.0), (8.0, 64.0), (0.0, 10.0), (100.0, 30.0)):
        got = Counter((r.a, r.b) for r in joins.spatial_pairs(df, clustering.BUCKET, "path_id", threshold, cell=cell).collect())
        assert got == Counter((i, j) for i in range(120) for j in range(i + 1, 120) if gap(boxes[i], boxes[j]) <= threshold)


def test_parity_grid_misses_neighbours_of_huge_items(spark):
    df = start(make(spark, [(0, 0, 1000, 1000), (0, 0, 2, 2)]))
    assert sizes(clustering.cluster_spatial(df, 1.0)) == [2]
    assert sizes(clustering.cluster_spatial(df, 1.0, exact=False)) == [1, 1]
    small = start(make(spark, [(0, 0, 20, 20), (20.5, 0, 22, 2)]))
    assert sizes(clustering.cluster_spatial(small, 1.0, exact=False)) == [2]


def test_union_find_never_splits(spark):
    df = make(spark, [(0, 0, 1, 1), (100, 0, 101, 1), (102, 0, 103, 1), (160, 0, 161, 1)])
    held = start(df).withColumn("group_id", F.when(F.col("path_id") <= 1, 0).otherwise(F.col("path_id")))
    assert groups(clustering.cluster_spatial_union_find(held, 2.0)) == [[0, 1, 2], [3]]
    assert groups(clustering.cluster_spatial(held, 2.0)) == [[0], [1, 2], [3]]


def test_by_seq(spark):
    df = start(make(spark, [(0, 0, 1, 1)] * 3, seqs=[0, 1, 10])).withColumn("group_id", F.lit(0).cast("long"))
    assert groups(clustering.cluster_by_seq(df, 3)) == [[0, 1], [2]]


def test_by_dimension(spark):
    df = start(make(spark, [(0, 0, 1, 1), (50, 50, 51, 51), (0, 0, 20, 1)]))
    assert groups(clustering.cluster_by_dimension(df, 0.1)) == [[0, 1], [2]]
    assert groups(clustering.cluster_by_dimension(df, 1.0)) == [[0, 1, 2]]
    flat = start(make(spark, [(0, 0, 0, 0), (5, 5, 5, 5), (0, 0, 3, 0)]))
    assert groups(clustering.cluster_by_dimension(flat, 0.35)) == [[0, 1], [2]]


def test_dimension_bands_miss_nothing(spark):
    boxes = [(0, 0, (i * i) % 97 * 0.37, (i * 31) % 53 * 0.61) for i in range(90)]
    df = make(spark, boxes)
    for tol in (0.0, 0.1, 0.35, 0.9):

        def near(a, b, tol=tol):
            return all(abs(a[k] - b[k]) <= tol * max(a[k], b[k], 1e-6) for k in (2, 3))

        got = {(r.a, r.b) for r in joins.dimension_pairs(df, clustering.BUCKET, "path_id", tol).collect()}
        assert got == {(i, j) for i in range(90) for j in range(i + 1, 90) if near(boxes[i], boxes[j])}


def test_dimension_links_have_the_components_of_the_pairs(spark):
    boxes = [(0, 0, (i * i) % 97 * 0.37, (i * 31) % 53 * 0.61) for i in range(60)]
    boxes += [(0, 0, 0, 5), (0, 0, 0, 5), (0, 0, 2e-7, 5), (0, 0, 9e-7, 5), (0, 0, 1.2e-6, 5), (0, 0, 0, 0), (0, 0, 500, 500)]
    df = make(spark, boxes)
    for tol in (0.0, 0.35, 1.0):

        def roots(edges):
            label = list(range(len(boxes)))
            for _ in label:
                for r in edges:
                    label[r.a] = label[r.b] = min(label[r.a], label[r.b])
            return label

        links = joins.dimension_links(df, clustering.BUCKET, "path_id", tol).collect()
        assert all(r.a < r.b for r in links)
        assert roots(links) == roots(joins.dimension_pairs(df, clustering.BUCKET, "path_id", tol).collect())
    copies = make(spark, [(i, i, i + 3, i + 4) for i in range(200)])
    assert joins.dimension_links(copies, clustering.BUCKET, "path_id", 0.35).count() == 199


def test_overlap(spark):
    p = pages(spark)
    over = start(make(spark, [(0, 0, 10, 10), (5, 5, 15, 15), (100, 100, 110, 110)]))
    assert sizes(clustering.group_overlapping(over, p)) == [1, 2]
    inside = start(make(spark, [(0, 0, 100, 100), (10, 10, 20, 20)]))
    assert sizes(clustering.group_overlapping(inside, p, tolerance=100.0)) == [1, 1]
    line = start(make(spark, [(0, 0, 100, 100), (10, 10, 20, 10)]))
    assert sizes(clustering.group_overlapping(line, p)) == [2]
    near = start(make(spark, [(0, 0, 10, 10), (15, 0, 25, 10)]))
    assert sizes(clustering.group_overlapping(near, p)) == [1, 1]
    assert sizes(clustering.group_overlapping(near, pages(spark, 3000.0))) == [2]
    assert sizes(clustering.group_overlapping(near, p, scope="cluster", tolerance=5.0)) == [2]
    with pytest.raises(ValueError):
        clustering.group_overlapping(near, p, scope="page")


def test_pairwise_cap(spark):
    df = start(make(spark, [(i * 50, 0, i * 50 + i + 1, 1) for i in range(6)]))
    assert sizes(clustering.cluster_by_dimension(df, 0.01, cap=5)) == [6]
    assert sizes(clustering.cluster_by_dimension(df, 0.01, cap=6)) == [1] * 6
    assert sizes(clustering.cluster_by_item_bbox(df, 0.01, cap=5)) == [6]
    assert sizes(clustering.cluster_by_item_bbox(df, 0.01, cap=None)) == [1] * 6


def test_by_item_count_and_box(spark):
    df = start(make(spark, [(0, 0, 1, 1)] * 7, seqs=[0, 1, 2, 2, 2, 2, 2]))
    assert groups(clustering.cluster_by_item_path_count(df, 2)) == [[0, 1], [2, 3, 4, 5, 6]]
    boxes = [(0, 0, 10, 10), (90, 90, 100, 100), (0, 0, 5, 5), (5, 5, 10, 10)]
    assert groups(clustering.cluster_by_item_bbox(start(make(spark, boxes, seqs=[0, 1, 2, 2])), 0.1)) == [[0, 1, 2, 3]]


def test_panels(spark):
    df = start(make(spark, [(0, 0, 1, 1)] * 4, seqs=[0, 1, 1, 2], kinds=["re", "re", "l", "l"]))
    kept, dropped = clustering.filter_layout_panels(df)
    assert sorted(r.path_id for r in kept.collect()) == [1, 2, 3]
    assert [(r.path_id, r.group_id) for r in dropped.collect()] == [(0, 0)]


def test_large_and_aspect(spark):
    df = start(make(spark, [(0, 0, 190, 190), (0, 0, 10, 10), (0, 0, 100, 80), (0, 0, 100, 2)]))
    kept, _ = clustering.filter_large_bbox(df, pages(spark))
    assert sorted(r.path_id for r in kept.collect()) == [1, 2, 3]  # a fifth of the page is kept
    assert clustering.filter_large_bbox(df, pages(spark, 0.0))[0].count() == 4
    kept, dropped = clustering.filter_aspect_ratio(df)
    assert [r.path_id for r in dropped.collect()] == [3]
    one = df.withColumn("group_id", F.lit(0).cast("long"))
    assert clustering.filter_large_group_bbox(one, pages(spark))[0].count() == 0


def test_path_filters_reduce_groups(spark):
    df = start(make(spark, [(0, 0, 190, 190), (0, 0, 10, 10), (0, 0, 9, 9)])).withColumn("group_id", F.lit(0).cast("long"))
    kept, dropped = clustering.filter_large_bbox(df, pages(spark))
    assert groups(kept) == [[1, 2]] and {r.group_id for r in kept.collect()} == {1}
    assert [(r.path_id, r.group_id) for r in dropped.collect()] == [(0, 0)]


def test_chain_order_matters(spark):
    df, p = make(spark, [(0, 0, 1, 1), (2, 0, 3, 1), (40, 0, 41, 1)], seqs=[0, 20, 21]), pages(spark)
    assert sizes(chain.run_chain(df, p, ["cluster_spatial"])[-1][1]) == [1, 2]
    assert sizes(chain.run_chain(df, p, ["cluster_spatial", "cluster_by_seq"])[-1][1]) == [1, 1, 1]
    again = chain.run_chain(df, p, ["cluster_spatial", "cluster_by_seq", "cluster_spatial_union_find"])
    assert sizes(again[-1][1]) == [1, 2]
    assert sizes(chain.run_chain(df, p, ["none"] * 9)[-1][1]) == [1, 1, 1]


def test_chain_parameters_and_errors(spark):
    df, p = make(spark, [(0, 0, 1, 1), (20, 0, 21, 1)]), pages(spark)
    assert sizes(chain.run_chain(df, p, ["cluster_spatial"], {"cluster_spatial": {"threshold": 30.0, "nonsense": 3}})[-1][1]) == [2]
    with pytest.raises(ValueError):
        chain.run_chain(df, p, ["cluster_magic"])


def test_default_chain_and_drawings(spark):
    boxes = [(0, 0, 200, 200), (10, 10, 13, 16), (15, 10, 18, 16), (20, 10, 23, 16), (100, 100, 150, 150)]
    df, p = make(spark, boxes, seqs=[0, 1, 1, 2, 3], kinds=["re", "re", "re", "l", "l"]), pages(spark)
    steps = chain.run_chain(df, p)
    assert [s for s, _, _ in steps] == list(chain.DEFAULT_ORDER)
    assert [r.path_id for r in steps[0][2].collect()] == [0]
    assert groups(chain.classify(steps)) == [[1, 2, 3], [4]]
    drawn = aggregates.build_drawings(chain.all_dropped(steps)).collect()
    assert [(r.seq, r.x1, r.members) for r in drawn] == [(0, 200.0, [0])]
    counts = {(r.step_index, r.status): (r.n_groups, r.n_paths) for r in aggregates.step_counts(chain.step_log(steps), clustering.BUCKET).collect()}
    assert counts[0, "dropped"] == (1, 1) and counts[2, "kept"] == (2, 4) and counts[7, "kept"] == (2, 4)


def test_everything_filtered_ends_with_no_rows(spark):
    df = make(spark, [(0, 0, 200, 200)], kinds=["re"])
    assert chain.classify(chain.run_chain(df, pages(spark))).count() == 0


def test_statistics(spark):
    df = make(spark, [(0, 0, 1, 1)] * 7).withColumn("group_id", F.expr("case when path_id < 4 then 0 when path_id < 6 then 4 else 6 end"))
    assert tuple(aggregates.size_stats(df, clustering.BUCKET).first()) == (3, 1, 2.0, 7 / 3, 4)
    assert tuple(aggregates.size_stats(df.limit(0), clustering.BUCKET).first()) == (0, 0, 0.0, 0.0, 0)
    got = aggregates.build_drawings(make(spark, [(0, 0, 1, 1), (5, 5, 9, 8)], seqs=[4, 4])).first()
    assert (got.x0, got.y0, got.x1, got.y1, got.n_paths, got.members, got.dashed) == (0, 0, 9, 8, 2, [0, 1], False)
