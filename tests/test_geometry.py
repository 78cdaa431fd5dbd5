import math
import random

import pytest
from pyspark.sql import functions as F

from pagelattice.functions import geometry as G


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


def value(one, column):
    return one.select(column.alias("v")).first().v


def box(*b):
    return {k: F.lit(float(v)) for k, v in zip(("x0", "y0", "x1", "y1"), b)}


def test_rect_gap(spark):
    """Against the least distance of points on a grid of the two boxes' whole-numbered places."""
    rng = random.Random(6)
    rows = []
    for _ in range(60):
        x, y, u, v = (rng.randrange(12) for _ in range(4))
        rows.append((x, y, x + rng.randrange(6), y + rng.randrange(6), u, v, u + rng.randrange(6), v + rng.randrange(6)))
    names = [f"{side}{c}" for side in "ab" for c in ("x0", "y0", "x1", "y1")]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], " double, ".join(names) + " double")
    places = lambda r: [(x, y) for x in range(r[0], r[2] + 1) for y in range(r[1], r[3] + 1)]
    want = [min(math.dist(p, q) for p in places(r[:4]) for q in places(r[4:])) for r in rows]
    got = [r.gap for r in df.select(G.rect_gap(G.box("a"), G.box("b")).alias("gap")).collect()]
    assert got == pytest.approx(want)


def test_angles_and_lengths(one):
    assert value(one, G.point_angle(0, 0, 0, 5)) == 90
    assert value(one, G.point_angle(1, 1, 1, 1)) == 0
    assert value(one, G.point_angle(0, 0, -1, 0)) == 180
    assert value(one, G.line_length(0, 0, 3, 4)) == 5


def test_round_color(one):
    assert value(one, G.round_color(F.array(F.lit(0.12345), F.lit(1.0)))) == [0.123, 1.0]
    assert value(one, G.round_color(F.array().cast("array<double>"))) is None
    assert value(one, G.round_color(F.lit(None).cast("array<double>"))) is None


def test_rect_metadata(one):
    got = one.select(*[v.alias(k) for k, v in G.rect_metadata(1, 2, 4, 8).items()]).first()
    assert tuple(got) == (1, 2, 3, 6, 18, 0.5)
    assert one.select(G.rect_metadata(0, 0, 5, 0)["aspect_ratio"].alias("r")).first().r is None


def test_matrix(one):
    assert value(one, G.matrix_rotation(0, 1)) == 90
    sx, sy = G.matrix_scale(3, 4, 0, 2)
    assert (value(one, sx), value(one, sy)) == (5, 2)
    new = G.transform_box(box(0, 0, 2, 1), [0, 1, -1, 0, 5, 5])
    assert [value(one, new[c]) for c in ("x0", "y0", "x1", "y1")] == [4, 5, 5, 7]
    assert G.inverse_matrix([2, 0, 0, 4, 6, 8]) == [0.5, 0, 0, 0.25, -3, -2]
    with pytest.raises(ValueError):
        G.inverse_matrix([1, 1, 1, 1, 0, 0])


@pytest.mark.parametrize(("dashes", "dashed"), [(None, False), ("", False), ("[] 0", False), (" [] 0", False), ("[3 2] 0", True)])
def test_is_dashed(one, dashes, dashed):
    assert value(one, G.is_dashed(F.lit(dashes).cast("string"))) is dashed


def test_colors(one):
    def rgb(*c):
        return F.array(*[F.lit(float(x)) for x in c])

    assert value(one, G.rgb_to_hex(rgb(1, 0.5, -3))) == "#ff8000"
    assert value(one, G.rgb_to_hex(F.array().cast("array<double>"))) == "#000000"
    empty = F.lit(None).cast("array<double>")
    assert value(one, G.path_color_hex(empty, empty)) == "#111827"
    assert value(one, G.path_color_hex(empty, rgb(0, 0, 1))) == "#0000ff"
    assert value(one, G.path_color_hex(rgb(2, 0, 0), rgb(0, 0, 1))) == "#ff0000"
    assert [value(one, c) for c in G.text_color(F.lit(0xFF8000))] == [1.0, 128 / 255, 0.0]
    assert [value(one, c) for c in G.text_color(F.lit(None).cast("int"))] == [0, 0, 0]


@pytest.mark.parametrize(("angle", "turn"), [(0, 0), (44, 0), (46, 90), (-90, 270), (180, 180), (359, 0), (45, 0), (135, 180)])
def test_nearest_quarter(one, angle, turn):
    assert value(one, G.nearest_quarter(F.lit(float(angle)))) == turn


def test_oriented_quad(one):
    got = value(one, G.oriented_quad(*[F.lit(float(v)) for v in (0, 0, 10, 4)], F.lit(1.0), F.lit(0.0)))
    assert [(p.x, p.y) for p in got] == [(0, 0), (10, 0), (10, 4), (0, 4)]
    up = value(one, G.oriented_quad(*[F.lit(float(v)) for v in (0, 0, 4, 10)], F.lit(0.0), F.lit(-2.0)))
    assert [(p.x, p.y) for p in up] == [(0, 10), (0, 0), (4, 0), (4, 10)]
    flat = value(one, G.oriented_quad(*[F.lit(float(v)) for v in (0, 0, 10, 4)], F.lit(0.0), F.lit(0.0)))
    assert [(p.x, p.y) for p in flat] == [(0, 0), (10, 0), (10, 4), (0, 4)]


def test_path_length(one):
    def points(*p):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p])

    assert value(one, G.path_length(points((0, 0), (3, 4), (3, 10)))) == 11
    assert value(one, G.path_length(points((1, 1)))) == 0


def test_text_and_numbers(one):
    assert value(one, G.normalize_text(F.lit("  A \t b\n"))) == "a b"
    assert value(one, G.parse_number(F.lit(" 2.5 "))) == 2.5
    assert value(one, G.parse_number(F.lit("x"))) is None
    assert value(one, G.zoom_step(F.lit(1.0), F.lit(1))) == 1.25
    assert value(one, G.zoom_step(F.lit(1.0), F.lit(-50))) == 0.25
    assert value(one, G.zoom_step(F.lit(1.0), F.lit(50))) == 6
    assert value(one, G.overlap_tolerance(200, 200)) == 3
    assert value(one, G.overlap_tolerance(3000, 3000)) == 15


def test_contained(one):
    assert value(one, G.contained(box(0, 0, 10, 10), box(2, 2, 4, 4))) is True
    assert value(one, G.contained(box(0, 0, 10, 10), box(5, 5, 15, 15))) is False
    assert value(one, G.contained(box(0, 0, 10, 10), box(2, 2, 8, 2))) is False  # a flat line inside


@pytest.mark.parametrize("rotation", [0, 90, 180, 270])
def test_display_matrix(one, rotation):
    m = [value(one, c) for c in G.display_matrix(F.lit(rotation), F.lit(200.0), F.lit(100.0), 2.0)]
    new = G.transform_box(box(0, 0, 200, 100), m)
    size = (400, 200) if rotation % 180 == 0 else (200, 400)
    assert [value(one, new[c]) for c in ("x0", "y0", "x1", "y1")] == [0, 0, *size]
    assert math.isclose(abs(m[0] * m[3] - m[1] * m[2]), 4)


def test_case_folding(spark):
    """As Python folds, for the letters of the scripts that have cases, in every place of a word."""
    letters = [chr(c) for c in [*range(0x20, 0x250), *range(0x370, 0x530), *range(0x531, 0x588), *range(0x1E00, 0x1F00), *range(0xFB00, 0xFB07)]]
    rows = [(t,) for x in letters for t in (x, f"a{x}", f"a{x}b", f"A{x} B")]
    df = spark.createDataFrame(rows, "t string")
    got = {r.t: r.f for r in df.select("t", G.fold_case(F.col("t")).alias("f")).collect()}
    assert {t: (f, t.casefold()) for t, f in got.items() if f != t.casefold()} == {}
