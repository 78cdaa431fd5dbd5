"""Scalar geometry as column expressions; nothing here leaves whole-stage code generation.

Rounding is half-even on decimal digits (``bround``). Boxes are four double columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9
DEFAULT_COLOR = "#111827"


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def round_color(color: Column) -> Column:
    """Components to three places; null and empty colours are null."""
    return F.when(F.size(color) > 0, F.transform(color, lambda c: F.bround(c, 3)))


def point_angle(x0, y0, x1, y1) -> Column:
    """Degrees of the direction between two points, 0 where they coincide."""
    dx, dy = num(x1) - num(x0), num(y1) - num(y0)
    return F.when((F.abs(dx) < EPS) & (F.abs(dy) < EPS), F.lit(0.0)).otherwise(F.degrees(F.atan2(dy, dx)))


def line_length(x0, y0, x1, y1) -> Column:
    return F.sqrt(F.pow(num(x1) - num(x0), F.lit(2.0)) + F.pow(num(y1) - num(y0), F.lit(2.0)))


def quad_angle(quad: Column) -> Column:
    """Angle of the top edge of a quad given as ``[ul, ur, lr, ll]``."""
    return point_angle(quad[0]["x"], quad[0]["y"], quad[1]["x"], quad[1]["y"])


def quad_metadata(quad: Column) -> dict[str, Column]:
    """Angle, width (ul-ur) and height (ul-ll), three places."""
    return {
        "angle": F.bround(quad_angle(quad), 3),
        "width": F.bround(line_length(quad[0]["x"], quad[0]["y"], quad[1]["x"], quad[1]["y"]), 3),
        "height": F.bround(line_length(quad[0]["x"], quad[0]["y"], quad[3]["x"], quad[3]["y"]), 3),
    }


def places(value: Column, n: int) -> Column:
    """Half-even rounding to ``n`` places; whole numbers are known without decimal arithmetic."""
    return F.when(value == F.rint(value), value + F.lit(0.0)).otherwise(F.bround(value, n))


def rect_metadata(x0, y0, x1, y1) -> dict[str, Column]:
    """Position, extent and area to three places, aspect ratio to four (null for a flat box)."""
    w, h = num(x1) - num(x0), num(y1) - num(y0)
    return {
        "x": places(num(x0), 3),
        "y": places(num(y0), 3),
        "width": places(w, 3),
        "height": places(h, 3),
        "area": places(w * h, 3),
        "aspect_ratio": F.when(F.abs(h) > EPS, places(w / h, 4)),
    }


def format_matrix(matrix: Column) -> Column:
    return F.transform(matrix, lambda c: F.bround(c, 5))


def matrix_rotation(a, b) -> Column:
    return F.degrees(F.atan2(num(b), num(a)))


def matrix_scale(a, b, c, d) -> tuple[Column, Column]:
    zero = F.lit(0.0)
    return line_length(zero, zero, num(a), num(b)), line_length(zero, zero, num(c), num(d))


def gap_squared(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Squared distance of two boxes, 0 where they touch; exact on whole and half numbers."""
    zero = F.lit(0.0)
    dx = F.greatest(a["x0"] - b["x1"], b["x0"] - a["x1"], zero)
    dy = F.greatest(a["y0"] - b["y1"], b["y0"] - a["y1"], zero)
    return dx * dx + dy * dy


def rect_gap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return F.sqrt(gap_squared(a, b))


def box(prefix: str = "") -> dict[str, Column]:
    """The box columns of one side of a join."""
    return {c: F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1")}


def intersection_area(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))


def area(b: dict[str, Column]) -> Column:
    """Area with negative extents as zero."""
    zero = F.lit(0.0)
    return F.greatest(b["x1"] - b["x0"], zero) * F.greatest(b["y1"] - b["y0"], zero)


def contained(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """One box lies in the other: both have area, and so does their intersection."""
    shared, aa, ab = intersection_area(a, b), area(a), area(b)
    return (shared > 0) & (aa > 0) & (ab > 0) & ((shared >= aa - EPS) | (shared >= ab - EPS))


def oriented_quad(x0, y0, x1, y1, dx, dy) -> Column:
    """``[ul, ur, lr, ll]`` of the box's extents along a direction and its normal; a zero direction is (1, 0)."""
    n = line_length(F.lit(0.0), F.lit(0.0), dx, dy)
    flat = n < EPS
    ux, uy = F.when(flat, F.lit(1.0)).otherwise(num(dx) / n), F.when(flat, F.lit(0.0)).otherwise(num(dy) / n)
    corners = [(x0, y0), (x1, y0), (x0, y1), (x1, y1)]
    along = [num(x) * ux + num(y) * uy for x, y in corners]
    across = [num(y) * ux - num(x) * uy for x, y in corners]
    a0, a1, c0, c1 = F.least(*along), F.greatest(*along), F.least(*across), F.greatest(*across)

    def corner(a, c):
        return F.struct((a * ux - c * uy).alias("x"), (a * uy + c * ux).alias("y"))

    return F.array(corner(a0, c0), corner(a1, c0), corner(a1, c1), corner(a0, c1))


def path_length(points: Column) -> Column:
    """Length of the polyline through an array of points, 0 for fewer than two."""
    steps = F.transform(
        F.sequence(F.lit(1), F.size(points) - 1),
        lambda i: line_length(F.get(points, i - 1)["x"], F.get(points, i - 1)["y"], F.get(points, i)["x"], F.get(points, i)["y"]),
    )
    return F.when(F.size(points) >= 2, F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x)).otherwise(F.lit(0.0))


def is_dashed(dashes: Column) -> Column:
    text = F.coalesce(dashes, F.lit(""))
    return (text != "") & ~F.trim(text).startswith("[]")


def _hex2(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value.cast("int")), 2, "0"))


def rgb_to_hex(color: Column) -> Column:
    """``#rrggbb``; components are clamped, then rounded half-even; an empty colour is black."""
    parts = [_hex2(F.bround(F.least(F.greatest(F.get(color, F.lit(i)), F.lit(0.0)), F.lit(1.0)) * 255, 0)) for i in range(3)]
    return F.when(F.size(color) >= 3, F.concat(F.lit("#"), *parts)).otherwise(F.lit("#000000"))


def path_color_hex(stroke: Column, fill: Column) -> Column:
    """Stroke, else fill, else the default colour; rounded, then clamped."""
    color = F.coalesce(F.when(F.size(stroke) > 0, stroke), F.when(F.size(fill) > 0, fill))
    parts = [_hex2(F.least(F.greatest(F.bround(F.get(color, F.lit(i)) * 255, 0), F.lit(0.0)), F.lit(255.0))) for i in range(3)]
    return F.when(color.isNotNull(), F.concat(F.lit("#"), *parts)).otherwise(F.lit(DEFAULT_COLOR))


def text_color(packed: Column) -> list[Column]:
    """Red, green and blue in 0..1 of a packed integer; null is black."""
    value = F.coalesce(packed, F.lit(0)).cast("int")
    return [F.shiftright(value, s).bitwiseAND(255) / F.lit(255.0) for s in (16, 8, 0)]


def nearest_quarter(angle: Column) -> Column:
    return (F.pmod(F.bround(angle / 90.0, 0).cast("int"), F.lit(4)) * 90).cast("int")


def normalize_text(text: Column) -> Column:
    """White space runs to one space, trimmed, letters folded so that cases of any script compare equal."""
    return fold_case(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def fold_case(text: Column) -> Column:
    """Full case folding: upper case brings together what lower case alone leaves apart (ss, long s, final sigma).

    Dotless i has no other case and is kept out of the way meanwhile; the capital sharp s
    becomes the small one first.
    """
    upper = F.translate(F.upper(F.translate(text, "\u0131\u1e9e", "\ue000\u00df")), "\ue000", "\u0131")
    return F.translate(F.lower(upper), "\u03c2", "\u03c3")


def overlap_tolerance(width, height) -> Column:
    return F.greatest(F.lit(0.005) * F.least(num(width), num(height)), F.lit(3.0))


def aspect_ratio(x0, y0, x1, y1) -> Column:
    w, h = F.greatest(num(x1) - num(x0), F.lit(1e-6)), F.greatest(num(y1) - num(y0), F.lit(1e-6))
    return F.greatest(w, h) / F.least(w, h)


def effective_dpi(pixels: Column, points: Column) -> Column:
    return F.when(points > 0, F.bround(pixels / points * 72, 2))


def apply_matrix(x, y, m: list) -> tuple[Column, Column]:
    a, b, c, d, e, f = (num(v) for v in m)
    return a * num(x) + c * num(y) + e, b * num(x) + d * num(y) + f


def transform_box(b: dict[str, Column], m: list) -> dict[str, Column]:
    """The box around a box's four transformed corners."""
    points = [apply_matrix(b[x], b[y], m) for x in ("x0", "x1") for y in ("y0", "y1")]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def display_matrix(rotation: Column, width: Column, height: Column, zoom: float) -> list[Column]:
    """Page space to zoomed, rotated display space for rotations 0, 90, 180 and 270."""
    z, o = F.lit(float(zoom)), F.lit(0.0)

    def pick(*at):
        out = at[0]
        for k, v in zip((90, 180, 270), at[1:]):
            out = F.when(rotation == k, v).otherwise(out)
        return out

    w, h = num(width) * z, num(height) * z
    return [pick(z, o, -z, o), pick(o, z, o, -z), pick(o, -z, o, z), pick(z, o, -z, o), pick(o, h, w, o), pick(o, o, h, w)]


def inverse_matrix(m: list[float]) -> list[float]:
    """Inverse of a literal affine matrix."""
    a, b, c, d, e, f = m
    det = a * d - b * c
    if abs(det) < 1e-12:
        raise ValueError("the matrix has no inverse")
    return [d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det]


def corners(b: dict[str, Column]) -> Column:
    """The box's corners as points, clockwise from the upper left."""
    return F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])


def geometry_points(quad: Column, points: Column, b: dict[str, Column]) -> Column:
    """Quad, else points, else the box's corners."""
    return F.coalesce(F.when(F.size(quad) > 0, quad), F.when(F.size(points) > 0, points), corners(b))


def parse_number(text: Column, kind: str = "double") -> Column:
    """A parameter's text as a number, null where it is none."""
    return F.trim(text).try_cast(kind)


def zoom_step(zoom: Column, steps: Column) -> Column:
    """A zoom after steps of a factor 1.25, kept in 0.25..6."""
    return F.least(F.greatest(zoom * F.pow(F.lit(1.25), steps), F.lit(0.25)), F.lit(6.0))
