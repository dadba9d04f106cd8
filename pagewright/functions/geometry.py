"""Plane geometry of pages as column expressions: matrices, boxes and turns.

A matrix is an array of six doubles, a box one of four (x0, y0, x1, y1), a point one of two.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagewright.functions.scalars import js_round

# Default ascent and descent of a line's own box and of the probe boxes, in sizes; least width of a box, in sizes; page of no size.
ASCENT, DESCENT, PROBE_TOP, PROBE_BOTTOM, LEAST_WIDTH = 0.78, -0.22, 0.8, -0.25, 0.3
A4 = (595.28, 841.89)


def at(array: Column, i: int) -> Column:
    return F.get(array, F.lit(i))


def product(m: Column, n: Column) -> Column:
    """The matrix that first does m, then n."""
    rows = [(0, 1), (2, 3), (4, 5)]
    cells = [at(m, a) * at(n, c) + at(m, b) * at(n, 2 + c) for a, b in rows for c in (0, 1)]
    return F.array(*cells[:4], cells[4] + at(n, 4), cells[5] + at(n, 5))


def inverse(m: Column) -> Column:
    """The matrix that undoes m; null if none does."""
    a, b, c, d, e, f = (at(m, i) for i in range(6))
    det = a * d - b * c
    by = F.nullif(det, F.lit(0.0))
    return F.when(det != 0, F.array(d / by, -b / by, -c / by, a / by, (c * f - d * e) / by, (b * e - a * f) / by))


def moved_point(m: Column, x: Column, y: Column) -> Column:
    return F.array(at(m, 0) * x + at(m, 2) * y + at(m, 4), at(m, 1) * x + at(m, 3) * y + at(m, 5))


def user_delta(m: Column, dx: Column, dy: Column) -> Column:
    """A step on the page in the space of matrix m; null if m can't be undone."""
    i = inverse(m)
    return F.when(i.isNotNull(), F.array(at(i, 0) * dx + at(i, 2) * dy, at(i, 1) * dx + at(i, 3) * dy))


def box_of(points: Column) -> Column:
    """The box around an array of points."""
    xs, ys = F.transform(points, lambda p: at(p, 0)), F.transform(points, lambda p: at(p, 1))
    return F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def common_box(a: Column, b: Column) -> Column:
    """What two boxes share; a null box is the whole plane. A box whose ends have changed places is empty."""
    both = F.array(F.greatest(at(a, 0), at(b, 0)), F.greatest(at(a, 1), at(b, 1)), F.least(at(a, 2), at(b, 2)), F.least(at(a, 3), at(b, 3)))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def same_box(a: Column, b: Column) -> Column:
    near = [F.abs(at(a, i) - at(b, i)) < 0.5 for i in range(4)]
    return F.coalesce(near[0] & near[1] & near[2] & near[3], F.lit(False))


def ordered_box(r: Column) -> Column:
    """A rectangle given by any two corners."""
    return F.array(F.least(at(r, 0), at(r, 2)), F.least(at(r, 1), at(r, 3)), F.greatest(at(r, 0), at(r, 2)), F.greatest(at(r, 1), at(r, 3)))


def line_box(x: Column, y: Column, width: Column, size: Column, asc: Column | None = None, desc: Column | None = None) -> Column:
    """The box of a line by its own ascent and descent, in sizes."""
    up = F.lit(ASCENT) if asc is None else F.coalesce(asc, F.lit(ASCENT))
    down = F.lit(DESCENT) if desc is None else F.coalesce(desc, F.lit(DESCENT))
    return F.array(x, y + down * size, x + F.greatest(width, LEAST_WIDTH * size), y + up * size)


def probe_box(x: Column, y: Column, width: Column, size: Column) -> Column:
    """The box by which a line counts as inside a moved region."""
    return F.array(x, y + PROBE_BOTTOM * size, x + F.greatest(width, LEAST_WIDTH * size), y + PROBE_TOP * size)


def show_box(m: Column, x: Column, y: Column, end: Column, font_size: Column) -> Column:
    """The same of a painted run: its size is the matrix's height, else the font's, else 10."""
    size = F.coalesce(F.nullif(F.abs(at(m, 3)), F.lit(0.0)), F.nullif(font_size, F.lit(0.0)), F.lit(10.0))
    return F.array(F.least(x, end), y + PROBE_BOTTOM * size, F.greatest(x, end), y + PROBE_TOP * size)


def is_turned(m: Column) -> Column:
    """Whether a run with this matrix isn't upright."""
    or_one = lambda v: F.when(v == 0, 1.0).otherwise(v)
    return (F.abs(at(m, 1)) > 0.02 * F.abs(or_one(at(m, 0)))) | (F.abs(at(m, 2)) > 0.02 * F.abs(or_one(at(m, 3)))) | (at(m, 0) <= 0) | (at(m, 3) <= 0)


def total_rotation(base: Column, rot: Column) -> Column:
    return F.pmod(F.coalesce(base, F.lit(0)) + F.coalesce(rot, F.lit(0)), F.lit(360))


def display_size(w: Column, h: Column, rotation: Column) -> Column:
    sideways = rotation.isin(90, 270)
    return F.array(F.when(sideways, h).otherwise(w), F.when(sideways, w).otherwise(h))


def display_delta(rotation: Column, dx: Column, dy: Column) -> Column:
    """A step on the displayed page, y down, as one on the page, y up."""
    return F.when(rotation == 0, F.array(dx, -dy)).when(rotation == 90, F.array(dy, dx)).when(rotation == 180, F.array(-dx, dy)).otherwise(F.array(-dy, -dx))


def display_matrix(rotation: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The matrix from the displayed page, y up, to the page's own space."""
    zero, one = F.lit(0.0), F.lit(1.0)
    out = F.when(rotation == 90, F.array(zero, one, -one, zero, w + x, y)).when(rotation == 180, F.array(-one, zero, zero, -one, w + x, h + y))
    return out.when(rotation == 270, F.array(zero, -one, one, zero, x, h + y)).otherwise(F.array(one, zero, zero, one, x, y))


def turned_right(x: Column, y: Column, height: Column) -> Column:
    """A point after a quarter turn to the right of a displayed page of this height."""
    return F.array(height - y, x)


def turned_left(x: Column, y: Column, width: Column) -> Column:
    return F.array(y, width - x)


def annotation_box(kind: Column, points: Column, x: Column, y: Column, w: Column, h: Column, stroke: Column) -> Column:
    """(x, y, w, h) of an annotation: strokes (points; a line has two) by their points and half the pen, others by their own box."""
    drawn = box_of(points)
    pad = stroke / 2
    around = F.array(at(drawn, 0) - pad, at(drawn, 1) - pad, at(drawn, 2) - at(drawn, 0) + 2 * pad, at(drawn, 3) - at(drawn, 1) + 2 * pad)
    return F.when(kind.isin("pen", "highlight", "line", "arrow"), around).otherwise(F.array(x, y, w, h))


def annotation_on_page(box: Column, left: Column, top: Column) -> Column:
    """An annotation's (x, y, w, h), y down, as a box of the page, y up, whose view starts at `left` and ends at `top`."""
    return F.array(left + at(box, 0), top - (at(box, 1) + at(box, 3)), left + at(box, 0) + at(box, 2), top - at(box, 1))


def turned_annotation(kind: Column, points: Column, x: Column, y: Column, w: Column, h: Column, height: Column) -> Column:
    """(points, x, y, w, h) after a quarter turn to the right of a displayed page of this height: strokes and shapes turn, texts and images move with their middle."""
    turned = F.transform(points, lambda p: turned_right(at(p, 0), at(p, 1), height))
    shape = kind.isin("rect", "ellipse", "whiteout")
    stroke = kind.isin("pen", "highlight", "line", "arrow")
    middle = turned_right(x + w / 2, y + h / 2, height)
    to_x = F.when(stroke, x).when(shape, height - (y + h)).otherwise(at(middle, 0) - w / 2)
    to_y = F.when(stroke, y).when(shape, x).otherwise(at(middle, 1) - h / 2)
    return F.struct(F.when(stroke, turned).otherwise(points).alias("points"), to_x.alias("x"), to_y.alias("y"), F.when(shape, h).otherwise(w).alias("w"), F.when(shape, w).otherwise(h).alias("h"))


def path_poke(painted: Column, box: Column) -> Column:
    """How far above a region's top a path may start and still move with it."""
    return F.when(painted, F.least(0.5 * (at(box, 3) - at(box, 1)), F.lit(6.0))).otherwise(F.lit(0.1))


def grown(box: Column, shifts: Column) -> Column:
    """How far down a clip grows: the downward steps of the shifts (grow: boxes, dy) that name it."""
    return F.aggregate(shifts, F.lit(0.0), lambda g, s: g + F.when(F.exists(s["grow"], lambda c: same_box(c, box)), F.least(F.lit(0.0), s["dy"])).otherwise(0.0))


def number_text(v: Column) -> Column:
    """A number as content streams hold it: four places, no closing zeros, no minus zero."""
    r = js_round(v * 10_000)
    sign, whole, part = F.when(r < 0, "-").otherwise(""), F.floor(F.abs(r) / 10_000), F.abs(r) % 10_000
    places = F.regexp_replace(F.lpad(part.cast("string"), 4, "0"), "0+$", "")
    return F.concat(sign, whole.cast("string"), F.when(part == 0, "").otherwise(F.concat(F.lit("."), places)))
