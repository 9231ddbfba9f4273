"""Boxes, polygons and affine transforms as column expressions.

A box is an array [x0, y0, x1, y1], a polygon an array of [x, y], a transform [a, b, c, d, e, f] that takes (x, y) to
(a x + c y + e, b x + d y + f).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transforms with a smaller determinant have no inverse; areas below the second are none.
SINGULAR, NO_AREA = 1e-12, 1e-12


def x0(b: Column) -> Column:
    return F.get(b, F.lit(0))


def y0(b: Column) -> Column:
    return F.get(b, F.lit(1))


def x1(b: Column) -> Column:
    return F.get(b, F.lit(2))


def y1(b: Column) -> Column:
    return F.get(b, F.lit(3))


def box(*sides: Column) -> Column:
    return F.array(*[s.cast("double") for s in sides])


def vertical_overlap(a: Column, b: Column) -> Column:
    """Share of the lower box's height that both cover; 0 where they only touch."""
    shared = F.least(y1(a), y1(b)) - F.greatest(y0(a), y0(b))
    lower = F.least(y1(a) - y0(a), y1(b) - y0(b))
    return F.when((shared <= 0) | (lower <= 0), 0.0).otherwise(shared / lower)


def horizontal_gap(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), x0(a) - x1(b), x0(b) - x1(a))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether closed boxes share a point."""
    return (x0(a) <= x1(b)) & (x0(b) <= x1(a)) & (y0(a) <= y1(b)) & (y0(b) <= y1(a))


def boxes_overlap(a: Column, b: Column) -> Column:
    """Whether boxes share an area."""
    return (x0(a) < x1(b)) & (x0(b) < x1(a)) & (y0(a) < y1(b)) & (y0(b) < y1(a))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), x1(b) - x0(b)) * F.greatest(F.lit(0.0), y1(b) - y0(b))


def shared_area(a: Column, b: Column) -> Column:
    w = F.least(x1(a), x1(b)) - F.greatest(x0(a), x0(b))
    h = F.least(y1(a), y1(b)) - F.greatest(y0(a), y0(b))
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def union_box(a: Column, b: Column) -> Column:
    return box(F.least(x0(a), x0(b)), F.least(y0(a), y0(b)), F.greatest(x1(a), x1(b)), F.greatest(y1(a), y1(b)))


def box_within(a: Column, b: Column) -> Column:
    return (x0(a) >= x0(b)) & (y0(a) >= y0(b)) & (x1(a) <= x1(b)) & (y1(a) <= y1(b))


def expanded(b: Column, dx: Column, dy: Column) -> Column:
    return box(x0(b) - dx, y0(b) - dy, x1(b) + dx, y1(b) + dy)


def geometry_distance(a: Column, b: Column, gap: Column, within: Column) -> Column:
    """1 - overlap / union of the boxes made wider by half the gap and higher by a quarter of the lower height; the
    centres' distance over the diagonal of `within` where these do not overlap."""
    dy = 0.25 * F.least(y1(a) - y0(a), y1(b) - y0(b))
    ea, eb = expanded(a, gap / 2, dy), expanded(b, gap / 2, dy)
    shared = shared_area(ea, eb)
    union = area(ea) + area(eb) - shared
    apart = F.hypot((x0(a) + x1(a)) / 2 - (x0(b) + x1(b)) / 2, (y0(a) + y1(a)) / 2 - (y0(b) + y1(b)) / 2)
    diagonal = F.hypot(x1(within) - x0(within), y1(within) - y0(within))
    clamp = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return (
        F.when((shared > 0) & (union > 0), clamp(1 - F.try_divide(shared, union)))
        .when(diagonal <= 0, 1.0)
        .otherwise(clamp(F.try_divide(apart, diagonal)))
    )


def pair_cost(geometry: Column, order: Column, text: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.65 * geometry + 0.2 * order + 0.15 * text))


# polygons


def box_polygon(b: Column) -> Column:
    return F.array(F.array(x0(b), y0(b)), F.array(x1(b), y0(b)), F.array(x1(b), y1(b)), F.array(x0(b), y1(b)))


def polygon_box(p: Column) -> Column:
    xs, ys = F.transform(p, lambda v: F.get(v, F.lit(0))), F.transform(p, lambda v: F.get(v, F.lit(1)))
    return box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def signed_area(p: Column) -> Column:
    """Half the sum of cross products around the polygon."""
    n = F.size(p)
    each = F.transform(
        p,
        lambda v, i: F.get(v, F.lit(0)) * F.get(F.get(p, (i + 1) % n), F.lit(1)) - F.get(F.get(p, (i + 1) % n), F.lit(0)) * F.get(v, F.lit(1)),
    )
    return F.aggregate(each, F.lit(0.0), lambda s, v: s + v) / 2


def map_polygon(m: Column, p: Column) -> Column:
    return F.transform(p, lambda v: apply(m, v))


def max_vertex_distance(a: Column, b: Column) -> Column:
    """Greatest distance of vertices in like places; null for polygons of different length or none."""
    each = F.zip_with(a, b, lambda v, w: F.hypot(F.get(v, F.lit(0)) - F.get(w, F.lit(0)), F.get(v, F.lit(1)) - F.get(w, F.lit(1))))
    return F.when(F.size(a) == F.size(b), F.array_max(each))


def _clipped(p: Column, axis: int, bound: Column, below: bool) -> Column:
    """One side of the clip: the polygon's part where the coordinate is at most (or at least) the bound."""
    n, other = F.size(p), 1 - axis
    at = lambda v: F.get(v, F.lit(axis))
    inside = (lambda v: at(v) <= bound) if below else (lambda v: at(v) >= bound)

    def edge(v: Column, i: Column) -> Column:
        before = F.get(p, (i + n - 1) % n)
        t = F.try_divide(bound - at(before), at(v) - at(before))
        along = F.get(before, F.lit(other)) + t * (F.get(v, F.lit(other)) - F.get(before, F.lit(other)))
        cross = F.array(bound, along) if axis == 0 else F.array(along, bound)
        return (
            F.when(inside(v) & inside(before), F.array(v))
            .when(inside(v), F.array(cross, v))
            .when(inside(before), F.array(cross))
            .otherwise(F.array().cast("array<array<double>>"))
        )

    return F.when(n > 0, F.flatten(F.transform(p, edge))).otherwise(p)


def clip(df: DataFrame, polygon: str, view: Column, out: str) -> DataFrame:
    """df with `out`: the polygon's part inside a box, cut side by side; an empty array where there is none. Each side
    is a column of its own, as it uses the one before several times."""
    df = df.withColumn(out, F.col(polygon))
    for axis, bound, below in ((0, x0(view), False), (0, x1(view), True), (1, y0(view), False), (1, y1(view), True)):
        df = df.withColumn(out, _clipped(F.col(out), axis, bound, below))
    return df


def clip_status(b: Column, view: Column) -> Column:
    """inside, partial or outside, of a box and a view."""
    return F.when(box_within(b, view), "inside").when(shared_area(b, view) > 0, "partial").otherwise("outside")


# transforms


def matrix(*values: Column | float) -> Column:
    return F.array(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double") for v in values])


def identity() -> Column:
    return matrix(1, 0, 0, 1, 0, 0)


def translation(x: Column | float, y: Column | float) -> Column:
    return matrix(1, 0, 0, 1, x, y)


def scaling(x: Column | float, y: Column | float) -> Column:
    return matrix(x, 0, 0, y, 0, 0)


def _parts(m: Column) -> list[Column]:
    return [F.get(m, F.lit(i)) for i in range(6)]


def compose(outer: Column, inner: Column) -> Column:
    """The transform that does `inner` and then `outer`."""
    a, b, c, d, e, f = _parts(outer)
    p, q, r, s, t, u = _parts(inner)
    return matrix(a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f)


def determinant(m: Column) -> Column:
    a, b, c, d, _, _ = _parts(m)
    return a * d - b * c


def apply(m: Column, point: Column) -> Column:
    a, b, c, d, e, f = _parts(m)
    x, y = F.get(point, F.lit(0)), F.get(point, F.lit(1))
    return F.array(a * x + c * y + e, b * x + d * y + f)


def inverse(m: Column) -> Column:
    """Null for a transform that has none."""
    a, b, c, d, e, f = _parts(m)
    det = determinant(m)
    over = lambda v: F.try_divide(v, det)
    found = matrix(over(d), over(-b), over(-c), over(a), over(c * f - d * e), over(b * e - a * f))
    return F.when(F.abs(det) > SINGULAR, found)


def inverse_error(m: Column, n: Column, width: Column, height: Column) -> Column:
    """How far, in a page's corners, going there and back ends from the start."""
    corners = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(width, F.lit(0.0)), F.array(width, height), F.array(F.lit(0.0), height))
    both = compose(n, m)

    def off(p: Column) -> Column:
        q = apply(both, p)
        return F.hypot(F.get(q, F.lit(0)) - F.get(p, F.lit(0)), F.get(q, F.lit(1)) - F.get(p, F.lit(1)))

    return F.array_max(F.transform(corners, off))


def chain(matrices: Column) -> Column:
    """All transforms of an array, the first one first."""
    return F.aggregate(matrices, identity(), lambda done, m: compose(m, done))


def round6(v: Column) -> Column:
    """Six decimals, halves up, without a negative zero."""
    return F.floor(v * 1e6 + 0.5) / 1e6 + 0.0


def round6_even(v: Column) -> Column:
    """Six decimals, halves to the even digit, without a negative zero."""
    return F.bround(v, 6) + 0.0


# pages


def effective_view(media: Column, crop: Column) -> Column:
    """The crop box's part inside the media box, or the media box where there is no crop box."""
    both = box(F.greatest(x0(media), x0(crop)), F.greatest(y0(media), y0(crop)), F.least(x1(media), x1(crop)), F.least(y1(media), y1(crop)))
    return F.when(crop.isNull(), media).otherwise(both)


def canonical_transform(view: Column, unit: Column) -> Column:
    """From a page's own space, y upwards, to points from its upper left corner."""
    return matrix(unit, 0, 0, -unit, -unit * x0(view), unit * y1(view))


def canonical_size(view: Column, unit: Column) -> Column:
    return F.array(unit * (x1(view) - x0(view)), unit * (y1(view) - y0(view)))


def display_rotation(rotation: Column, width: Column, height: Column) -> Column:
    """Turns a page clockwise by a multiple of 90 degrees so that it stays at the origin."""
    return (
        F.when(rotation == 90, matrix(0, 1, -1, 0, height, 0))
        .when(rotation == 180, matrix(-1, 0, 0, -1, width, height))
        .when(rotation == 270, matrix(0, -1, 1, 0, 0, width))
        .otherwise(identity())
    )
