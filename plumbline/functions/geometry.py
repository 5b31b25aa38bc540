"""Geometry on boxes: [x, y, w, h] as four columns in 0..1, and corner boxes [x0, y0, x1, y1]."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances of position rules, and base confidences and caps of verdicts.
PAGE_TOLERANCE, VIEW_TOLERANCE, MOST_TOLERANCE, ANCHOR_FACTOR = 0.06, 0.10, 0.35, 0.25
BASE_CONFIDENCE = {"Exact": 0.95, "Normalized": 0.85, "Ambiguous": 0.45, "Qr": 0.90, "QrBlind": 0.60, "Icon": 0.70}
OTHER_CONFIDENCE = 0.60
STATE_CAPS = {"LowConfidence": 0.55, "Extra": 0.40, "NotDetected": 0.30, "Missing": 0.70, "NotComparable": 0.10}


@dataclass(frozen=True)
class Box:
    """Columns of a box; any null makes the box null."""

    x: Column
    y: Column
    w: Column
    h: Column

    @staticmethod
    def of(prefix: str = "") -> Box:
        return Box(*(F.col(prefix + c) for c in "xywh"))

    @property
    def centre(self) -> tuple[Column, Column]:
        return self.x + self.w / 2, self.y + self.h / 2

    @property
    def area(self) -> Column:
        return self.w * self.h


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def offset(expected: Box, observed: Box) -> Column:
    """Distance of the centres to four decimals, half to even."""
    return F.bround(distance(expected.centre, observed.centre), 4)


def clamp(value: Column, low: float | Column, high: float | Column) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def normalize_corners(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> list[Column]:
    """Corners in any order as a box in 0..1, six decimals."""
    left, right = F.least(x0, x1), F.greatest(x0, x1)
    top, bottom = F.least(y0, y1), F.greatest(y0, y1)
    a, b = clamp(left / width, 0.0, 1.0), clamp(right / width, 0.0, 1.0)
    c, d = clamp(top / height, 0.0, 1.0), clamp(bottom / height, 0.0, 1.0)
    return [F.bround(v, 6) for v in (a, c, b - a, d - c)]


def rebase(page: Box, view: Box) -> Box:
    """A page box in the coordinates of a view; a view without width or height counts as 1."""
    w, h = (F.when(v <= 0, F.lit(1.0)).otherwise(v) for v in (view.w, view.h))
    return Box((page.x - view.x) / w, (page.y - view.y) / h, page.w / w, page.h / h)


def overlap(a: Box, b: Box) -> Column:
    """Area that two boxes share."""
    w = F.least(a.x + a.w, b.x + b.w) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.h, b.y + b.h) - F.greatest(a.y, b.y)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    both = overlap(a, b)
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(0.0)


def same_spot(a: Box, b: Box, least: float = 0.9) -> Column:
    return iou(a, b) >= least


def position_ok(expected: Box, observed: Box, tolerance: Column) -> Column:
    """The centres are within tolerance, or the observed box covers half of the expected one."""
    covered = F.when(expected.area > 0, overlap(expected, observed) / expected.area).otherwise(0.0)
    return (offset(expected, observed) <= tolerance) | (covered >= 0.5)


def axis_gap(a: Box, b: Box) -> tuple[Column, Column]:
    """Horizontal and vertical gap of two boxes, 0 where they overlap."""
    dx = F.greatest(F.lit(0.0), F.greatest(a.x, b.x) - F.least(a.x + a.w, b.x + b.w))
    dy = F.greatest(F.lit(0.0), F.greatest(a.y, b.y) - F.least(a.y + a.h, b.y + b.h))
    return dx, dy


def affine_envelope(box: Box, m: list[Column]) -> list[Column]:
    """The axis-aligned envelope of a box under x' = m0 x + m1 y + m2, y' = m3 x + m4 y + m5."""
    corners = [(box.x, box.y), (box.x + box.w, box.y), (box.x, box.y + box.h), (box.x + box.w, box.y + box.h)]
    xs = [m[0] * x + m[1] * y + m[2] for x, y in corners]
    ys = [m[3] * x + m[4] * y + m[5] for x, y in corners]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs) - F.least(*xs), F.greatest(*ys) - F.least(*ys)]


def determinant(a: list[list[Column]]) -> Column:
    return (
        a[0][0] * (a[1][1] * a[2][2] - a[1][2] * a[2][1])
        - a[0][1] * (a[1][0] * a[2][2] - a[1][2] * a[2][0])
        + a[0][2] * (a[1][0] * a[2][1] - a[1][1] * a[2][0])
    )


def solve3(a: list[list[Column]], b: list[Column]) -> list[Column]:
    """Solution of three equations; null where the determinant is below 1e-12."""
    d = determinant(a)
    swapped = [[[b[i] if j == k else a[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
    return [F.when(F.abs(d) >= 1e-12, determinant(s) / d) for s in swapped]


def fit_affine(x: Column, y: Column, u: Column, v: Column) -> list[Column]:
    """Aggregates: the least-squares affine map from (x, y) to (u, v), six coefficients."""
    sx, sy, sxx, syy, sxy, n = F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y), F.count(x).cast("double")
    a = [[sxx, sxy, sx], [sxy, syy, sy], [sx, sy, n]]
    return [*solve3(a, [F.sum(x * u), F.sum(y * u), F.sum(u)]), *solve3(a, [F.sum(x * v), F.sum(y * v), F.sum(v)])]


def trim_code(box: Box, codes: Column) -> Column:
    """x, y, w, h (a struct) of a text box after codes (array of x, y, w, h structs) have cut it, one after another.

    A code that covers 15 % of its width and 50 % of its height cuts it at the code's nearer side.
    """

    def cut(b: Column, c: Column) -> Column:
        left, right = F.greatest(b["x"], c["x"]), F.least(b["x"] + b["w"], c["x"] + c["w"])
        top, bottom = F.greatest(b["y"], c["y"]), F.least(b["y"] + b["h"], c["y"] + c["h"])
        hit = (right - left >= 0.15 * b["w"]) & (bottom - top >= 0.5 * b["h"])
        from_right = c["x"] + c["w"] / 2 > b["x"] + b["w"] / 2
        x = F.when(from_right, b["x"]).otherwise(right)
        w = F.when(from_right, left - b["x"]).otherwise(b["x"] + b["w"] - right)
        return F.when(hit & (w > 0), F.struct(x.alias("x"), b["y"].alias("y"), w.alias("w"), b["h"].alias("h"))).otherwise(b)

    return F.aggregate(codes, F.struct(box.x.alias("x"), box.y.alias("y"), box.w.alias("w"), box.h.alias("h")), cut)


def average_hash(values: Column) -> Column:
    """Bits of an array: whether each value is over the mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(values)
    return F.transform(values, lambda v: v.cast("double") > mean)


def hash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits; 0 for different lengths or none."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), same / F.size(a)).otherwise(0.0)


def tolerance(by_view: Column, residual: Column | None = None, from_centroid: Column | None = None) -> Column:
    """Position tolerance, wider for views, and with an anchor by its residual and the distance from its centroid."""
    base = F.when(by_view, VIEW_TOLERANCE).otherwise(PAGE_TOLERANCE)
    if residual is not None and from_centroid is not None:
        base = base + F.coalesce(residual + ANCHOR_FACTOR * from_centroid, F.lit(0.0))
    return F.least(base, F.lit(MOST_TOLERANCE))


def confidence(level: Column, state: Column, off: Column, tol: Column, trusted: Column, degraded_code: Column, blind: Column, mark: Column) -> Column:
    """Confidence of a verdict: by evidence, capped by state, lowered by offset and by what can't be trusted; 4 decimals."""
    c = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in BASE_CONFIDENCE.items()], F.lit(OTHER_CONFIDENCE))
    capped = F.when(state == "Matched", c).when(state == "NotApplicable", 1.0)
    for k, v in STATE_CAPS.items():
        capped = capped.when(state == k, F.least(c, F.lit(v)))
    c = capped.otherwise(0.0)
    factor = F.when(tol > 1e-9, 1.0 - F.least(F.lit(1.0), off / (2.0 * tol))).otherwise(0.5)
    c = F.when(off.isNotNull() & state.isin("Matched", "LowConfidence"), c * clamp(factor, 0.5, 1.0)).otherwise(c)
    c = c * F.when(trusted, 1.0).otherwise(0.70) * F.when(degraded_code, 0.85).otherwise(1.0) * F.when(blind, 0.80).otherwise(1.0)
    c = F.when(mark > 0, c * (0.85 + 0.15 * clamp(mark, 0.0, 1.0))).otherwise(c)
    return F.bround(clamp(c, 0.0, 1.0), 4)
