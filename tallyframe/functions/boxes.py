"""Column expressions over boxes (x, y, w, h) in a fixed canvas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

CANVAS_W, CANVAS_H = 1600, 900
#: Inches per canvas pixel of a 13.333 inch wide page; points per pixel of a font.
INCH, POINT = 13.333 / 1600, 0.6


@dataclass(frozen=True)
class Box:
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h

    @property
    def cx(self) -> Column:
        return self.x + self.w / 2

    @property
    def cy(self) -> Column:
        return self.y + self.h / 2

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.w.alias("w"), self.h.alias("h"))


def box(prefix: str = "", suffix: str = "") -> Box:
    """The columns x, y, w, h, say of an alias (prefix "a.") or a struct."""
    return Box(*(F.col(f"{prefix}{c}{suffix}") for c in "xywh"))


def js_round(c: Column) -> Column:
    """Half toward positive infinity."""
    return F.floor(c + 0.5)


def half_even(c: Column) -> Column:
    return F.bround(c, 0)


def between(c: Column, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(c, high))


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0)
    return F.greatest(zero, F.least(a.right, b.right) - F.greatest(a.x, b.x)) * F.greatest(zero, F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))


def intersects(a: Box, b: Box) -> Column:
    return (a.x < b.right) & (b.x < a.right) & (a.y < b.bottom) & (b.y < a.bottom)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, the denominator 1 at least."""
    both = intersection(a, b)
    return both / F.greatest(F.lit(1), a.area + b.area - both)


def overlap_min(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; not the same as iou."""
    return intersection(a, b) / F.greatest(F.lit(1), F.least(a.area, b.area))


def overlap_first(a: Box, b: Box) -> Column:
    """Intersection over the first area."""
    return intersection(a, b) / F.greatest(F.lit(1), a.area)


def contains(outer: Box, inner: Box) -> Column:
    return (outer.x <= inner.x) & (outer.y <= inner.y) & (outer.right >= inner.right) & (outer.bottom >= inner.bottom)


def holds_point(outer: Box, px: Column, py: Column) -> Column:
    return (px >= outer.x) & (px <= outer.right) & (py >= outer.y) & (py <= outer.bottom)


def is_finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def valid(b: Box, width=CANVAS_W, height=CANVAS_H, least=0, slack=0.0) -> Column:
    """Finite, of more than `least` extent, inside of the canvas (with slack)."""
    finite = is_finite(b.x) & is_finite(b.y) & is_finite(b.w) & is_finite(b.h)
    inside = (b.w > least) & (b.h > least) & (b.x >= 0) & (b.y >= 0) & (b.right <= width + slack) & (b.bottom <= height + slack)
    return finite & F.coalesce(inside, F.lit(False))


def clamped(b: Box, width=CANVAS_W, height=CANVAS_H) -> Box:
    """Inside of the canvas with an extent of 2 at least."""
    x, y = between(b.x, 0, width - 2), between(b.y, 0, height - 2)
    return Box(x, y, F.greatest(F.lit(2), F.least(b.w, width - x)), F.greatest(F.lit(2), F.least(b.h, height - y)))


def expanded(b: Box, by: Column, width=CANVAS_W, height=CANVAS_H) -> Box:
    left, top = F.greatest(F.lit(0), b.x - by), F.greatest(F.lit(0), b.y - by)
    return Box(left, top, F.least(F.lit(width), b.right + by) - left, F.least(F.lit(height), b.bottom + by) - top)


def clean_margin(h: Column) -> Column:
    return between(half_even(h * 0.08), 2, 8)


def text_margin(h: Column) -> Column:
    return between(half_even(h * 0.15), 3, 10)


def decoded(mode: Column, v0: Column, v1: Column, v2: Column, v3: Column) -> Column:
    """A struct of canvas pixels from one of the declared encodings, null for any other."""
    normal = mode == "normalized_1000_xyxy"
    corner = normal | (mode == "xyxy_1600")
    fx, fy = F.when(normal, F.lit(1.6)).otherwise(1.0), F.when(normal, F.lit(0.9)).otherwise(1.0)
    x, y = v0 * fx, v1 * fy
    w, h = F.when(corner, v2 * fx - x).otherwise(v2), F.when(corner, v3 * fy - y).otherwise(v3)
    x, y, w, h = (half_even(c) for c in (x, y, w, h))
    x, y = between(x, 0, CANVAS_W - 1), between(y, 0, CANVAS_H - 1)
    out = Box(x, y, F.greatest(F.lit(1), F.least(CANVAS_W - x, w)), F.greatest(F.lit(1), F.least(CANVAS_H - y, h)))
    return F.when(corner | (mode == "xywh_1600"), out.struct())


def normalized_decoded(kind: Column, v0: Column, v1: Column, v2: Column, v3: Column) -> Column:
    """Thousandths of the canvas as corners or extents, to two places."""
    x, y = v0 * 1.6, v1 * 0.9
    w = F.when(kind == "xyxy", v2 * 1.6 - x).otherwise(v2 * 1.6)
    h = F.when(kind == "xyxy", v3 * 0.9 - y).otherwise(v3 * 0.9)
    return Box(*(F.bround(c, 2) for c in (x, y, w, h))).struct()


def from_quad(points: Column) -> Box:
    """The axis box of x0, y0, ..., x3, y3."""
    xs, ys = (F.array(*(points[i + k] for i in (0, 2, 4, 6))) for k in (0, 1))
    return Box(F.array_min(xs), F.array_min(ys), F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys))


def from_centre(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2, cy - h / 2, w, h)


def rescaled(b: Box, width: Column, height: Column) -> Box:
    """From an image's pixels to the canvas, rounded, kept inside."""
    sx, sy = CANVAS_W / F.greatest(F.lit(1), width), CANVAS_H / F.greatest(F.lit(1), height)
    x, y = F.greatest(F.lit(0), js_round(b.x * sx)), F.greatest(F.lit(0), js_round(b.y * sy))
    return Box(x, y, F.least(CANVAS_W - x, F.greatest(F.lit(2), js_round(b.w * sx))), F.least(CANVAS_H - y, F.greatest(F.lit(2), js_round(b.h * sy))))


def letterbox(width: Column, height: Column) -> Column:
    """Scale and centred offsets that put an image into the canvas whole."""
    scale = F.least(CANVAS_W / width, CANVAS_H / height)
    return F.struct(scale.alias("scale"), ((CANVAS_W - width * scale) / 2).alias("dx"), ((CANVAS_H - height * scale) / 2).alias("dy"))


def grid_cells(b: Box, size: int) -> Column:
    """The cells that a box reaches, as structs gx, gy: explode for a join by cell."""
    def low(c):
        return F.floor(c / size)

    return F.flatten(F.transform(F.sequence(low(b.x), low(b.right)), lambda gx: F.transform(F.sequence(low(b.y), low(b.bottom)), lambda gy: F.struct(gx.alias("gx"), gy.alias("gy")))))


def reference_cell(a: Box, b: Box, size: int, gx: Column, gy: Column) -> Column:
    """Whether this is the one cell in which a pair of boxes that share cells is kept."""
    return (F.floor(F.greatest(a.x, b.x) / size) == gx) & (F.floor(F.greatest(a.y, b.y) / size) == gy)
