"""Expressions over boxes: four double columns x0, y0, x1, y1 in 0..1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-4
MAX_SAFE_PIXELS = 25_000_000


@dataclass(frozen=True)
class Box:
    """The four columns of a box, optionally of a join side: Box.of("a") is a.x0 and so on."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, side: str | None = None, suffix: str = "") -> Box:
        return cls(*[F.col(f"{side}.{c}{suffix}" if side else f"{c}{suffix}") for c in ("x0", "y0", "x1", "y1")])

    @property
    def area(self) -> Column:
        zero = F.lit(0.0)
        return F.greatest(zero, self.x1 - self.x0) * F.greatest(zero, self.y1 - self.y0)

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def region(self) -> Column:
        """header, footer or body by the page edges (PRJ-06)."""
        return F.when(self.y1 <= 0.16, "header").when(self.y0 >= 0.84, "footer").otherwise("body")

    def refinable(self) -> Column:
        """Large enough for a second look (PRJ-09)."""
        return (self.x1 - self.x0 > 0.03) & (self.y1 - self.y0 > 0.008) & self.finite()

    def finite(self) -> Column:
        ok = F.lit(True)
        for c in (self.x0, self.y0, self.x1, self.y1):
            ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        return ok

    def valid(self) -> Column:
        """0 <= x0 < x1 <= 1 on both axes (PRJ-10)."""
        return (self.x0 >= 0) & (self.x0 < self.x1) & (self.x1 <= 1) & (self.y0 >= 0) & (self.y0 < self.y1) & (self.y1 <= 1)


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection, 0 where the boxes do not overlap."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, 0 for disjoint boxes (JN-02)."""
    i = overlap(a, b)
    return F.when(i > 0, i / (a.area + b.area - i)).otherwise(0.0)


def intersects(a: Box, b: Box) -> Column:
    """Strict overlap of the intervals on both axes; null is no (JN-07)."""
    return F.coalesce((a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1), F.lit(False))


def widen(box: Box) -> Box:
    """Degenerate edges widened; values outside 0..1 raise (PRJ-01)."""

    def check(c: Column) -> Column:
        return F.when((c >= 0) & (c <= 1), c).otherwise(F.raise_error(F.lit("box outside 0..1")).cast("double"))

    x0, y0, x1, y1 = map(check, (box.x0, box.y0, box.x1, box.y1))
    return Box(x0, y0, F.when(x1 <= x0, F.least(F.lit(1.0), x0 + EPS)).otherwise(x1), F.when(y1 <= y0, F.least(F.lit(1.0), y0 + EPS)).otherwise(y1))


def clamp(box: Box) -> Box:
    """Clamped to 0..1, inverted edges swapped (PRJ-02)."""
    x0, y0, x1, y1 = (F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) for c in (box.x0, box.y0, box.x1, box.y1))
    return Box(F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def from_pixels(box: Box, width: Column, height: Column) -> Column:
    """A model's box as a normalised struct, or null: fractions, corner pixels, then corner and size (PRJ-03)."""

    def row(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))

    one = F.lit(1.0)
    a, b, c, d = box.x0, box.y0, box.x1, box.y1
    corner = (c > a) & (d > b) & (c <= width + 1) & (d <= height + 1)
    sized = (c > 0) & (d > 0) & (a + c <= width + 1) & (b + d <= height + 1)
    none = F.lit(None).cast("struct<x0:double,y0:double,x1:double,y1:double>")
    return (
        F.when(F.least(a, b, c, d) < 0, none)
        .when(F.greatest(a, b, c, d) <= 1, F.when((c > a) & (d > b), row(a, b, c, d)))
        .when(corner, row(a / width, b / height, F.least(one, c / width), F.least(one, d / height)))
        .when(sized, row(a / width, b / height, F.least(one, (a + c) / width), F.least(one, (b + d) / height)))
    )


def axis_order(boxes: str = "boxes") -> Column:
    """yxyx if most boxes of positive sides would be tall as xyxy (MISC-03). ``boxes``: array<array<double>>."""
    side = F.filter(boxes, lambda b: (F.size(b) == 4) & (F.abs(b[2] - b[0]) > 0) & (F.abs(b[3] - b[1]) > 0))
    tall = F.filter(side, lambda b: F.abs(b[3] - b[1]) > 1.5 * F.abs(b[2] - b[0]))
    return F.when(F.size(tall) > F.size(side) / 2, "yxyx").otherwise("xyxy")


def safe_dpi(width: Column, height: Column, requested: Column, most: int = MAX_SAFE_PIXELS) -> Column:
    """Largest dpi in 72..requested whose page stays below ``most`` pixels (SRC-03); sizes in points."""
    return F.greatest(F.lit(72), F.least(requested, F.floor(72 * F.sqrt(F.lit(float(most)) / (width * height))))).cast("int")


def effective_dpi(width: Column, height: Column, requested: Column, longest: Column) -> Column:
    """dpi at which the longer side is about ``longest`` pixels, then SRC-03 (SRC-04)."""
    want = F.greatest(F.lit(72), F.least(requested, F.floor(longest * 72 / F.greatest(width, height))))
    return safe_dpi(width, height, want)


def line_slices(text: Column, box: Box) -> Column:
    """Text of a box as lines with equal vertical slices (SNK-09).

    A tall box of at least two words is cut into two lines, or three beyond .13 of the page.
    """
    given = F.filter(F.split(text, "\n"), lambda x: x != "")
    w = F.filter(F.split(F.get(given, F.lit(0)), " "), lambda x: x != "")
    h, n = box.y1 - box.y0, F.size(w)
    tall = (F.size(given) == 1) & (h > 0.07) & (h / (box.x1 - box.x0) > 0.20) & (n >= 2)
    parts = F.when(h > 0.13, F.least(F.lit(3), n)).otherwise(2)

    def cut(i: Column) -> Column:
        return F.rint(i * n / parts).cast("int")

    split = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.array_join(F.slice(w, cut(i) + 1, cut(i + 1) - cut(i)), " "))
    lines = F.when(tall, split).otherwise(given)
    k = F.size(lines)
    return F.transform(lines, lambda t, i: F.struct(t.alias("text"), (box.y0 + h * i / k).alias("y0"), (box.y0 + h * (i + 1) / k).alias("y1")))


def detected_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """struct(boxes, nan, inf): a detector's pixel boxes as fractions of the page, in reading order (EXT-01).

    Boxes with a NaN are dropped and counted, then those with an infinity, then what has no area once clamped to the page.
    A box without four numbers has no area; a null list is empty.
    """
    all_ = F.coalesce(boxes, F.array().cast("array<array<double>>"))
    any_ = lambda f: lambda b: F.exists(b, lambda v: F.coalesce(f(v), F.lit(False)))
    nan, inf = any_(F.isnan), any_(lambda v: F.abs(v) == float("inf"))
    finite = F.filter(all_, lambda b: ~nan(b) & ~inf(b) & (F.size(b) == 4) & F.forall(b, lambda v: v.isNotNull()))
    side = lambda b, k, by: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.get(b, F.lit(k)) / by))
    placed = F.transform(finite, lambda b: F.struct(side(b, 1, height).alias("y0"), side(b, 0, width).alias("x0"), side(b, 2, width).alias("x1"), side(b, 3, height).alias("y1")))
    kept = F.sort_array(F.filter(placed, lambda b: (b["x1"] > b["x0"]) & (b["y1"] > b["y0"])))
    ordered = F.transform(kept, lambda b: F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), b["x1"].alias("x1"), b["y1"].alias("y1")))
    return F.struct(ordered.alias("boxes"), F.size(F.filter(all_, nan)).alias("nan"), F.size(F.filter(all_, lambda b: ~nan(b) & inf(b))).alias("inf"))
