"""Column functions on boxes and contours.

Boxes are four integer columns, half-open on the max side.  Index queries compare them as *closed*
intervals, so the predicates use ``<=``/``>=`` throughout.  Contours are ``array<struct<x,y>>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """Four columns; names are turned into columns only when used, so boxes can be module constants."""

    def __init__(self, x0: Column | str, y0: Column | str, x1: Column | str, y1: Column | str):
        self._sides = (x0, y0, x1, y1)

    @classmethod
    def of(cls, prefix: str = "", x0="x_min", y0="y_min", x1="x_max", y1="y_max") -> "Box":
        return cls(prefix + x0, prefix + y0, prefix + x1, prefix + y1)

    def _side(self, i: int) -> Column:
        side = self._sides[i]
        return F.col(side) if isinstance(side, str) else side

    x0 = property(lambda self: self._side(0))
    y0 = property(lambda self: self._side(1))
    x1 = property(lambda self: self._side(2))
    y1 = property(lambda self: self._side(3))

    @property
    def area(self) -> Column:
        return (self.x1 - self.x0).cast("long") * (self.y1 - self.y0).cast("long")


def intersects(a: Box, b: Box) -> Column:
    return (a.x0 <= b.x1) & (a.x1 >= b.x0) & (a.y0 <= b.y1) & (a.y1 >= b.y0)


def contains(outer: Box, inner: Box) -> Column:
    return (inner.x0 >= outer.x0) & (inner.x1 <= outer.x1) & (inner.y0 >= outer.y0) & (inner.y1 <= outer.y1)


def box_iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 when the boxes are apart."""
    w = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)
    h = F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    inter = w.cast("long") * h.cast("long")
    iou = inter.cast("double") / (a.area + b.area - inter).cast("double")
    return F.when((w < 0) | (h < 0), F.lit(0.0)).otherwise(iou)


def scale_factor(proc: Column, base: Column) -> Column:
    """proc/base; 1 when the base resolution is missing or zero."""
    return F.when(base.isNull() | (base == 0), F.lit(1.0)).otherwise(proc / base)


def truncate(value: Column) -> Column:
    """Integer truncation towards zero."""
    return F.when(value >= 0, F.floor(value)).otherwise(F.ceil(value)).cast("int")


def half_even(value: Column) -> Column:
    return F.bround(value).cast("int")


def corners(box: Box) -> Column:
    """The four corners of a box as a contour."""
    point = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    return F.array(point(box.x0, box.y0), point(box.x1, box.y0), point(box.x1, box.y1), point(box.x0, box.y1))


def move_points(contour: Column, scale=1.0, dx=0, dy=0) -> Column:
    """``(p + d) * scale`` on every contour point, as doubles."""
    k, ox, oy = (v if isinstance(v, Column) else F.lit(v) for v in (scale, dx, dy))
    return F.transform(
        contour,
        lambda p: F.struct(
            ((p["x"] + ox) * k).cast("double").alias("x"), ((p["y"] + oy) * k).cast("double").alias("y")
        ),
    )


def truncate_points(contour: Column) -> Column:
    return F.transform(contour, lambda p: F.struct(truncate(p["x"]).alias("x"), truncate(p["y"]).alias("y")))


def close_ring(contour: Column) -> Column:
    first, last = F.element_at(contour, 1), F.element_at(contour, -1)
    return F.when((F.size(contour) == 0) | (first == last), contour).otherwise(F.concat(contour, F.array(first)))


def shoelace(contour: Column) -> Column:
    """Unsigned polygon area of an open or closed contour."""
    after = F.concat(F.slice(contour, 2, F.greatest(F.size(contour) - 1, F.lit(0))), F.slice(contour, 1, 1))
    terms = F.zip_with(
        contour, after, lambda p, q: p["x"].cast("double") * q["y"] - q["x"].cast("double") * p["y"]
    )
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def usable_contour(contour: Column) -> Column:
    """At least three points and a non-zero area."""
    return F.coalesce((F.size(contour) >= 3) & (shoelace(contour) > 0), F.lit(False))


def valid_ring(ring: Column) -> Column:
    """Structural polygon rules: closed, four or more points, finite numbers, non-zero area."""
    finite = F.forall(
        ring,
        lambda p: p["x"].isNotNull()
        & p["y"].isNotNull()
        & ~F.isnan(p["x"].cast("double"))
        & ~F.isnan(p["y"].cast("double"))
        & (F.abs(p["x"].cast("double")) < float("inf"))
        & (F.abs(p["y"].cast("double")) < float("inf")),
    )
    closed = F.element_at(ring, 1) == F.element_at(ring, -1)
    return F.coalesce((F.size(ring) >= 4) & finite & closed & (shoelace(ring) > 0), F.lit(False))


def clip_box(box: Box, width: Column, height: Column) -> Box:
    return Box(
        F.greatest(box.x0, F.lit(0)),
        F.greatest(box.y0, F.lit(0)),
        F.least(box.x1, width),
        F.least(box.y1, height),
    )


def padded(box: Box, pad: int, width: Column, height: Column) -> Box:
    """Grow each side by ``pad``, but only where the grown side stays inside the raster."""
    return Box(
        F.when(box.x0 - pad >= 0, box.x0 - pad).otherwise(box.x0),
        F.when(box.y0 - pad >= 0, box.y0 - pad).otherwise(box.y0),
        F.when(box.x1 + pad <= width - 1, box.x1 + pad).otherwise(box.x1),
        F.when(box.y1 + pad <= height - 1, box.y1 + pad).otherwise(box.y1),
    )
