"""Boxes as four columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    def area(self, least: float = 0.0) -> Column:
        return F.greatest((self.x1 - self.x0) * (self.y1 - self.y0), F.lit(least))

    def cut(self, other: Box) -> Column:
        """Area of the intersection."""
        w = F.greatest(F.least(self.x1, other.x1) - F.greatest(self.x0, other.x0), F.lit(0.0))
        h = F.greatest(F.least(self.y1, other.y1) - F.greatest(self.y0, other.y0), F.lit(0.0))
        return w * h

    def iou(self, other: Box) -> Column:
        """Intersection over union; areas count as 1 at least."""
        return self.cut(other) / (self.area(1.0) + other.area(1.0) - self.cut(other))

    def contains(self, inner: Box, pad: float = 0.0) -> Column:
        return (self.x0 <= inner.x0 + pad) & (self.y0 <= inner.y0 + pad) & (self.x1 >= inner.x1 - pad) & (self.y1 >= inner.y1 - pad)

    def transformed(self, m: tuple[float, float, float, float, float, float]) -> Box:
        """An affine transform (a, b, c, d, e, f): x' = a x + c y + e, y' = b x + d y + f; corners in order."""
        a, b, c, d, e, f = m
        xs = [x * a + y * c + e for x in (self.x0, self.x1) for y in (self.y0, self.y1)]
        ys = [x * b + y * d + f for x in (self.x0, self.x1) for y in (self.y0, self.y1)]
        return Box(F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys))

    def unrotated(self, angle: int, size: tuple[float, float], origin: tuple[float, float], scale: float) -> Box:
        """A box found in a band of that size, turned by 90 or 270 degrees and enlarged, in the coordinates around the band's origin."""
        w, h = size
        turned = (w - self.y1, self.x0, w - self.y0, self.x1) if angle == 90 else (self.y0, h - self.x1, self.y1, h - self.x0)
        return Box(*((c + o) / scale for c, o in zip(turned, (*origin, *origin), strict=True)))


def sub_box(x0: Column, x1: Column, start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """The part of a line's box that its characters from start to end take."""
    unit = (x1 - x0) / F.greatest(length, F.lit(1))
    return x0 + unit * start, x0 + unit * end
