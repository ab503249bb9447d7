"""Boxes as columns.  A box is a tuple of column names or columns (x1, y1, x2, y2)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def area(box) -> Column:
    x1, y1, x2, y2 = map(_c, box)
    return (x2 - x1).cast("double") * (y2 - y1)


def intersection(a, b) -> Column:
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    w = F.least(ax2, bx2) - F.greatest(ax1, bx1)
    h = F.least(ay2, by2) - F.greatest(ay1, by1)
    return F.greatest(w, F.lit(0)).cast("double") * F.greatest(h, F.lit(0))


def _share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole: points and lines overlap nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def iou(a, b) -> Column:
    """Intersection over union; 0 for two boxes without area."""
    i = intersection(a, b)
    return _share(i, area(a) + area(b) - i)


def over_smaller(a, b) -> Column:
    """Intersection over the smaller area; 0 if that box has no area."""
    return _share(intersection(a, b), F.least(area(a), area(b)))


def contains(box, x, y, closed: bool = False) -> Column:
    """Point in box; half-open unless closed."""
    x1, y1, x2, y2 = map(_c, box)
    x, y = _c(x), _c(y)
    inside = (x >= x1) & (y >= y1)
    return inside & ((x <= x2) & (y <= y2) if closed else (x < x2) & (y < y2))


def overlaps(a, b, closed: bool = False) -> Column:
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    if closed:
        return (ax1 <= bx2) & (ax2 >= bx1) & (ay1 <= by2) & (ay2 >= by1)
    return (ax1 < bx2) & (ax2 > bx1) & (ay1 < by2) & (ay2 > by1)


def clip(x, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(_c(x), F.lit(high)))
