"""Bounding-box expressions on [x1, y1, x2, y2] columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns ``x1, y1, x2, y2`` behind a prefix such as ``a.``."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    zero = F.lit(0.0)
    width = F.greatest(zero, F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(zero, F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return width * height


def box_iou(a: Box, b: Box, eps: float | None = None) -> Column:
    """Intersection over union. ``eps=None``: 0 where the union is empty; else the union is at least ``eps``."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    if eps is None:
        return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union)
    return inter / F.greatest(union, F.lit(eps))


def box_containment(inner: Box, outer: Box, eps: float = 1e-6) -> Column:
    """Share of ``inner`` that lies in ``outer``."""
    return intersection(inner, outer) / F.greatest(area(inner), F.lit(eps))


def to_center(b: Box, width: float, height: float) -> tuple[Column, Column, Column, Column]:
    """Pixel corners to (cx, cy, w, h) as shares of the image size."""
    w, h = F.lit(float(width)), F.lit(float(height))
    return ((b[0] + b[2]) / 2 / w, (b[1] + b[3]) / 2 / h, (b[2] - b[0]) / w, (b[3] - b[1]) / h)
