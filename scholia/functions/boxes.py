"""Geometry of boxes (x1, y1, x2, y2), y downwards, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(a: Box) -> Column:
    return F.greatest(a[2] - a[0], F.lit(0.0)) * F.greatest(a[3] - a[1], F.lit(0.0))


def intersection(a: Box, b: Box) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def overlap_of_smaller(a: Box, b: Box) -> Column:
    """Shared area over the smaller box's; without area: 0."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(F.lit(0.0))


def edge_distance(a: Box, b: Box) -> Column:
    """Least distance between two boxes' edges; 0 where they meet."""
    dx = F.greatest(a[0] - b[2], b[0] - a[2], F.lit(0.0))
    dy = F.greatest(a[1] - b[3], b[1] - a[3], F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def contains(outer: Box, inner: Box, slack: float = 1.0) -> Column:
    return (inner[0] >= outer[0] - slack) & (inner[1] >= outer[1] - slack) & (inner[2] <= outer[2] + slack) & (inner[3] <= outer[3] + slack)
