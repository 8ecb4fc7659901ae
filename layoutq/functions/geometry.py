"""Boxes and intervals as Columns. y grows downwards; intervals are closed, so touching ones intersect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(a: Column, b: Column) -> Column:
    return b - a


def center(a: Column, b: Column) -> Column:
    return (a + b) / 2.0


def intersects(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return ~((a1 < b0) | (b1 < a0))


def contains(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b0) & (b1 <= a1)


def share_inside(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """How much of interval b lies in interval a; for a point b whether it does."""
    part = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(a1 < a0, F.lit(0.0)).when(b1 > b0, part / (b1 - b0)).otherwise(F.when((a0 <= b0) & (b0 <= a1), 1.0).otherwise(0.0))


def overlapping_range(a0: Column, a1: Column, b0: Column, b1: Column) -> tuple[Column, Column]:
    """The part of a that b covers, as fractions of a; (0, 1) for a point a, null where they don't meet."""
    meets = intersects(a0, a1, b0, b1)
    lo = F.when(a1 <= a0, F.lit(0.0)).otherwise((F.greatest(a0, b0) - a0) / (a1 - a0))
    hi = F.when(a1 <= a0, F.lit(1.0)).otherwise((F.least(a1, b1) - a0) / (a1 - a0))
    return F.when(meets, lo), F.when(meets, hi)


def eroded(a: Column, b: Column, by: Column) -> tuple[Column, Column]:
    """The interval less ``by`` on both sides; null if nothing is left."""
    ok = (b - by) > (a + by)
    return F.when(ok, a + by), F.when(ok, b - by)


def eroded_if_possible(a: Column, b: Column, by: Column) -> tuple[Column, Column]:
    lo, hi = eroded(a, b, by)
    return F.coalesce(lo, a), F.coalesce(hi, b)


def box_distance(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Length of the gap between two boxes, 0 where they meet."""
    dx = F.greatest(F.lit(0.0), b["x0"] - a["x1"], a["x0"] - b["x1"])
    dy = F.greatest(F.lit(0.0), b["y0"] - a["y1"], a["y0"] - b["y1"])
    return F.sqrt(dx * dx + dy * dy)


def union_of_boxes(prefix: str = "") -> list[Column]:
    """Aggregates for the box around all boxes of a group."""
    return [F.min("x0").alias(f"{prefix}x0"), F.max("x1").alias(f"{prefix}x1"), F.min("y0").alias(f"{prefix}y0"), F.max("y1").alias(f"{prefix}y1")]


def to_fraction(v: Column, a: Column, b: Column) -> Column:
    return F.when(b > a, (v - a) / (b - a)).otherwise(F.lit(0.0))


def from_fraction(v: Column, a: Column, b: Column) -> Column:
    return a + v * (b - a)
