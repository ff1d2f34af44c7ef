"""Boxes in units of the picture, as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Diagonal of a picture of unit width and height.
DIAGONAL = math.sqrt(2.0)


def clamp01(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def unit_box(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Pixel corners in any order -> ordered corners within [0, 1]; null where a size is missing or zero."""
    w, h = F.nullif(width.cast("double"), F.lit(0.0)), F.nullif(height.cast("double"), F.lit(0.0))
    return F.struct(
        clamp01(F.least(x0, x1) / w).alias("x0"), clamp01(F.least(y0, y1) / h).alias("y0"),
        clamp01(F.greatest(x0, x1) / w).alias("x1"), clamp01(F.greatest(y0, y1) / h).alias("y1"),
    )


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the boxes do not meet."""
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    common = F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)
    union = area(a) + area(b) - common
    return F.when((common > 0) & (union > 0), common / F.nullif(union, F.lit(0.0))).otherwise(0.0)


def center_distance(a: Column, b: Column) -> Column:
    dx = (a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2
    dy = (a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2
    return F.hypot(dx, dy)


def region_match(a: Column, b: Column, iou_threshold: float = 0.3, center_dist_ratio: float = 0.08) -> Column:
    """Same place on the screen: enough overlap, or centres closer than a share of the diagonal."""
    return (iou(a, b) > iou_threshold) | (center_distance(a, b) < center_dist_ratio * DIAGONAL)


# the same on plain tuples, for the fold


def box_iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    sides = [max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1]) for x in (a, b)]
    union = sum(sides) - w * h
    return w * h / union if union > 0 else 0.0


def same_region(a: tuple, b: tuple, iou_threshold: float, center_dist_ratio: float) -> bool:
    if box_iou(a, b) > iou_threshold:
        return True
    return math.hypot((a[0] + a[2] - b[0] - b[2]) / 2, (a[1] + a[3] - b[1] - b[3]) / 2) < center_dist_ratio * DIAGONAL
