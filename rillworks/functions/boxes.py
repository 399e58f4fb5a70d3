"""Box geometry as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    """The columns x1, y1, x2, y2 behind a prefix."""
    return tuple(F.col(f"{prefix}{k}").cast("double") for k in ("x1", "y1", "x2", "y2"))


def area(b: Box) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def iou(a: Box, b: Box) -> Column:
    """Overlap over union of corner boxes; negative sides count as 0, an empty union gives 0."""
    both = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0])) * F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    union = area(a) + area(b) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def yolo_to_xyxy(xc: Column, yc: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Corners in pixels of a box by centre and size relative to the image."""
    return F.struct(((xc - w / 2) * width).alias("x1"), ((yc - h / 2) * height).alias("y1"), ((xc + w / 2) * width).alias("x2"), ((yc + h / 2) * height).alias("y2"))


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def decode_anchor(tx: Column, ty: Column, tw: Column, th: Column, cx: Column, cy: Column, pw: Column, ph: Column, stride: Column) -> Column:
    """Corners in pixels of a box that a grid cell predicts relative to its anchor (in pixels)."""
    sig = lambda x: 1 / (1 + F.exp(-x))
    x, y, w, h = (sig(tx) + cx) * stride, (sig(ty) + cy) * stride, pw * F.exp(tw), ph * F.exp(th)
    return F.struct((x - w / 2).alias("x1"), (y - h / 2).alias("y1"), (x + w / 2).alias("x2"), (y + h / 2).alias("y2"))


def centerness_score(left: Column, top: Column, right: Column, bottom: Column, score: Column) -> Column:
    part = lambda a, b: F.least(a, b) / F.nullif(F.greatest(a, b), F.lit(0.0))
    return F.sqrt(part(left, right) * part(top, bottom)) * score


def circularity(size: Column, perimeter: Column) -> Column:
    """1 for a circle, a quarter of pi for a square; null without a perimeter."""
    return 4 * math.pi * size / F.nullif(perimeter * perimeter, F.lit(0.0))
