"""Bounding boxes as structs of four doubles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYWH = ("x", "y", "w", "h")
XYXY = ("x1", "y1", "x2", "y2")


def box(names: tuple[str, ...], values: list[Column]) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(names, values)])


def to_xyxy(b: Column) -> Column:
    x, y, w, h = (b[n] for n in XYWH)
    return box(XYXY, [x, y, x + w, y + h])


def to_xywh(b: Column) -> Column:
    x1, y1, x2, y2 = (b[n] for n in XYXY)
    return box(XYWH, [x1, y1, x2 - x1, y2 - y1])


def scaled(b: Column, factor: float, fmt: str = "xywh") -> Column:
    names = XYWH if fmt == "xywh" else XYXY
    return box(names, [b[n] * F.lit(float(factor)) for n in names])


def _within(v: Column, top: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(v, top))


def clipped(b: Column, width: float, height: float, fmt: str = "xywh") -> Column:
    """Cut a box to the image; in corner form only the far corner may lie on the border."""
    wide, high = F.lit(float(width)), F.lit(float(height))
    if fmt == "xywh":
        x, y = _within(b["x"], wide - 1), _within(b["y"], high - 1)
        return box(XYWH, [x, y, F.least(b["w"], wide - x), F.least(b["h"], high - y)])
    return box(
        XYXY,
        [_within(b["x1"], wide - 1), _within(b["y1"], high - 1), _within(b["x2"], wide), _within(b["y2"], high)],
    )


def is_valid(b: Column, fmt: str = "xywh") -> Column:
    if fmt == "xywh":
        good = (b["w"] > 0) & (b["h"] > 0)
    else:
        good = (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])
    return F.coalesce(good, F.lit(False))


def iou(a: Column, b: Column, fmt: str = "xywh") -> Column:
    """Overlap over union; 0 for boxes apart and for an empty union."""
    p, q = (to_xyxy(a), to_xyxy(b)) if fmt == "xywh" else (a, b)
    across = F.least(p["x2"], q["x2"]) - F.greatest(p["x1"], q["x1"])
    down = F.least(p["y2"], q["y2"]) - F.greatest(p["y1"], q["y1"])
    inter = across * down
    union = (
        (p["x2"] - p["x1"]) * (p["y2"] - p["y1"]) + (q["x2"] - q["x1"]) * (q["y2"] - q["y1"]) - inter
    )
    return F.when((across < 0) | (down < 0) | (union == 0), F.lit(0.0)).otherwise(inter / union)


def convert_boxes(
    tracks: DataFrame, op: str, col: str = "box", out: str | None = None, fmt: str = "xywh",
    factor: float = 1.0, width: float = 0.0, height: float = 0.0,
) -> DataFrame:
    """One box operation over a table: to_xyxy, to_xywh, normalize, scale, clip or valid."""
    b = F.col(col)
    made = {
        "to_xyxy": lambda: to_xyxy(b),
        "to_xywh": lambda: to_xywh(b),
        "normalize": lambda: to_xyxy(b) if fmt == "xywh" else b,
        "scale": lambda: scaled(b, factor, fmt),
        "clip": lambda: clipped(b, width, height, fmt),
        "valid": lambda: is_valid(b, fmt),
    }
    if op not in made:
        raise ValueError(f"unknown box operation: {op}")
    return tracks.withColumn(out or col, made[op]())


def pair_iou(pairs: DataFrame, fmt: str = "xywh", a: str = "box_a", b: str = "box_b", out: str = "iou") -> DataFrame:
    """Overlap of two box columns."""
    return pairs.withColumn(out, iou(F.col(a), F.col(b), fmt))
