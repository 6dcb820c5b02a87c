"""Boxes (x, y, w, h) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def right(x: Column, w: Column) -> Column:
    return x + w


def is_valid(x: Column, y: Column, w: Column, h: Column) -> Column:
    return (x >= 0) & (y >= 0) & (w > 0) & (h > 0)


def overlap_area(a: str, b: str) -> Column:
    """Common area of the boxes under two aliases; 0 if they only touch."""
    c = lambda t, k: F.col(f"{t}.{k}")
    wide = F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x"))
    tall = F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y"))
    return F.greatest(wide, F.lit(0)).cast("long") * F.greatest(tall, F.lit(0)).cast("long")


def overlaps(a: str, b: str) -> Column:
    c = lambda t, k: F.col(f"{t}.{k}")
    return (
        (c(a, "x") < c(b, "x") + c(b, "w")) & (c(b, "x") < c(a, "x") + c(a, "w"))
        & (c(a, "y") < c(b, "y") + c(b, "h")) & (c(b, "y") < c(a, "y") + c(a, "h"))
    )


def iou(a: str, b: str) -> Column:
    area = lambda t: (F.col(f"{t}.w") * F.col(f"{t}.h")).cast("long")
    common = overlap_area(a, b)
    return common / (area(a) + area(b) - common)


def union_of(x: str = "x", y: str = "y", w: str = "w", h: str = "h") -> list[Column]:
    """Aggregates for the smallest box around all, at least 1 wide and high."""
    left, top = F.min(x), F.min(y)
    return [
        left.alias("x"), top.alias("y"),
        F.greatest(F.lit(1), F.max(F.col(x) + F.col(w)) - left).alias("w"), F.greatest(F.lit(1), F.max(F.col(y) + F.col(h)) - top).alias("h"),
    ]


def scaled(x0: Column, y0: Column, x1: Column, y1: Column, dpi: int) -> list[Column]:
    """Point coordinates as pixels: truncated, from 0, and at least 1 wide and high."""
    px = lambda c: (c * dpi / 72).cast("int")
    x, y = F.greatest(F.lit(0), px(x0)), F.greatest(F.lit(0), px(y0))
    return [x.alias("x"), y.alias("y"), F.greatest(F.lit(1), px(x1) - px(x0)).alias("w"), F.greatest(F.lit(1), px(y1) - px(y0)).alias("h")]


def padded_crop(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: int = 2) -> list[Column]:
    """Left, top, right and bottom of a crop with padding inside the image."""
    return [
        F.greatest(F.lit(0), x - pad).alias("left"), F.greatest(F.lit(0), y - pad).alias("top"),
        F.least(width, x + w + pad).alias("right"), F.least(height, y + h + pad).alias("bottom"),
    ]
