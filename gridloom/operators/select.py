"""Windows, bands and pyramid levels of pixel relations: filters and projections only, so no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quoted(names) -> list[str]:
    return [f"`{n}`" for n in names]


def crop(frame: DataFrame, window, bands) -> DataFrame:
    """The window y0, y1, x0, x1, moved to the origin. The filter names stored columns, so scans can skip."""
    y0, y1, x0, x1, (w, h) = window.y0, window.y1, window.x0, window.x1, window.child.dsize
    for name, low, high, size in (("y", y0, y1, h), ("x", x0, x1, w)):
        frame = frame.where(F.col(name) >= low) if low > 0 else frame
        frame = frame.where(F.col(name) < high) if high < size else frame
    moved = [(F.col(c) - by).alias(c) if by else F.col(c) for c, by in (("y", y0), ("x", x0))]
    return frame.select(*moved, *quoted(bands))


def decimate(frame: DataFrame, k: int, bands) -> DataFrame:
    """Every 2^k-th pixel of every 2^k-th row: a pyramid level where none is stored."""
    step = 2**k
    kept = frame.where((F.col("y") % step == 0) & (F.col("x") % step == 0))
    return kept.select(F.expr(f"y div {step}").alias("y"), F.expr(f"x div {step}").alias("x"), *quoted(bands))
