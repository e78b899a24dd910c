"""From raster nodes to DataFrames. Catalyst does the rest: pruning, pushdown, join strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import combine, select
from ..operators.resample import grid, resample
from .nodes import Concat, Crop, Dequantize, Load, Nans, Overview, Raster, Warp


Window = tuple[int, int, int, int]


def _within(frame: DataFrame, node: Raster, window: Window | None) -> DataFrame:
    """The rows of a window, by a filter on stored coordinates; none where the window is the whole node."""
    if window is None:
        return frame
    (x0, y0, x1, y1), (w, h) = window, node.dsize
    for name, low, high, size in (("y", y0, y1, h), ("x", x0, x1, w)):
        frame = frame.where(F.col(name) >= low) if low > 0 else frame
        frame = frame.where(F.col(name) < high) if high < size else frame
    return frame


def lower(node: Raster, spark: SparkSession, window: Window | None = None) -> DataFrame:
    """``window``: no more of the node than x0, y0, x1, y1 is needed, so that scans may skip the rest."""
    if isinstance(node, Load):
        frame = node.rows_of(window[1], window[3]) if node.rows_of and window else node.frame
        return _within(frame, node, window).select("y", "x", *select.quoted(node.channels))
    if isinstance(node, Nans):
        empty = F.lit(float("nan")) if node.method == "float" else F.lit(None).cast("smallint")
        return grid(spark, node.size).select("y", "x", *[empty.alias(b) for b in node.bands])
    if isinstance(node, Crop):
        x0, y0, x1, y1 = window or (0, 0, *node.dsize)
        needed = (node.x0 + x0, node.y0 + y0, min(node.x1, node.x0 + x1), min(node.y1, node.y0 + y1))
        return select.crop(lower(node.child, spark, needed), node, node.channels)
    if isinstance(node, Dequantize):
        frame, q = lower(node.child, spark, window), node.quantization
        return frame if q is None else frame.select("y", "x", *[q.dequantize(F.col(f"`{b}`")).alias(b) for b in node.channels])
    if isinstance(node, Overview):
        leaf, k = node.child, node.level
        stored = min(k, leaf.num_overviews) if isinstance(leaf, Load) else 0
        if stored == k:
            return _within(leaf.levels[k - 1], node, window).select("y", "x", *select.quoted(node.channels))
        below = tuple(v << (k - stored) for v in window) if window else None
        if stored:
            return select.decimate(leaf.levels[stored - 1], k - stored, node.channels)
        return select.decimate(lower(leaf, spark, below), k, node.channels)
    if isinstance(node, Warp):
        return resample(node, lower(node.child, spark, node.window), spark)
    if isinstance(node, Concat):
        return combine.stack([lower(p, spark) for p in node.parts])
    raise TypeError(type(node).__name__)
