"""Stateless raster operators on a stream of pixels: windows, bands and dequantizing need no other pixel."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.lower import lower
from ..plans.nodes import Crop, Dequantize, Load, Raster


def on_stream(raster: Raster) -> DataFrame:
    """The streaming pixel relation of a chain over a streaming leaf; resampling chains are refused."""
    best = raster.optimize()
    node = best
    while not isinstance(node, Load):
        if not isinstance(node, (Crop, Dequantize)):
            raise ValueError(f"{type(node).__name__} needs more than one pixel at a time")
        node = node.child
    return lower(best, node.frame.sparkSession)
