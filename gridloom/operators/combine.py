"""Stacks of bands: pixel relations joined on their coordinates, one to one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def stack(frames: list[DataFrame]) -> DataFrame:
    """All bands of frames of one size. Band names must differ; a missing pixel in one part is NULL there."""
    names = [c for f in frames for c in f.columns if c not in ("y", "x")]
    if len(set(names)) < len(names):
        raise ValueError(f"bands of one name: {sorted({n for n in names if names.count(n) > 1})}")
    return reduce(lambda a, b: a.join(b, ["y", "x"], "full"), frames)


def append(frames: list[DataFrame], sizes: list[int], axis: str = "y") -> DataFrame:
    """Frames one below (or beside) the other: coordinates along the axis are moved by the sizes before."""
    out, at = [], 0
    for frame, size in zip(frames, sizes, strict=True):
        out.append(frame.withColumn(axis, frame[axis] + at))
        at += size
    return reduce(DataFrame.unionByName, out)
