"""Resampling of pixel relations by affine maps.

Without rotation or shear, output columns depend on source columns alone and rows on rows. Nearest neighbours
need no sum and so no shuffle at all. For the other kernels each source pixel goes once to the tile, seldom to the
tiles, of output pixels that it helps to make, and a tile is the product of its source pixels with each axis's
weights. An axis so shrunk that the taps of a few output pixels overfill a tile is cut into runs of source pixels
instead, whose partial sums a sum by output pixel finishes. Other maps look up the source pixels of each output
pixel by an equi-join on (y, x).

Pixel centres: nearest with a pure scale and all other kernels put pixel i's centre at i + 1/2; nearest with
a translation takes the output pixel's corner, floor((X - t) / s). A missing source pixel (NULL) makes every
output pixel that needs it a border pixel; taps of no weight don't count. A source relation is dense: pixels
without a row are treated as outside.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..geometry import Affine
from ..plans.nodes import Warp, stretch, support
from . import tiles
from .tiles import TINY


def grid(spark: SparkSession, dsize: tuple[int, int]) -> DataFrame:
    """(y, x) of every pixel of a canvas."""
    w, h = dsize
    return spark.range(w * h).selectExpr(f"id div {max(w, 1)} as y", f"id % {max(w, 1)} as x")


def fill_value(border, kind: str) -> Column:
    """The border of a band: NaN for measured bands, 0 for whole numbers, or what is asked for ('null', a number)."""
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    if border == "auto":
        return F.lit(0).cast(kind) if whole else F.lit(float("nan")).cast(kind)
    return F.lit(None).cast(kind) if border in (None, "null") else F.lit(border).cast(kind)


def weight(kernel: str, d: Column, wide: float) -> Column:
    """Weight of a pixel at a distance d from the sampled point, in source pixels; ``wide`` stretches the kernel."""
    t = F.abs(d) / F.lit(wide) if wide != 1.0 else F.abs(d)
    if kernel == "linear":
        w = F.greatest(F.lit(1.0) - t, F.lit(0.0))
    elif kernel == "area":
        w = F.when(d / F.lit(wide) < -0.5, 0.0).when(d / F.lit(wide) >= 0.5, 0.0).otherwise(1.0)
    elif kernel == "cubic":  # Keys, a = -1/2
        w = F.when(t < 1, (1.5 * t - 2.5) * t * t + 1).when(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2).otherwise(0.0)
    elif kernel == "lanczos":
        x = t * math.pi
        w = F.when(t < 1e-12, 1.0).when(t < 4, 4 * F.sin(x) * F.sin(x / 4) / (x * x)).otherwise(0.0)
    else:
        raise KeyError(kernel)
    return F.when(F.abs(w) < TINY, 0.0).otherwise(w)


class Axis:
    """One axis of an aligned map: output index I (from ``first`` on, ``count`` of them) against source index i < n."""

    def __init__(self, node: Warp, vertical: bool):
        m, k = node.transform, int(vertical)
        self.s, self.t = (m.e, m.f) if vertical else (m.a, m.c)
        self.first, self.count, self.n = node.offset[k], node.size[k], node.child.dsize[k]
        self.kernel, self.wide = node.interpolation, stretch(node)[k]
        shifted = abs(m.c) > TINY or abs(m.f) > TINY
        self.half = 0.0 if shifted and self.kernel == "nearest" else 0.5
        self.pure = self.kernel == "nearest" and not shifted

    def at(self, out: Column) -> Column:
        """Where in the source an output index samples."""
        return (out.cast("double") + F.lit(self.first + self.half) - F.lit(self.t)) / F.lit(self.s)

    def nearest(self, out: Column) -> Column:
        at = F.floor(self.at(out)).cast("bigint")
        if not self.pure:
            return at
        # The last output pixel of a scaled image may be a part of one: it shows the last source pixel.
        return F.when(out + self.first < math.ceil(self.n * self.s - TINY), F.least(at, F.lit(self.n - 1))).otherwise(at)

    def reach(self) -> float:
        return 0.5 if self.kernel == "nearest" else support(self.kernel) * self.wide

    def bounds(self, source: Column) -> tuple[Column, Column]:
        """The first and the last output index, clipped to the canvas, that a source index may serve."""
        r = self.reach() + 1
        low = F.floor((source - r) * self.s + self.t).cast("bigint") - 1 - self.first
        high = F.ceil((source + 1 + r) * self.s + self.t).cast("bigint") + 1 - self.first
        return F.greatest(low, F.lit(0)), F.least(high, F.lit(self.count - 1))

    def outputs(self, source: Column) -> Column:
        """All output indexes that a source index may serve; some may not be served."""
        low, high = self.bounds(source)
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))

    def served(self, out: Column) -> Column:
        """Whether an output index samples inside the source by nearest neighbour."""
        return self.nearest(out).between(0, self.n - 1)

    def weight(self, out: Column, source: Column) -> Column:
        return weight(self.kernel, source.cast("double") + 0.5 - self.at(out), self.wide)

    def whole(self, out: Column) -> Column:
        """The sum of all weights of an output index, inside the source or not."""
        if self.kernel == "linear" and self.wide == 1.0:
            return F.lit(1.0)
        low = F.floor(self.at(out) - self.reach() - 1).cast("bigint")
        taps = F.sequence(low, low + math.ceil(2 * self.reach()) + 3)
        return F.aggregate(taps, F.lit(0.0), lambda a, i: a + self.weight(out, i))

    def cut(self, side: int, most: int) -> tiles.Cut:
        return tiles.Cut(self.kernel, self.s, self.t, self.first, self.count, self.n, self.wide, self.reach(), side, most)

    def tiles(self, cut: tiles.Cut, source: Column) -> Column:
        """The tiles that a source index goes to."""
        if not cut.whole:
            return F.array(F.floor(source / cut.step).cast("bigint"))
        low, high = (F.floor(c / cut.step).cast("bigint") for c in self.bounds(source))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def _inside(node: Warp, px: Column, py: Column, pixel: float = 0.0) -> Column:
    """Whether a point of the source, or a pixel around it, survives the crops between fused maps."""
    ok = F.lit(True)
    for m, x0, y0, x1, y1 in node.clips:
        qx, qy = m.a * px + m.b * py + m.c, m.d * px + m.e * py + m.f
        rx, ry, eps = pixel * (abs(m.a) + abs(m.b)), pixel * (abs(m.d) + abs(m.e)), TINY if pixel == 0 else -TINY
        ok = ok & (qx + (rx + eps) >= x0) & (qx - (rx - TINY) < x1) & (qy + (ry + eps) >= y0) & (qy - (ry - TINY) < y1)
    return ok


def _masked(node: Warp, source: DataFrame, bands: list[str]) -> DataFrame:
    """Source rows in the window; what clips cut off becomes missing."""
    if node.window:
        x0, y0, x1, y1 = node.window
        source = source.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))
    if node.interpolation == "nearest" or not node.clips:
        return source
    return source.where(_inside(node, F.col("x") + 0.5, F.col("y") + 0.5, 0.5))


def _aligned_nearest(node: Warp, source: DataFrame, bands: list[str], spark: SparkSession) -> DataFrame:
    ys, xs = Axis(node, True), Axis(node, False)
    cols = [F.col(f"`{b}`") for b in bands]
    hit = source.select(F.col("y").alias("__sy"), "x", *cols, F.explode(ys.outputs(F.col("y"))).alias("y"))
    hit = hit.where(ys.nearest(F.col("y")) == F.col("__sy")).withColumnRenamed("x", "__sx")
    hit = hit.select("y", "__sx", *cols, F.explode(xs.outputs(F.col("__sx"))).alias("x"))
    ok = _inside(node, xs.at(F.col("x")), ys.at(F.col("y")))
    hit = hit.where((xs.nearest(F.col("x")) == F.col("__sx")) & ok).select("y", "x", *cols)
    kinds = dict(source.dtypes)
    fills = {b: fill_value(node.border_value, kinds[b]) for b in bands}
    rim = grid(spark, node.size).where(~(ys.served(F.col("y")) & xs.served(F.col("x")) & ok))
    return hit.unionByName(rim.select("y", "x", *[fills[b].alias(b) for b in bands]))


def _finished(node: Warp, summed: DataFrame, bands: list[str], kinds: dict, whole: Column) -> DataFrame:
    """Bands from their sums: the border where weight is missing, else the weighted mean."""
    out = []
    for i, b in enumerate(bands):
        fill = fill_value(node.border_value, "double")
        full = F.abs(F.col(f"__w{i}") - whole) < 1e-6
        part = F.lit(None).cast("double") if node.border_value in ("auto", None, "null") else (F.col(f"__v{i}") + (whole - F.col(f"__w{i}")) * fill) / whole
        part = fill if node.border_value in ("auto",) and kinds[b] in ("float", "double") else part
        if node.border_value == "auto" and kinds[b] not in ("float", "double"):
            part = F.col(f"__v{i}") / whole
        out.append(F.when(full, F.col(f"__v{i}") / whole).otherwise(part).alias(b))
    return summed.select("y", "x", *out)


def _sums(bands: list[str], w: Column) -> list[Column]:
    out = []
    for i, b in enumerate(bands):
        known = F.col(f"`{b}`").isNotNull()
        out += [F.sum(F.when(known, w * F.col(f"`{b}`").cast("double"))).alias(f"__v{i}"), F.sum(F.when(known, w)).alias(f"__w{i}")]
    return out


def _aligned_kernel(node: Warp, source: DataFrame, bands: list[str], spark: SparkSession) -> DataFrame:
    ys, xs = Axis(node, True), Axis(node, False)
    kinds, n = dict(source.dtypes), len(bands)
    held = max(tiles.HELD // max(n, 1), 64)
    across = xs.cut(math.isqrt(held), math.isqrt(tiles.MADE))
    down = ys.cut(held // across.held(), min(max(tiles.MADE // across.step, 1), 2 * math.isqrt(tiles.MADE)))
    keyed = source.select(F.col("y").cast("bigint").alias("__sy"), F.col("x").cast("bigint").alias("__sx"), *[F.col(f"`{b}`").cast("double").alias(f"__b{i}") for i, b in enumerate(bands)])
    keyed = keyed.where(F.col("__sy").between(0, ys.n - 1) & F.col("__sx").between(0, xs.n - 1))
    keyed = keyed.withColumn("__ty", F.explode(ys.tiles(down, F.col("__sy")))).withColumn("__tx", F.explode(xs.tiles(across, F.col("__sx"))))
    whole = down.whole and across.whole
    if whole:  # also tiles that no source pixel goes to make their pixels
        every = grid(spark, (across.tiles, down.tiles)).select(F.col("y").alias("__ty"), F.col("x").alias("__tx"))
        keyed = keyed.unionByName(every, allowMissingColumns=True)
    names = ["y", "x", "__whole", *[f"__{c}{i}" for i in range(n) for c in "vw"]]
    kind = "y bigint, x bigint, " + ", ".join(f"{c} double" for c in names[2:])
    made = keyed.groupBy("__ty", "__tx").applyInArrow(tiles.maker(down, across, n, names), kind)
    if whole:
        return _finished(node, made, bands, kinds, F.col("__whole"))
    # Pixels without any tap inside the source come from the canvas itself, with no weight.
    rim = grid(spark, node.size).select("y", "x", *[F.lit(0.0).alias(c) for c in names[3:]])
    made = made.drop("__whole").unionByName(rim).groupBy("y", "x").agg(*[F.sum(c).alias(c) for c in names[3:]])
    return _finished(node, made, bands, kinds, ys.whole(F.col("y")) * xs.whole(F.col("x")))


def _general(node: Warp, source: DataFrame, bands: list[str], spark: SparkSession) -> DataFrame:
    back: Affine = node.transform.inverse()
    kinds = dict(source.dtypes)
    ox, oy = node.offset
    cx, cy = F.col("x").cast("double") + (ox + 0.5), F.col("y").cast("double") + (oy + 0.5)
    at = grid(spark, node.size).withColumns({"__px": back.a * cx + back.b * cy + back.c, "__py": back.d * cx + back.e * cy + back.f})
    cols = [F.col(f"`{b}`") for b in bands]
    keyed = source.select(F.col("y").alias("__sy"), F.col("x").alias("__sx"), *cols)
    if node.interpolation == "nearest":
        ok = _inside(node, F.col("__px"), F.col("__py"))
        at = at.withColumns({"__sx": F.when(ok, F.floor("__px").cast("bigint")), "__sy": F.floor("__py").cast("bigint")})
        met = at.join(keyed.withColumn("__met", F.lit(True)), ["__sy", "__sx"], "left")
        out = [F.when(F.col("__met"), F.col(f"`{b}`")).otherwise(fill_value(node.border_value, kinds[b])).alias(b) for b in bands]
        return met.select("y", "x", *out)
    wide = max(stretch(node))
    r = support(node.interpolation) * wide
    span = lambda p: F.sequence(F.floor(p - r - 0.5).cast("bigint"), F.ceil(p + r - 0.5).cast("bigint"))
    taps = at.withColumn("__sy", F.explode(span(F.col("__py")))).withColumn("__sx", F.explode(span(F.col("__px"))))
    w = weight(node.interpolation, F.col("__sy") + 0.5 - F.col("__py"), wide) * weight(node.interpolation, F.col("__sx") + 0.5 - F.col("__px"), wide)
    taps = taps.withColumn("__w", w).where("__w <> 0")
    met = taps.join(keyed, ["__sy", "__sx"], "left")
    summed = met.groupBy("y", "x").agg(F.sum("__w").alias("__whole"), *_sums(bands, F.col("__w")))
    summed = summed.na.fill(0.0, [f"__{c}{i}" for i in range(len(bands)) for c in "vw"])
    return _finished(node, summed, bands, kinds, F.col("__whole"))


def resample(node: Warp, source: DataFrame, spark: SparkSession) -> DataFrame:
    bands = list(node.channels)
    if 0 in node.size:
        return source.limit(0)
    source = _masked(node, source, bands)
    if not node.transform.aligned:
        return _general(node, source, bands, spark)
    return (_aligned_nearest if node.interpolation == "nearest" else _aligned_kernel)(node, source, bands, spark)
