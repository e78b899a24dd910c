"""Tiles of an aligned resampling: plain arrays in Python workers. Functions travel to them by value, as nothing of
this package need be installed there."""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TINY = 1e-9
#: Source pixels times bands that a tile holds at most, and how many output pixels.
HELD, MADE = 1 << 20, 1 << 16
#: Up to so many taps an output pixel, they are summed one by one.
FEW = 256


def weights(kernel: str, d: np.ndarray, wide: float) -> np.ndarray:
    """Weights of pixels at distances d from the sampled points, in source pixels; ``wide`` stretches the kernel."""
    t = np.abs(d) / wide
    if kernel == "linear":
        w = np.maximum(1.0 - t, 0.0)
    elif kernel == "area":
        w = ((d / wide >= -0.5) & (d / wide < 0.5)).astype(float)
    elif kernel == "cubic":  # Keys, a = -1/2
        w = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))
    elif kernel == "lanczos":
        x = np.maximum(t, 1e-12) * math.pi
        w = np.where(t < 1e-12, 1.0, np.where(t < 4, 4 * np.sin(x) * np.sin(x / 4) / (x * x), 0.0))
    else:
        raise KeyError(kernel)
    return np.where(np.abs(w) < TINY, 0.0, w)


class Cut:
    """One axis cut into tiles that hold at most ``side`` source indexes and make ``most`` output indexes.

    Output index I (from ``first`` on, ``count`` of them) samples the source, of ``n`` indexes, at (I + 1/2 - t) / s.
    A tile is a run of output indexes (``whole``), or of source indexes where so few of the former have their taps
    in ``side`` that source pixels would go to many tiles.
    """

    def __init__(self, kernel: str, s: float, t: float, first: int, count: int, n: int, wide: float, reach: float, side: int, most: int):
        self.kernel, self.s, self.t, self.first, self.count, self.n = kernel, s, t, first, count, n
        self.wide, self.reach = wide, reach
        room = (side - 4 - 2 * reach) * s
        fit = count if n <= side else int(room) + 1 if room >= 0 else 0
        self.whole = fit >= min(count, 2 * reach / wide)
        along, step = (count, min(fit, most)) if self.whole else (n, side)
        self.tiles = max(1, math.ceil(along / step))
        self.step = max(1, math.ceil(along / self.tiles))

    def point(self, out):
        return (out + (self.first + 0.5) - self.t) / self.s

    def held(self) -> int:
        """How many source indexes a tile holds at most."""
        return max(1, min(self.n, math.ceil(self.step / self.s + 2 * self.reach) + 4 if self.whole else self.step))

    def span(self, tile: int) -> tuple[int, int, int, int]:
        """A tile's output indexes, from and to, and its source indexes."""
        o0 = i0 = tile * self.step
        r = self.reach + 1
        if self.whole:
            o1 = min(self.count, o0 + self.step)
            i0, i1 = max(0, math.floor(self.point(o0) - r)), min(self.n, math.ceil(self.point(o1 - 1) + r))
        else:
            i1 = min(self.n, i0 + self.step)
            o0 = max(0, math.floor((i0 - r) * self.s + self.t) - 1 - self.first)
            o1 = min(self.count, math.ceil((i1 + r) * self.s + self.t) + 2 - self.first)
        return o0, max(o0, o1), i0, max(i0, i1)

    def taps(self, o0: int, o1: int) -> tuple[np.ndarray, np.ndarray]:
        """Source indexes, inside the source or not, that output indexes may need, and their weights."""
        at = self.point(np.arange(o0, o1, dtype=float))[:, None]
        index = np.ceil(at - self.reach - 0.5 - 1e-6).astype(np.int64) + np.arange(math.floor(2 * self.reach + 2e-6) + 1)
        return index, weights(self.kernel, index + 0.5 - at, self.wide)

    def matrix(self, o0: int, o1: int, i0: int, i1: int) -> np.ndarray:
        """Weights of source indexes in output indexes."""
        return weights(self.kernel, np.arange(i0, i1) + 0.5 - self.point(np.arange(o0, o1, dtype=float))[:, None], self.wide)


def product(wy: np.ndarray, pixels: np.ndarray, wx: np.ndarray) -> np.ndarray:
    """Weighted sums of pixels where infinity and NaN, unlike in a matrix product, count only with some weight."""
    odd = ~np.isfinite(pixels)
    if not odd.any():
        return wy @ pixels @ wx.T
    made = wy @ np.where(odd, 0.0, pixels) @ wx.T
    many = np.abs(np.sign(wy)) @ odd.astype(float) @ np.abs(np.sign(wx)).T
    net = np.sign(wy) @ np.where(np.isinf(pixels), np.sign(pixels), 0.0) @ np.sign(wx).T
    return np.where(many < 0.5, made, np.where(net > many - 0.5, np.inf, np.where(net < 0.5 - many, -np.inf, np.nan)))


def summed(iy: np.ndarray, wy: np.ndarray, pixels: np.ndarray, ix: np.ndarray, wx: np.ndarray) -> np.ndarray:
    """The same, tap by tap, with the products of the definition: their sum rounds as it does."""
    padded = np.pad(pixels, ((0, 1), (0, 1)))  # for taps outside
    finite = np.isfinite(pixels).all()
    made = np.zeros((len(iy), len(ix)))
    columns = [padded.take(i, axis=1) for i in ix.T]
    with np.errstate(invalid="ignore"):
        for i, w in zip(iy.T, wy.T, strict=True):
            for column, v in zip(columns, wx.T, strict=True):
                both = np.outer(w, v)
                part = both * column.take(i, axis=0)
                made += part if finite else np.where(both == 0, 0.0, part)
    return made


def maker(ys: Cut, xs: Cut, bands: int, names: list[str]):
    """Makes a tile's output pixels, with the sums and the known weights of each band, from rows of source pixels."""

    def make(key: tuple, rows: pa.Table) -> pa.Table:
        (a0, a1, i0, i1), (b0, b1, j0, j1) = ys.span(key[0].as_py()), xs.span(key[1].as_py())
        ny, nx, whole = i1 - i0, j1 - j0, np.zeros((a1 - a0, b1 - b0))
        sums = None
        if ys.whole and xs.whole:
            (iy, wy), (ix, wx) = ys.taps(a0, a1), xs.taps(b0, b1)
            whole = np.outer(wy.sum(1), wx.sum(1))
            if wy.shape[1] * wx.shape[1] <= FEW:
                iy, ix = np.where((iy >= i0) & (iy < i1), iy - i0, ny), np.where((ix >= j0) & (ix < j1), ix - j0, nx)
                sums = lambda pixels: summed(iy, wy, pixels, ix, wx)
        my, mx = ys.matrix(a0, a1, i0, i1), xs.matrix(b0, b1, j0, j1)
        sums = sums or (lambda pixels: product(my, pixels, mx))
        y, x = (rows.column(c).combine_chunks().fill_null(-1).to_numpy() for c in ("__sy", "__sx"))
        inside = (y >= i0) & (y < i1) & (x >= j0) & (x < j1)
        place = (y - i0) * nx + (x - j0)
        made = [np.repeat(np.arange(a0, a1), b1 - b0), np.tile(np.arange(b0, b1), a1 - a0), whole.ravel()]
        for i in range(bands):
            column = rows.column(f"__b{i}").combine_chunks()
            known = inside & column.is_valid().to_numpy(zero_copy_only=False)
            values = column.to_numpy(zero_copy_only=False)[known]
            pixels = np.bincount(place[known], values, ny * nx).reshape(ny, nx)
            there = np.bincount(place[known], minlength=ny * nx).reshape(ny, nx).astype(float)
            made += [sums(pixels).ravel(), (my @ there @ mx.T).ravel()]
        return pa.table([pa.array(c) for c in made], names=names)

    return make
