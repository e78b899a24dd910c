"""Driver-side geometry: affine maps, sizes and slices. Points are (x, y); sizes are (width, height)."""

from __future__ import annotations

import math
from dataclasses import dataclass


class CoordinateCompatibilityError(ValueError):
    """Parts that must share a size don't."""


@dataclass(frozen=True)
class Affine:
    """x' = a x + b y + c, y' = d x + e y + f."""

    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 1.0
    f: float = 0.0

    @staticmethod
    def scale(sx: float, sy: float | None = None) -> Affine:
        return Affine(a=float(sx), e=float(sx if sy is None else sy))

    @staticmethod
    def translate(tx: float, ty: float) -> Affine:
        return Affine(c=float(tx), f=float(ty))

    @staticmethod
    def of(value=None, **parts) -> Affine:
        """From None, a map, nested or flat numbers, or named parts: scale, offset, theta, shearx, about."""
        if isinstance(value, Affine):
            return value
        if isinstance(value, dict):
            parts, value = {**value, **parts}, None
        if value is not None:
            flat = [float(v) for row in value for v in (row if hasattr(row, "__len__") else (row,))]
            return Affine(*flat[:6])
        both = lambda v: (float(v), float(v)) if not hasattr(v, "__len__") else (float(v[0]), float(v[1]))
        sx, sy = both(parts.get("scale", 1.0))
        tx, ty = both(parts.get("offset", 0.0))
        theta, shear = float(parts.get("theta", 0.0)), float(parts.get("shearx", 0.0))
        cos, sin = math.cos(theta), math.sin(theta)
        turned = Affine(sx * cos, sy * (shear * cos - sin), 0.0, sx * sin, sy * (shear * sin + cos), 0.0)
        if parts.get("about") is not None:
            px, py = both(parts["about"])
            turned = Affine.translate(px, py) @ turned @ Affine.translate(-px, -py)
        return Affine.translate(tx, ty) @ turned

    def __matmul__(self, o: Affine) -> Affine:
        return Affine(
            self.a * o.a + self.b * o.d, self.a * o.b + self.b * o.e, self.a * o.c + self.b * o.f + self.c,
            self.d * o.a + self.e * o.d, self.d * o.b + self.e * o.e, self.d * o.c + self.e * o.f + self.f,
        )

    def __call__(self, x, y):
        return self.a * x + self.b * y + self.c, self.d * x + self.e * y + self.f

    def inverse(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("the map can't be inverted")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -(a * self.c + b * self.f), d, e, -(d * self.c + e * self.f))

    def matrix(self) -> list[list[float]]:
        return [[self.a, self.b, self.c], [self.d, self.e, self.f], [0.0, 0.0, 1.0]]

    def decompose(self) -> dict:
        """offset, scale, shearx and theta, such that Affine.of(**parts) is the map again."""
        theta, sx = math.atan2(self.d, self.a), math.hypot(self.a, self.d)
        cos, sin = math.cos(theta), math.sin(theta)
        sheared, sy = self.b * cos + self.e * sin, self.e * cos - self.b * sin
        return {"offset": (self.c, self.f), "scale": (sx, sy), "shearx": sheared / sy if sy else 0.0, "theta": theta}

    @property
    def scales(self) -> tuple[float, float]:
        return self.decompose()["scale"]

    def near(self, o: Affine, eps: float = 0.0) -> bool:
        return all(abs(p - q) <= eps + eps * abs(q) for p, q in zip(self.row(), o.row(), strict=True))

    def row(self) -> tuple[float, ...]:
        return (self.a, self.b, self.c, self.d, self.e, self.f)

    @property
    def aligned(self) -> bool:
        """No rotation, shear or mirror."""
        return abs(self.b) < 1e-9 and abs(self.d) < 1e-9 and self.a > 0 and self.e > 0

    @property
    def whole_shift(self) -> bool:
        return self.near(Affine(c=self.c, f=self.f)) and self.c == int(self.c) and self.f == int(self.f)


IDENTITY = Affine()


def auto_dsize(m: Affine, dsize: tuple[int, int]) -> tuple[int, int]:
    """The canvas from the origin that holds the mapped image; nothing left or above of the origin counts."""
    w, h = dsize
    corners = [m(x, y) for x, y in ((0, 0), (w, 0), (0, h), (w, h))]
    up = lambda v: max(0, math.ceil(round(v, 9)))
    return up(max(c[0] for c in corners)), up(max(c[1] for c in corners))


def level_dsize(dsize: tuple[int, int], k: int) -> tuple[int, int]:
    return -(-dsize[0] // 2**k), -(-dsize[1] // 2**k)


def level_for(m: Affine, levels: int) -> int:
    """How many pyramid levels a downscaling map can skip."""
    sx, sy = m.scales
    if levels <= 0 or sx > 0.5 or sy > 0.5 or max(sx, sy) <= 0:
        return 0
    return min(levels, int(math.log2(1 / max(sx, sy)) + 1e-9))


def as_slice(part, size: int) -> tuple[int, int]:
    """[start, stop) inside 0..size: a negative start is 0, a negative stop counts from the end, no step."""
    if isinstance(part, int):
        part = slice(part, part + 1)
    if part is None:
        return 0, size
    if part.step is not None:
        raise ValueError("slices with a step aren't windows")
    start = 0 if part.start is None else max(0, part.start)
    stop = size if part.stop is None else part.stop
    stop = max(0, size + stop) if stop < 0 else min(stop, size)
    start = min(start, size)
    return start, max(start, stop)


class _MakeSlice:
    def __getitem__(self, index):
        return index


mkslice = _MakeSlice()
