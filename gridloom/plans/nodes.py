"""The raster IR and its fluent interface. Nodes are immutable; nothing is read until a result is asked for.

A raster is a grid of pixels with named bands. Its relation is (y BIGINT, x BIGINT, one column a band); a
NULL is a masked pixel, a NaN a missing measured one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.channels import FusedChannelSpec
from ..functions.radiometry import Quantization
from ..geometry import IDENTITY, Affine, CoordinateCompatibilityError, as_slice, auto_dsize, level_dsize

KERNELS = ("nearest", "linear", "cubic", "lanczos", "area")


@dataclass(frozen=True)
class Raster:
    """Base of all nodes."""

    # what subclasses define
    @property
    def dsize(self) -> tuple[int, int]:
        raise NotImplementedError

    @property
    def channels(self) -> tuple[str, ...]:
        raise NotImplementedError

    def children(self) -> tuple[Raster, ...]:
        return ()

    @property
    def num_overviews(self) -> int:
        return 0

    # metadata
    @property
    def num_channels(self) -> int:
        return len(self.channels)

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.dsize[1], self.dsize[0], self.num_channels

    def prepare(self) -> Raster:
        """This node with the metadata of its leaves filled in."""
        return self._with_children([c.prepare() for c in self.children()])

    def _with_children(self, children: list[Raster]) -> Raster:
        if not children:
            return self
        return replace(self, parts=tuple(children)) if isinstance(self, Concat) else replace(self, child=children[0])

    # selection
    def crop(self, space_slice=None, chan_idxs=None, clip=True, wrap=True, pad=0, lazy=False) -> Raster:
        """A window, bands by position, or both. With clip=False, wrap=False it may leave the image by ``pad`` and more."""
        if clip != wrap:
            raise NotImplementedError("clip and wrap go together")
        ys, xs = space_slice if space_slice is not None else (slice(None), slice(None))
        bands = None if chan_idxs is None else tuple(range(self.num_channels)[i] for i in _indexes(chan_idxs, self.num_channels))
        w, h = self.dsize
        if clip and not pad:
            (y0, y1), (x0, x1) = as_slice(ys, h), as_slice(xs, w)
            if lazy and bands is None and (x0, y0, x1, y1) == (0, 0, w, h):
                return self
            return Crop(self, y0, y1, x0, x1, bands)
        bound = lambda s, n: (0 if s is None or s.start is None else s.start, n if s is None or s.stop is None else s.stop)
        py, px = (pad, pad) if isinstance(pad, int) else pad
        (y0, y1), (x0, x1) = bound(ys, h), bound(xs, w)
        y0, y1, x0, x1 = y0 - py, max(y1, y0) + py, x0 - px, max(x1, x0) + px
        inside = Crop(self, *as_slice(slice(0, None), h), *as_slice(slice(0, None), w), bands) if bands is not None else self
        return Warp(inside, Affine.translate(-x0, -y0), (x1 - x0, y1 - y0), "nearest")

    def __getitem__(self, index) -> Raster:
        if not isinstance(index, tuple) or len(index) not in (2, 3):
            raise TypeError("expected [rows, columns] or [rows, columns, bands]")
        bands = index[2] if len(index) == 3 else None
        bands = range(self.num_channels)[bands] if isinstance(bands, slice) else bands
        return self.crop(index[:2], bands)

    def take_channels(self, channels, missing_channel_policy: str = "return_nan", lazy: bool = False) -> Raster:
        """Bands by positions or by a channel spec; unknown names are NaN bands or an error, by policy."""
        if missing_channel_policy not in ("return_nan", "error"):
            raise KeyError(missing_channel_policy)
        if isinstance(channels, int) or (not isinstance(channels, str) and all(isinstance(c, int) for c in channels)):
            bands = tuple(range(self.num_channels)[c] for c in ([channels] if isinstance(channels, int) else channels))
            return self if lazy and bands == tuple(range(self.num_channels)) else self.crop(chan_idxs=bands)
        wanted, own = FusedChannelSpec.coerce(channels).normalize().codes, self.channels
        if not own:
            raise ValueError("the raster's channels have no names")
        if all(c in own for c in wanted):
            bands = tuple(own.index(c) for c in wanted)
            return self if lazy and wanted == own else self.crop(chan_idxs=bands)
        if missing_channel_policy == "error":
            raise ValueError(f"missing channels: {[c for c in wanted if c not in own]}")
        runs: list[tuple[bool, list[str]]] = []
        for c in wanted:
            if not runs or runs[-1][0] != (c in own):
                runs.append((c in own, []))
            runs[-1][1].append(c)
        return Concat(tuple(self.crop(chan_idxs=[own.index(c) for c in names]) if has else Nans(self.dsize, tuple(names)) for has, names in runs))

    # resampling
    def warp(self, transform=None, dsize="auto", interpolation="linear", antialias=True, border_value="auto", noop_eps=0.0, lazy=False, **parts) -> Raster:
        m = Affine.of(transform, **parts)
        size = auto_dsize(m, self.dsize) if dsize == "auto" else self.dsize if dsize is None else tuple(map(int, dsize))
        if lazy and m.near(IDENTITY) and size == self.dsize:
            return self
        if interpolation not in KERNELS:
            raise KeyError(interpolation)
        return Warp(self, m, size, interpolation, antialias, border_value, noop_eps)

    def scale(self, scale, dsize="auto", **kw) -> Raster:
        return self.warp({"scale": scale}, dsize, **kw)

    def resize(self, dsize, **kw) -> Raster:
        w, h = self.dsize
        return self.warp({"scale": (dsize[0] / w, dsize[1] / h)}, dsize, **kw)

    def get_overview(self, k: int) -> Raster:
        return Overview(self, k)

    def dequantize(self, quantization) -> Raster:
        node: Raster | None = self
        while node is not None:
            if isinstance(node, Dequantize) and node.quantization is not None:
                raise AssertionError("a raster is dequantized once")
            node = node.child if hasattr(node, "child") else None
        return Dequantize(self, Quantization.of(quantization))

    # coordinates
    def _to_parent(self) -> Affine:
        return IDENTITY

    def get_transform_from_leaf(self) -> Affine:
        kids = self.children()
        if len(kids) > 1:
            raise ValueError("a stack has one transform for each part")
        return self._to_parent() @ kids[0].get_transform_from_leaf() if kids else IDENTITY

    def get_transform_from(self, src: Raster) -> Affine:
        """The map from the pixels of src to those of this raster; both must share a leaf."""
        ours, theirs = dict(self.leaf_transforms()), dict(src.leaf_transforms())
        for leaf, m in ours.items():
            if leaf in theirs:
                return m @ theirs[leaf].inverse()
        raise ValueError("the rasters share no leaf")

    def leaf_transforms(self) -> Iterator[tuple[int, Affine]]:
        kids = self.children()
        if not kids:
            yield self.leaf_key, IDENTITY
        for kid in kids:
            for leaf, m in kid.leaf_transforms():
                yield leaf, self._to_parent() @ m

    def undo_warp(self, remove=None, retain=None, squash_nans=False, return_warp=False, **kw):
        """The raster in its leaf's resolution, but for the parts of the transform that are retained."""
        if remove is not None and retain is not None:
            raise ValueError("remove or retain, not both")
        parts = {"offset", "scale", "shearx", "theta"}
        kept = set(retain or ()) if remove is None else parts - set(remove)
        if kept - parts:
            raise KeyError(kept - parts)
        undo = self.get_transform_from_leaf().inverse()
        undo = Affine.of(**{k: v for k, v in undo.decompose().items() if k not in kept})
        out = self.warp(undo, **kw).optimize()
        if squash_nans and isinstance(out, Nans):
            out = replace(out, size=(1, 1))
        return (out, undo) if return_warp else out

    # results
    def optimize(self) -> Raster:
        from .planner import optimize

        return optimize(self)

    def with_params(self, **params) -> Raster:
        """A new tree in which every node that has one of the named parameters has the new value."""
        node = self._with_children([c.with_params(**params) for c in self.children()])
        own = {f.name for f in fields(node)}
        return replace(node, **{k: v for k, v in params.items() if k in own})

    def finalize(self, spark: SparkSession | None = None, optimize: bool = True, **params) -> DataFrame:
        """The pixel relation, lazily: no job runs but for metadata."""
        from .lower import lower

        node = self.with_params(**params).prepare()
        return lower(node.optimize() if optimize else node, spark or SparkSession.active())

    def evaluate(self, spark: SparkSession | None = None) -> Raster:
        """This raster computed once, as a table in the checkpoint folder, and a leaf for further work."""
        spark = spark or SparkSession.active()
        return Load(self.finalize(spark).checkpoint(), self.channels, self.dsize)

    def labelled(self, spark: SparkSession | None = None) -> DataFrame:
        """(y, x, c, v): one row a pixel and band, labelled by the band's name."""
        frame = self.finalize(spark)
        cols = [f"`{c}`" for c in self.channels]
        return frame.selectExpr("y", "x", *[f"cast({c} as double) as {c}" for c in cols]).unpivot(["y", "x"], list(cols), "c", "v")

    def to_array(self, spark: SparkSession | None = None):
        """A dense (height, width, bands) array on the driver; for small results."""
        import numpy as np

        rows = self.finalize(spark).toPandas()
        out = np.full(self.shape, np.nan)
        if len(rows):
            out[rows["y"], rows["x"]] = rows[list(self.channels)].astype(float).to_numpy()
        return out

    def validate(self) -> Raster:
        """Check that rewriting keeps size and bands; returns the rewritten tree."""
        best = self.optimize()
        if best.dsize != self.dsize or best.num_channels != self.num_channels:
            raise AssertionError(f"{self.dsize} {self.num_channels} became {best.dsize} {best.num_channels}")
        return best

    # inspection
    def nesting(self) -> dict:
        own = {f.name: getattr(self, f.name) for f in fields(self) if f.name not in ("child", "parts", "frame", "levels", "rows_of")}
        return {"type": type(self).__name__, **own, "children": [c.nesting() for c in self.children()]}

    def graph_rows(self) -> list[tuple[int, int | None, str, str]]:
        """(node, parent, operation, parameters) of the tree, parents first."""
        rows: list = []

        def visit(node, parent):
            at = len(rows)
            rows.append((at, parent, type(node).__name__, node._params()))
            for c in node.children():
                visit(c, at)

        visit(self, None)
        return rows

    def _params(self) -> str:
        own = [f.name for f in fields(self) if f.name not in ("child", "parts", "frame", "levels", "rows_of")]
        return ", ".join(f"{n}={getattr(self, n)!r}" for n in own)

    def explain(self) -> str:
        lines: list[str] = []

        def visit(node, lead, last):
            lines.append(f"{lead}{'╙── ' if last else '╟── '}{type(node).__name__} {node._params()}")
            kids = node.children()
            for i, c in enumerate(kids):
                visit(c, lead + ("    " if last else "╎   "), i == len(kids) - 1)

        visit(self, "", True)
        return "\n".join(lines)

    def leafs(self) -> list[Raster]:
        kids = self.children()
        return [x for c in kids for x in c.leafs()] if kids else [self]

    def leaf_paths(self) -> list[list[Raster]]:
        """For each leaf, the nodes from it to the root without stacks."""
        kids = self.children()
        own = [] if isinstance(self, Concat) else [self]
        return [path + own for c in kids for path in c.leaf_paths()] if kids else [own]

    @property
    def leaf_key(self) -> int:
        return id(self)


def _indexes(chosen, n: int) -> list[int]:
    return list(range(n)[chosen]) if isinstance(chosen, slice) else [chosen] if isinstance(chosen, int) else list(chosen)


@dataclass(frozen=True)
class Load(Raster):
    """A pixel relation. Unknown metadata are filled by prepare(). ``levels``: stored pyramid levels 1, 2, ...

    ``rows_of(y0, y1)``, where there is one, is the relation of some rows, filtered by what is stored.
    """

    frame: DataFrame = field(compare=False)
    bands: tuple[str, ...] | None = None
    size: tuple[int, int] | None = None
    levels: tuple = field(default=(), compare=False)
    nodata_method: str | None = None
    name: str = ""
    rows_of: object = field(default=None, compare=False)

    @property
    def dsize(self):
        if self.size is None:
            raise ValueError("the size isn't known; prepare() finds it")
        return self.size

    @property
    def channels(self):
        return self.bands or tuple(c for c in self.frame.columns if c not in ("y", "x"))

    @property
    def num_overviews(self):
        return len(self.levels)

    @property
    def leaf_key(self):
        return id(self.frame)

    def prepare(self):
        if self.size is not None:
            return self
        h, w = self.frame.selectExpr("coalesce(max(y) + 1, 0)", "coalesce(max(x) + 1, 0)").first()
        return replace(self, size=(int(w), int(h)))


@dataclass(frozen=True)
class Nans(Raster):
    """Nothing but missing pixels: NaN, or NULL with method 'ma'."""

    size: tuple[int, int]
    bands: tuple[str, ...] = ("c0",)
    method: str = "float"

    def __post_init__(self):
        if self.method not in ("float", "ma"):
            raise KeyError(self.method)

    @property
    def dsize(self):
        return self.size

    @property
    def channels(self):
        return self.bands


@dataclass(frozen=True)
class Crop(Raster):
    child: Raster
    y0: int
    y1: int
    x0: int
    x1: int
    bands: tuple[int, ...] | None = None

    def children(self):
        return (self.child,)

    @property
    def dsize(self):
        return self.x1 - self.x0, self.y1 - self.y0

    @property
    def channels(self):
        own = self.child.channels
        return own if self.bands is None else tuple(own[i] for i in self.bands)

    @property
    def num_overviews(self):
        return self.child.num_overviews

    def _to_parent(self):
        return Affine.translate(-self.x0, -self.y0)


@dataclass(frozen=True)
class Warp(Raster):
    """Output pixel (X, Y) shows the child where the inverse of ``transform`` puts (X, Y) + ``offset``.

    ``window`` is the part of the child, in its own coordinates, that can be seen; ``clips`` are crops that
    lie between maps that have been fused: (map from the child to the crop's space, x0, y0, x1, y1).
    """

    child: Raster
    transform: Affine
    size: tuple[int, int]
    interpolation: str = "linear"
    antialias: bool = True
    border_value: object = "auto"
    noop_eps: float = 0.0
    offset: tuple[int, int] = (0, 0)
    window: tuple[int, int, int, int] | None = None
    clips: tuple = ()

    def children(self):
        return (self.child,)

    @property
    def dsize(self):
        return self.size

    @property
    def channels(self):
        return self.child.channels

    def _to_parent(self):
        return Affine.translate(-self.offset[0], -self.offset[1]) @ self.transform


@dataclass(frozen=True)
class Overview(Raster):
    child: Raster
    level: int

    def children(self):
        return (self.child,)

    @property
    def dsize(self):
        return level_dsize(self.child.dsize, self.level)

    @property
    def channels(self):
        return self.child.channels

    @property
    def num_overviews(self):
        return max(0, self.child.num_overviews - self.level)

    def _to_parent(self):
        return Affine.scale(1 / 2**self.level)


@dataclass(frozen=True)
class Dequantize(Raster):
    child: Raster
    quantization: Quantization | None

    def children(self):
        return (self.child,)

    @property
    def dsize(self):
        return self.child.dsize

    @property
    def channels(self):
        return self.child.channels

    @property
    def num_overviews(self):
        return self.child.num_overviews


@dataclass(frozen=True)
class Concat(Raster):
    """Parts of one size, band after band."""

    parts: tuple[Raster, ...]
    size: tuple[int, int] | None = None

    def __post_init__(self):
        if self.size is None and len({p.dsize for p in self.parts if not (isinstance(p, Load) and p.size is None)}) > 1:
            raise CoordinateCompatibilityError(f"parts differ in size: {[p.dsize for p in self.parts]}")

    def children(self):
        return self.parts

    @property
    def dsize(self):
        return self.size or (self.parts[0].dsize if self.parts else (0, 0))

    @property
    def channels(self):
        return tuple(c for p in self.parts for c in p.channels)

    @property
    def num_overviews(self):
        return min((p.num_overviews for p in self.parts), default=0)

    def undo_warps(self, remove=None, retain=None, squash_nans=False, return_warps=False, **kw) -> list:
        """Each part in its own resolution: rasters of different sizes."""
        done = [p.undo_warp(remove, retain, squash_nans, return_warp=True, **kw) for p in self.parts]
        return ([d[0] for d in done], [d[1] for d in done]) if return_warps else [d[0] for d in done]


def support(kernel: str) -> float:
    """Half the width of a kernel, in source pixels."""
    return {"nearest": 0.5, "area": 0.5, "linear": 1.0, "cubic": 2.0, "lanczos": 4.0}[kernel]


def stretch(node: Warp) -> tuple[float, float]:
    """How far an antialiased downscaling widens the kernel along each axis."""
    if not node.antialias or node.interpolation == "nearest":
        return 1.0, 1.0
    return tuple(max(1.0, 1 / s) if s > 0 else 1.0 for s in node.transform.scales)


def source_window(node: Warp) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1) of the child: all that the output can see, widened by the kernel."""
    (w, h), (ox, oy), (cw, ch) = node.size, node.offset, node.child.dsize
    back = node.transform.inverse()
    corners = [back(x, y) for x in (ox, ox + w) for y in (oy, oy + h)]
    px, py = (math.ceil(support(node.interpolation) * s) + 1 for s in stretch(node))
    if not node.transform.aligned:
        px = py = max(px, py)
    low = lambda vs, p: max(0, math.floor(min(vs)) - p)
    high = lambda vs, p, n: max(0, min(n, math.ceil(max(vs)) + p))
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    x0, y0 = min(low(xs, px), cw), min(low(ys, py), ch)
    return x0, y0, max(x0, high(xs, px, cw)), max(y0, high(ys, py, ch))
