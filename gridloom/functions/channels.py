"""Channel specs: ordered lists of band names ('r|g|b', 'land.0:4') and comma-separated groups of them."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

#: Short names and the bands that they stand for (fixed values).
ALIASES = {"rgb": ("r", "g", "b"), "rgba": ("r", "g", "b", "a"), "dxdy": ("dx", "dy"), "fxfy": ("fx", "fy")}
_RANGE = re.compile(r"^(?P<root>.*?)[.:](?P<a>-?\d+)(?::(?P<b>-?\d+)(?::(?P<c>-?\d+))?)?$")


def expand(code: str, aliases: bool = True) -> list[str]:
    """Bands that a code stands for: 'B:3' and 'B.0:3' are B.0, B.1, B.2; 'B.5' is itself."""
    if aliases and code in ALIASES:
        return list(ALIASES[code])
    m = _RANGE.match(code)
    if not m or (m["b"] is None and code[m.start("a") - 1] == "."):
        return [code]
    start, stop = (0, int(m["a"])) if m["b"] is None else (int(m["a"]), int(m["b"]))
    return [f"{m['root']}.{i}" for i in range(start, stop, int(m["c"] or 1))]


def shorten(codes) -> list[str]:
    """Adjacent ascending runs of one root as ranges."""
    runs: list[list] = []  # [root, first, next] or [code]
    for code in codes:
        root, dot, at = code.rpartition(".")
        if dot and at.isdigit():
            if runs and len(runs[-1]) == 3 and runs[-1][0] == root and runs[-1][2] == int(at):
                runs[-1][2] += 1
            else:
                runs.append([root, int(at), int(at) + 1])
        else:
            runs.append([code])

    def text(run):
        if len(run) == 1:
            return run[0]
        root, a, b = run
        return f"{root}.{a}" if b == a + 1 else f"{root}:{b}" if a == 0 else f"{root}.{a}:{b}"

    return [text(r) for r in runs]


def _name(text: str, size: int, most: int) -> str:
    for old, new in (("|", "_"), ("<", "-LT-"), (">", "-GT-"), (":", ".."), ("?", "_Q_"), ("*", "_S_")):
        text = text.replace(old, new)
    text = text + "_" if text[-1:] in (".", " ") else text
    if len(text) <= most:
        return text
    n, out = int(hashlib.sha256(text.encode()).hexdigest(), 16), ""
    while len(out) < 24:
        n, at = divmod(n, 26)
        out += chr(97 + at)
    return f"{out}_{size}"


@dataclass(frozen=True)
class FusedChannelSpec:
    """An ordered list of codes. Equality is of the codes as written."""

    codes: tuple[str, ...]

    @staticmethod
    def coerce(value) -> FusedChannelSpec:
        if isinstance(value, FusedChannelSpec):
            return value
        if isinstance(value, ChannelSpec):
            return value.fuse()
        if isinstance(value, int):
            return FusedChannelSpec(tuple(f"u{i}" for i in range(value)))
        if isinstance(value, str):
            return FusedChannelSpec(tuple(c for c in value.split("|") if c))
        if isinstance(value, (list, tuple)):
            return FusedChannelSpec(tuple(value))
        raise TypeError(type(value).__name__)

    @property
    def spec(self) -> str:
        return "|".join(self.codes)

    __str__ = spec.fget
    __json__ = spec.fget

    def normalize(self) -> FusedChannelSpec:
        return FusedChannelSpec(tuple(b for c in self.codes for b in expand(c)))

    def concise(self) -> FusedChannelSpec:
        return FusedChannelSpec(tuple(shorten(self.normalize().codes)))

    def equals_normalized(self, other) -> bool:
        return self.normalize() == FusedChannelSpec.coerce(other).normalize()

    def numel(self) -> int:
        return len(self.normalize().codes)

    __len__ = numel

    def sizes(self) -> list[int]:
        return [len(expand(c)) for c in self.codes]

    def as_list(self) -> list[str]:
        return list(self.normalize().codes)

    def as_oset(self) -> list[str]:
        return list(dict.fromkeys(self.as_list()))

    def as_set(self) -> set[str]:
        return set(self.as_list())

    unique = as_set

    def code_list(self) -> list[str]:
        return list(self.codes)

    def __contains__(self, code: str) -> bool:
        return code in self.codes

    def __getitem__(self, index) -> FusedChannelSpec:
        own = self.normalize().codes
        if isinstance(index, int):
            return FusedChannelSpec((own[index],))
        return FusedChannelSpec(own[index] if isinstance(index, slice) else tuple(own[i] for i in index))

    @staticmethod
    def concat(items) -> FusedChannelSpec:
        return FusedChannelSpec(tuple(c for i in items for c in FusedChannelSpec.coerce(i).codes))

    def difference(self, other) -> FusedChannelSpec:
        gone = FusedChannelSpec.coerce(other).as_set()
        return FusedChannelSpec(tuple(c for c in self.as_oset() if c not in gone))

    def intersection(self, other) -> FusedChannelSpec:
        there = FusedChannelSpec.coerce(other).as_set()
        return FusedChannelSpec(tuple(c for c in self.as_list() if c in there))

    def union(self, other) -> FusedChannelSpec:
        return FusedChannelSpec(tuple(dict.fromkeys(self.as_list() + FusedChannelSpec.coerce(other).as_list())))

    __sub__, __and__, __or__ = difference, intersection, union

    def issubset(self, other) -> bool:
        return self.as_set() <= FusedChannelSpec.coerce(other).as_set()

    def issuperset(self, other) -> bool:
        return self.as_set() >= FusedChannelSpec.coerce(other).as_set()

    def component_indices(self, axis: int = 0) -> dict[str, tuple]:
        """Each code's place along an axis, by true sizes."""
        out, at = {}, 0
        for code, size in zip(self.codes, self.sizes(), strict=True):
            out[code] = (slice(None),) * axis + (slice(at, at + size),)
            at += size
        return out

    def streams(self) -> list[FusedChannelSpec]:
        return [self]

    def fuse(self) -> FusedChannelSpec:
        return self

    def split(self) -> list[FusedChannelSpec]:
        return [FusedChannelSpec((c,)) for c in self.codes]

    def late_fuse(self, *others) -> ChannelSpec:
        return ChannelSpec.coerce(self).late_fuse(*others)

    __add__ = late_fuse

    def path_sanitize(self, maxlen: int = 128) -> str:
        return _name(self.spec, self.numel(), maxlen)

    as_path = path_sanitize


@dataclass(frozen=True)
class ChannelSpec:
    """Groups of channels, separated by commas."""

    spec: str

    @staticmethod
    def coerce(value) -> ChannelSpec:
        if isinstance(value, ChannelSpec):
            return value
        return ChannelSpec(value if isinstance(value, str) else FusedChannelSpec.coerce(value).spec)

    def __str__(self) -> str:
        return self.spec

    __json__ = __str__

    def streams(self) -> list[FusedChannelSpec]:
        return [FusedChannelSpec.coerce(s) for s in dict.fromkeys(self.spec.split(",")) if s.strip("|")]

    @staticmethod
    def _of(streams) -> ChannelSpec:
        return ChannelSpec(",".join(s.spec for s in streams if s.codes))

    def parse(self) -> dict[str, list[str]]:
        return {s.spec: list(s.codes) for s in self.streams()}

    def keys(self):
        return self.parse().keys()

    def values(self):
        return self.parse().values()

    def items(self):
        return self.parse().items()

    def normalize(self) -> ChannelSpec:
        return self._of(s.normalize() for s in self.streams())

    def concise(self) -> ChannelSpec:
        return self._of(s.concise() for s in self.streams())

    def fuse(self) -> FusedChannelSpec:
        return FusedChannelSpec.concat(self.streams())

    def split(self) -> list[FusedChannelSpec]:
        return self.fuse().split()

    def code_list(self) -> list[str]:
        streams = self.streams()
        if len(streams) != 1:
            raise ValueError("only a spec of one stream has a list of codes")
        return streams[0].code_list()

    def difference(self, other) -> ChannelSpec:
        return self._of(s.difference(ChannelSpec.coerce(other).fuse()) for s in self.streams())

    def intersection(self, other) -> ChannelSpec:
        return self._of(s.intersection(ChannelSpec.coerce(other).fuse()) for s in self.streams())

    def union(self, other) -> ChannelSpec:
        return ChannelSpec(",".join(s.normalize().spec for s in self.streams() + ChannelSpec.coerce(other).streams()))

    __sub__, __and__, __or__ = difference, intersection, union

    def issubset(self, other):
        raise NotImplementedError

    issuperset = issubset

    def numel(self) -> int:
        return sum(s.numel() for s in self.streams())

    def sizes(self) -> dict[str, list[int]]:
        return {s.spec: s.sizes() for s in self.streams()}

    def unique(self) -> set[str]:
        return self.fuse().as_set()

    def __contains__(self, code: str) -> bool:
        return any(code in s for s in self.streams())

    def info(self) -> dict:
        return {"spec": self.spec, "normed": self.normalize().spec, "unique": sorted(self.unique()), "numel": self.numel()}

    def late_fuse(self, *others) -> ChannelSpec:
        return ChannelSpec(",".join(s for s in (self.spec, *(ChannelSpec.coerce(o).spec for o in others)) if s))

    __add__ = late_fuse

    def __radd__(self, other) -> ChannelSpec:
        return self if other == 0 else ChannelSpec.coerce(other).late_fuse(self)

    def component_indices(self, axis: int = 0) -> dict[str, tuple[str, tuple]]:
        return {c: (s.spec, place) for s in self.streams() for c, place in s.component_indices(axis).items()}

    def encode(self, item: dict, axis: int = 0) -> dict:
        """Arrays by code, joined along an axis into one array for each stream."""
        import numpy as np

        whole = {}
        for code, array in item.items():
            for at, band in enumerate(expand(code)):
                whole[band] = np.take(array, [at], axis=axis)
        return {s.spec: np.concatenate([whole[b] for b in s.as_list()], axis=axis) for s in self.streams()}

    def decode(self, inputs: dict, axis: int = 0) -> dict:
        """Arrays by stream, cut along an axis into one array for each code."""
        return {c: inputs[s.spec][place] for s in self.streams() for c, place in s.component_indices(axis).items()}

    def path_sanitize(self, maxlen: int = 128) -> str:
        return _name(self.spec, self.numel(), maxlen)

    as_path = path_sanitize


def subsequence_index(whole: list, part: list) -> slice | None:
    """Where part lies in whole without gaps."""
    hits = (i for i in range(len(whole) - len(part) + 1) if whole[i : i + len(part)] == part)
    at = next(hits, None)
    return None if at is None else slice(at, at + len(part))


def oset_insert(items: list, index: int, item) -> list:
    return items if item in items else [*items[:index], item, *items[index:]]


def oset_delitem(items: list, index) -> list:
    gone = set(range(len(items))[index]) if isinstance(index, slice) else {range(len(items))[index]}
    return [x for i, x in enumerate(items) if i not in gone]
