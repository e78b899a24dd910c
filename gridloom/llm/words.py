"""Words of many texts at once, in array operations: no dictionary is kept and no word becomes an object.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; A-Z
count as a-z. A word's name is 64 bits: the sum of its bytes' random numbers, each times a power of an odd
number that its place decides, well mixed. Names are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACES = np.array([0x20, 9, 10, 11, 12, 13])
_SOLID = np.ones(256, bool)
_SOLID[_SPACES] = False
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mixed(names: np.ndarray) -> np.ndarray:
    """The same numbers with every bit depending on every other, in place."""
    names ^= names >> np.uint64(32)
    names *= _MIX
    names ^= names >> np.uint64(29)
    return names


def _numbers() -> np.ndarray:
    with np.errstate(over="ignore"):
        numbers = mixed(mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    numbers[65:91] = numbers[97:123]
    return numbers


_NUMBERS = _numbers()
#: The same for words whose letters are told apart by case.
_CASED = np.where(np.arange(256) == np.clip(np.arange(256), 65, 90), mixed(_NUMBERS.copy()), _NUMBERS)
_POWERS = np.cumprod(np.full(1 << 12, _STEP))


def _powers(most: int) -> np.ndarray:
    return _POWERS if most <= len(_POWERS) else np.cumprod(np.full(most, _STEP))


@dataclass(frozen=True)
class Block:
    """Names of the words of the texts from ``first`` on; those of text i lie from ``bounds[i]`` to ``bounds[i + 1]``."""

    first: int
    names: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1


def names_of(codes: np.ndarray, first: np.ndarray, numbers: np.ndarray = _CASED) -> np.ndarray:
    """Names of the runs of bytes that begin at the places ``first``, one after another without gaps."""
    lengths = np.diff(first, append=len(codes))
    place = np.arange(len(codes), dtype=np.int64) - np.repeat(first, lengths)
    return mixed(np.add.reduceat(numbers[codes] * _powers(int(lengths.max()))[place], first))


def _names(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, bounds) of the texts that start at the given places of a run of bytes."""
    solid = _SOLID[raw]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = starts[starts < len(raw)]
    begins[inner] = solid[inner]
    bounds = np.searchsorted(np.flatnonzero(begins), starts)
    first = np.flatnonzero(begins[solid])
    if not len(first):
        return np.empty(0, np.uint64), bounds
    return names_of(raw[solid], first, _NUMBERS), bounds


def spans(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first, bytes, places) of an Arrow array of strings, some ``size`` bytes (one text at least) at a time; null is empty."""
    if not len(texts):
        return
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    places = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(places, places[at] + size, "right")) - 1)
        yield at, data[places[at] : places[to]], places[at : to + 1] - places[at]
        at = to


def blocks(texts: pa.Array, size: int = 1 << 19) -> Iterator[Block]:
    """The words of an Arrow array of strings, some ``size`` bytes of text (one text at least) at a time; null has none."""
    for first, raw, places in spans(texts, size):
        names, bounds = _names(raw, places)
        yield Block(first, names, bounds)
