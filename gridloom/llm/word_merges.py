"""Byte-pair encoding of many words at once, in array operations.

Words of about one length are the columns of a table of ids, filled up with a sign that merges with nothing.
In each round every word that still has a pair to merge merges one, its pair of lowest rank, the first of
equals; so all words that go on lose one row, and words that stop leave the table. The result is what a
tokenizer gives that merges one pair after another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Ids and ranks have 21 bits each.
_RANK = np.int64((1 << 21) - 1)
_NONE = np.int64(1 << 40)
#: Fills columns; no vocabulary is so large.
_FILL = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100 on."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in prints]
    return [chr(b) if b in prints else chr(256 + others.index(b)) for b in range(256)]


class _Pairs:
    """Rank of a pair of ids: a table with open addresses, read for many pairs at a time. An entry is left, right and rank."""

    def __init__(self, left: list[int], right: list[int], bits: int):
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.entries = np.full(1 << bits, -1, np.int64)
        keys = np.array(left, np.int64) << 21 | np.array(right, np.int64)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._place(keys).tolist(), strict=True)):
            while self.entries[at] >= 0 and self.entries[at] >> 21 != key:
                at = at + 1 & self.mask
            if self.entries[at] < 0:
                self.entries[at] = key << 21 | rank

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _STEP >> self.shift).view(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64)
        keys <<= 21
        keys |= right
        shape, keys = keys.shape, keys.ravel()
        at = self._place(keys)
        met = self.entries[at]
        own = met >> 21 == keys
        found = np.where(own, met & _RANK, _NONE)
        rest = np.flatnonzero((met >= 0) & ~own)
        at, keys = at[rest], keys[rest]
        while len(rest):
            at = at + 1 & self.mask
            met = self.entries[at]
            own = met >> 21 == keys
            found[rest[own]] = met[own] & _RANK
            on = np.flatnonzero((met >= 0) & ~own)
            rest, at, keys = rest[on], at[on], keys[on]
        return found.reshape(shape)


class WordMerges:
    """A byte-level vocabulary with word ends, from the ``model`` part of its tokenizers file."""

    def __init__(self, model: dict):
        names, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([names[x] for x in letters], np.int32)
        self.last = np.array([names[x + end] for x in letters], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merged = np.array([names[a + b] for a, b in merges], np.int32)
        bits = max(4, (2 * len(merges)).bit_length())
        self.rank = _Pairs([names[a] for a, _ in merges], [names[b] for _, b in merges], bits)

    @staticmethod
    def serves(spec: dict) -> bool:
        """Whether a tokenizers file merges a pre-token's bytes by rank and nothing else."""
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        last = (pre.get("pretokenizers") or [pre])[-1]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        names, end = model.get("vocab", {}), model.get("end_of_word_suffix")
        if model.get("type") != "BPE" or not end or not plain or last.get("type") != "ByteLevel" or last.get("add_prefix_space"):
            return False
        return isinstance(names, dict) and all(x in names and x + end in names for x in byte_letters())

    def encode(self, raw: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, counts, ids) of words, some at a time. Column i of ``raw`` begins with the lengths[i] bytes of word i."""
        column = np.arange(raw.shape[1])
        ids = np.where(np.arange(len(raw))[:, None] < lengths, self.inner[raw], _FILL)
        ids[lengths - 1, column] = self.last[raw[lengths - 1, column]]
        at = np.arange(raw.shape[1])
        ranks = self.rank(ids[:-1], ids[1:])
        while len(ids) > 1:
            steps = np.arange(len(ids), dtype=np.int64)[:, None]
            least = np.minimum.reduce((ranks << 16) + steps[:-1])
            best, where = least >> 16, least & 0xFFFF
            on = best != _NONE
            if not on.all():
                off, on = np.flatnonzero(~on), np.flatnonzero(on)
                yield at[off], *self._flat(ids[:, off])
                at, ids, ranks, where, best = at[on], ids[:, on], ranks[:, on], where[on], best[on]
            if not len(at):
                return
            column, height = np.arange(len(at)), len(ids)
            ids = np.where(steps[:-1] > where, ids[1:], ids[:-1])
            ids[where, column] = self.merged[best]
            ranks = np.where(steps[:-2] >= where, ranks[1:], ranks[:-1])
            for moved, some in ((where - 1, where > 0), (where, where < height - 2)):
                c = column[some]
                r = moved[some]
                ranks[r, c] = self.rank(ids[r, c], ids[r + 1, c])
        if len(at):
            yield at, *self._flat(ids)

    @staticmethod
    def _flat(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = ids.T
        real = ids != _FILL
        return real.sum(axis=1), ids[real]
