"""Bounded-space online packing of tokenised documents into fixed windows.

Each task keeps ``open_windows`` windows. A document goes whole where it fits best; where it fits nowhere
the fullest window is emitted, its gap filled with the document's first ids unless the gap is a sliver. At
its end a task pours its open windows together, which leaves at most one that isn't full. These leftovers
are merged over groups of tasks, and the last of each group is cut at powers of two, which need no padding.
Nothing but leftovers, under one window a task, is ever shuffled.

Defined results: null or empty text is one piece that holds only the end id. A null id is kept. Repeated
rows are documents of their own, each with its own pieces. An empty table gives an empty table. A text of
any length is cut into windows as it comes. Columns other than id and text aren't read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, written
from .word_merges import WordMerges
from .words import names_of, spans

PIECES = (
    "id {id}, start long, length long, doc_tokens long, task long, sequence long, offset long, ids binary, leftover boolean"
)


_SPACE, _LETTER, _SIGN, _DIGIT, _OTHER = range(5)


def _classes() -> np.ndarray:
    """The class of each byte. An apostrophe may begin a pre-token of letters, < a special token: these are others."""
    kinds = np.full(256, _OTHER, np.uint8)
    for code in range(33, 127):
        letter = chr(code)
        kinds[code] = _LETTER if letter.isalpha() else _DIGIT if letter.isdigit() else _OTHER if letter in "'<" else _SIGN
    kinds[[32, *range(9, 14)]] = _SPACE
    return kinds


_KINDS = _classes()
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: Second bytes of the letters U+00C0 to U+00FF, whose first is C3; and of those that have a lower case.
_C3, _SECOND, _CAPITAL = 0xC3, np.zeros(256, bool), np.zeros(256, bool)
_SECOND[0x80:0xC0], _CAPITAL[0x80:0x9F] = True, True
_SECOND[[0x97, 0xB7]], _CAPITAL[0x97] = False, False


@dataclass(frozen=True)
class Units:
    """Parts of texts that are encoded by themselves: runs of lower-case letters, runs of signs, single digits, and other chunks as they are.

    Unit i is ``codes[first[i]:first[i + 1]]``; ``other`` tells which are chunks for the tokenizer, ``bounds`` where each text begins.
    """

    codes: np.ndarray
    first: np.ndarray
    other: np.ndarray
    bounds: np.ndarray

    def ends(self) -> np.ndarray:
        return np.append(self.first[1:], len(self.codes))


def units_of(raw: np.ndarray, places: np.ndarray, whole: bool = False) -> Units:
    """The units of some texts; with ``whole`` each chunk between white space is one for the tokenizer."""
    kinds, low = _KINDS[raw], _LOWER[raw]
    lead = np.flatnonzero(raw[:-1] == _C3)
    if len(lead):
        second = raw[lead + 1]
        lead, second = lead[_SECOND[second]], second[_SECOND[second]]
        kinds[lead] = kinds[lead + 1] = _LETTER
        low[lead + 1] = second + np.where(_CAPITAL[second], 32, 0).astype(np.uint8)
    solid = kinds != _SPACE
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    inner = places[places < len(raw)]
    begins[inner] = solid[inner]
    kinds, low, chunk = kinds[solid], low[solid], begins[solid]
    where = np.flatnonzero(solid)
    number = np.cumsum(chunk) - 1
    strange = np.full(int(number[-1]) + 1 if len(number) else 0, whole)
    strange[number[kinds == _OTHER]] = True
    other = strange[number]
    starts = chunk | ~other & (kinds == _DIGIT)
    starts[1:] |= ~other[1:] & (kinds[1:] != kinds[:-1])
    first = np.flatnonzero(starts)
    return Units(np.where(other, raw[solid], low), first, other[first], np.searchsorted(where[first], places))


class ChunkEncoder:
    """Ids of texts by a tokenizer that never joins text over white space: each unit is encoded once.

    Runs of letters, runs of signs and digits are pre-tokens of their own; they are merged many at a time in
    array operations where the vocabulary allows it. Chunks with anything else in them are the tokenizer's
    own work. ``most`` bounds how many units are remembered, by their 64-bit names; beyond it that memory
    starts afresh. Two units of one name would be taken for one: in 16 trillion words, once in a hundred runs.
    """

    #: Units of about one length are merged together. Longer ones are left to the tokenizer.
    WIDTHS = (4, 6, 8, 10, 12, 16, 24, 64)

    def __init__(self, path: str, end_id: int, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.most = Tokenizer.from_file(path), int(end_id).to_bytes(4, "little"), most
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merges = WordMerges(spec["model"]) if WordMerges.serves(spec) else None
        self._forget()

    def _forget(self) -> None:
        self.names, self.starts, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    def _learn(self, names: np.ndarray, units: Units, at: np.ndarray) -> None:
        """Remember the ids of the units at some places, which have the given names."""
        first, ends = units.first[at], units.ends()[at]
        length = ends - first
        counts, parts, order = np.zeros(len(at), np.int64), [], []
        slow = units.other[at] | (length > self.WIDTHS[-1])
        low = 0
        for high in self.WIDTHS:
            some = np.flatnonzero((length > low) & (length <= high) & ~slow)
            for a in range(0, len(some), 4000):
                own = some[a : a + 4000]
                raw = units.codes.take(first[own] + np.arange(high)[:, None], mode="clip")
                for places, n, ids in self.merges.encode(raw, length[own]):
                    counts[own[places]] = n
                    order.append(own[places])
                    parts.append(ids)
            low = high
        rest = np.flatnonzero(slow)
        texts = [units.codes[a:b].tobytes().decode() for a, b in zip(first[rest].tolist(), ends[rest].tolist(), strict=True)]
        for k, found in zip(rest.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            counts[k] = len(found.ids)
            order.append(np.array([k]))
            parts.append(np.array(found.ids, np.uint32))
        order = np.concatenate(order)
        starts = np.empty(len(at), np.int64)
        starts[order] = len(self.ids) + np.cumsum(counts[order]) - counts[order]
        self.ids = np.concatenate([self.ids, *parts]).astype("<u4")
        names = np.concatenate([self.names, names])
        into = np.argsort(names)
        self.names = names[into]
        self.starts, self.counts = np.concatenate([self.starts, starts])[into], np.concatenate([self.counts, counts])[into]

    def _places(self, names: np.ndarray) -> np.ndarray:
        """Where each name is remembered; -1 where it isn't."""
        at = np.searchsorted(self.names, names)
        at[at == len(self.names)] = 0
        return np.where(self.names[at] == names, at, -1) if len(self.names) else np.full(len(names), -1)

    def encode(self, texts: pa.Array, size: int = 1 << 20) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text, the end id last."""
        for _, raw, places in spans(texts, size):
            units = units_of(raw, places, self.merges is None)
            if not len(units.first):
                yield from [self.end] * (len(places) - 1)
                continue
            names = names_of(units.codes, units.first)
            names[units.other] = ~names[units.other]
            each, where, back = np.unique(names, return_index=True, return_inverse=True)
            at = self._places(each)
            new = np.flatnonzero(at < 0)
            if len(new):
                if len(self.names) + len(new) > self.most:
                    self._forget()
                    new = np.arange(len(each))
                self._learn(each[new], units, where[new])
                at = self._places(each)
            at = at[back]
            counts = self.counts[at]
            ends = np.cumsum(counts)
            ids = self.ids[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(ends[-1])]
            ends = np.concatenate([[0], ends])[units.bounds].tolist()
            for a, b in zip(ends, ends[1:], strict=False):
                yield ids[a:b].tobytes() + self.end


def _encoder(path: str, end_id: int) -> ChunkEncoder:
    """One encoder for each worker process, so what a task has learnt serves the next."""
    return held(("packing", path, end_id), lambda: ChunkEncoder(path, end_id))


class Packer:
    """Places items (id, start, total, ids) in windows of ``size`` ids; full ones come out of ``place``."""

    def __init__(self, size: int, open_windows: int, sliver: int):
        self.size, self.most, self.sliver = size, open_windows, sliver
        self.windows: list[tuple[int, list]] = []  # (ids so far, pieces)

    def place(self, item: tuple) -> Iterator[list]:
        key, start, total, ids = item
        n = len(ids) // 4
        while n >= self.size:  # whole windows of a long document
            yield [(key, start, total, ids[: 4 * self.size])]
            ids, start, n = ids[4 * self.size :], start + self.size, n - self.size
        if not n:
            return
        best = None
        for at, (used, _) in enumerate(self.windows):
            if used + n <= self.size and (best is None or used > self.windows[best][0]):
                best = at
        if best is None and len(self.windows) < self.most:
            self.windows.append((n, [(key, start, total, ids)]))
            return
        if best is None:
            fullest = max(range(self.most), key=lambda at: self.windows[at][0])
            used, pieces = self.windows.pop(fullest)
            gap = self.size - used
            if gap >= self.sliver:
                pieces.append((key, start, total, ids[: 4 * gap]))
                ids, start, n = ids[4 * gap :], start + gap, n - gap
            yield pieces
            yield from self.place((key, start, total, ids))
            return
        used, pieces = self.windows[best]
        pieces.append((key, start, total, ids))
        if used + n == self.size:
            self.windows.pop(best)
            yield pieces
        else:
            self.windows[best] = (used + n, pieces)

    def pour(self) -> tuple[list[list], list]:
        """Merge the open windows, fullest first: whole windows, and the pieces of one that isn't full."""
        full, last, used = [], [], 0
        for _, pieces in sorted(self.windows, key=lambda w: -w[0]):
            for key, start, total, ids in pieces:
                while ids:
                    part = ids[: 4 * (self.size - used)]
                    last.append((key, start, total, part))
                    used, start, ids = used + len(part) // 4, start + len(part) // 4, ids[len(part) :]
                    if used == self.size:
                        full.append(last)
                        last, used = [], 0
        self.windows = []
        return full, last


def powers_of_two(pieces: list) -> list[list]:
    """Cut pieces into sequences whose lengths are the powers of two that their total is made of."""
    left = sum(len(p[3]) // 4 for p in pieces)
    out, queue = [], list(pieces)
    for bit in reversed(range(left.bit_length())):
        want, sequence = left & (1 << bit), []
        while want:
            key, start, total, ids = queue.pop(0)
            part = ids[: 4 * want]
            sequence.append((key, start, total, part))
            if len(part) < len(ids):
                queue.insert(0, (key, start + len(part) // 4, total, ids[len(part) :]))
            want -= len(part) // 4
        if sequence:
            out.append(sequence)
    return out


def _rows(sequences, task: int, first: int, leftover: bool = False) -> list[tuple]:
    rows = []
    for number, pieces in enumerate(sequences, first):
        offset = 0
        for key, start, total, ids in pieces:
            rows.append((key, start, len(ids) // 4, total, task, number, offset, ids, leftover))
            offset += len(ids) // 4
    return rows


def _batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, *[pa.int64()] * 6, pa.binary(), pa.bool_()]
    names = ["id", "start", "length", "doc_tokens", "task", "sequence", "offset", "ids", "leftover"]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    size: int = 4096,
    open_windows: int = 64,
    sliver: int = 32,
    merge: int = 128,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row a piece: id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit).

    ``tokenizer`` is the path of a tokenizers file that is there on every executor. ``merge`` tasks share
    a final merge. Pieces are a table on shared storage, so a lost executor never leads to another packing.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = named.schema["id"].dataType.simpleString()

    def work(batches):
        from pyspark import TaskContext

        encoder, packer = _encoder(tokenizer, end_id), Packer(size, open_windows, sliver)
        task, number, rows, kind, size_held = TaskContext.get().partitionId(), 0, [], None, 0
        for batch in batches:
            kind, keys = batch.schema.field(0).type, batch.column(0).to_pylist()
            for key, ids in zip(keys, encoder.encode(batch.column(1)), strict=True):
                for pieces in packer.place((key, 0, len(ids) // 4, ids)):
                    rows += _rows([pieces], task, number)
                    number, size_held = number + 1, size_held + 4 * size
                if size_held > 8_000_000:
                    yield _batch(rows, kind)
                    rows, size_held = [], 0
        if kind is not None:
            full, last = packer.pour()
            rows += _rows(full, task, number)
            number += len(full)
            yield _batch(rows + (_rows([last], task, number, True) if last else []), kind)

    pieces = written(named.mapInArrow(work, PIECES.format(id=id_type)), "pieces")

    def merge_group(pdf):
        import pandas as pd

        poured = Packer(size, 1, 0)
        pdf = pdf.sort_values(["task", "offset"], kind="stable")
        for (_, number), part in pdf.groupby(["task", "sequence"], sort=True):
            items = [(k, s, t, i) for k, s, t, i in zip(part["id"], part["start"], part["doc_tokens"], part["ids"])]
            poured.windows.append((sum(len(i[3]) for i in items), items))
        full, last = poured.pour()
        rows = _rows(full + powers_of_two(last), int(pdf["task"].iloc[0]), 0, True)
        return pd.DataFrame(rows, columns=list(pdf.columns))

    last = pieces.where("leftover")
    merged = last.groupBy((F.col("task") / merge).cast("long").alias("group")).applyInPandas(
        lambda pdf: merge_group(pdf), PIECES.format(id=id_type)
    )
    # Task numbers come from one partitioning, so (task, number) is unique; merged sequences get odd ids.
    place = F.shiftleft(F.col("task") + 1, 33) + F.shiftleft(F.col("sequence"), 1) + F.col("leftover").cast("long")
    done = pieces.where("not leftover").unionByName(merged)
    return done.select(
        F.col("id").alias(id_col), "start", "length", "doc_tokens", place.alias("sequence_id"), "offset", "ids"
    )
