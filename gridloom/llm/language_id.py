"""Language identification by rank-order profiles.

A text's profile is its most frequent character n-grams of lengths 1 to 3, in order of frequency; a
language's profile is that of all its training texts together. A document is in the language whose profile
is the least out of place: the sum, over the document's n-grams, of how far apart their ranks are, where an
n-gram that the language's profile lacks counts as far as can be.

Counts cover every training text, whole. Each task adds up its own before they are shuffled; a language's
top n-grams are found by partial rank limits, and only languages times profile length rows reach the driver.

Defined results: null text, or text without a letter, is ``und`` with score 0, and so is every text where
nothing could be learned. Rows of null language teach nothing. Of languages at one distance the first by name
wins; of n-grams of one frequency the first by code points. Equal rows get equal answers, and null ids don't
matter here. An empty table gives an empty table. Columns other than those named aren't read; one that has the
result's name gets ``_given`` behind its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import with_results

LONGEST, RANKS = 3, 400
#: Bits of a code point; three of them are one n-gram's number.
_BITS = 21
_SPACE = 0x20


def _codes(text: str) -> np.ndarray:
    """Lower-case code points of letters and marks, each run of anything else one space, a space at both ends."""
    import regex

    if text.isascii():
        raw = np.frombuffer(text.lower().encode(), np.uint8)
        c = np.where((raw >= 97) & (raw <= 122), raw, _SPACE).astype(np.int64)
    else:
        plain = regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower())
        c = np.frombuffer(plain.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    c = np.concatenate([[_SPACE], c, [_SPACE]])
    return c[np.concatenate([[True], (c[1:] != _SPACE) | (c[:-1] != _SPACE)])]


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, counts) of the n-grams of a text, by number. None is space alone."""
    c = _codes(text)
    if len(c) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    keys, gram = [c[c != _SPACE]], c
    for n in range(2, LONGEST + 1):
        gram = (gram[:-1] << _BITS) | c[n - 1 :]
        keys.append(gram)
    keys = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys)))


def _top(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams in order; ties by number."""
    return keys[np.argsort(-counts, kind="stable")[:most]]


@dataclass(frozen=True)
class Profiles:
    """Each language's n-grams in order of rank."""

    languages: tuple[str, ...]
    ranked: tuple[np.ndarray, ...]
    most: int = RANKS

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams of all profiles, and a row for each with its rank in each language."""
        keys = np.unique(np.concatenate(self.ranked)) if self.ranked else np.empty(0, np.int64)
        ranks = np.full((len(keys) + 1, len(self.languages)), -1, np.int32)
        for at, own in enumerate(self.ranked):
            ranks[np.searchsorted(keys, own), at] = np.arange(len(own))
        return keys, ranks


class Judge:
    def __init__(self, profiles: Profiles):
        import regex

        self.p, (self.keys, self.ranks) = profiles, profiles.index()
        self.letter = regex.compile(r"\p{L}")

    def __call__(self, text: str | None) -> tuple[str, float]:
        if not text or not self.p.languages or not self.letter.search(text):
            return "und", 0.0
        own = _top(*ngrams(text), self.p.most)
        at = np.searchsorted(self.keys, own)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == own, at, len(self.keys))
        ranks = self.ranks[at]
        apart = np.where(ranks < 0, self.p.most, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(apart))
        return self.p.languages[best], round(1 - float(apart[best]) / (self.p.most * len(own)), 6)


def learned(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most: int = RANKS, held: int = 2_000_000) -> Profiles:
    """Profiles from all rows of docs with a language. A task holds ``held`` n-grams before it hands them on."""
    texts = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")

    def count(batches):
        seen: dict[str, list] = {}
        size = 0

        def merged(parts):
            keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, counts, len(keys)).astype(np.int64)

        def out():
            for lang, parts in seen.items():
                keys, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, counts = ngrams(text)
                seen.setdefault(lang, []).append((keys, counts))
                size += len(keys)
            if size > held:
                seen = {lang: [merged(parts)] for lang, parts in seen.items()}
                size = sum(len(parts[0][0]) for parts in seen.values())
                if size > held // 2:
                    yield from out()
                    seen, size = {}, 0
        yield from out()

    counted = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    rows = sorted(tuple(r) for r in counted.withColumn("rank", rank).where(F.col("rank") <= most).select("lang", "rank", "gram").collect())
    names = tuple(sorted({r[0] for r in rows}))
    ranked = tuple(np.array([g for lang, _, g in rows if lang == name], np.int64) for name in names)
    return Profiles(names, ranked, most)


def identified(docs: DataFrame, profiles: Profiles, text: Column | str = "text", into: str = "language") -> DataFrame:
    """docs with a struct of lang_pred and score."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = Judge(profiles)
        for texts in batches:
            got = [one(t.as_py()) for t in texts]
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.StructArray.from_arrays(columns, ["lang_pred", "score"])

    return with_results(docs, {into: judge(text if isinstance(text, Column) else F.col(text))})
