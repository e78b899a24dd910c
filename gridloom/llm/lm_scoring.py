"""Language-model scoring by cross-entropy difference.

Two bigram models, one of a target (documents labelled good) and one of the background (all documents),
have the same order, smoothing and vocabulary, so that per token their losses can be subtracted; a
document's score is the mean difference, background loss minus target loss: the higher, the more like the
target.

``scored_whole`` has every word of the documents in its vocabulary and every pair of words in its models,
however rare. Documents are kept in blocks of some megabytes of text. A block sends each distinct pair of its
words once, with its counts, to the bucket of the pair's name; buckets add up over all blocks and send the sums
back in the block's order, so neither names of words nor documents travel with them; words and contexts go the
same way. Names and counts go as packed arrays, some hundred to a row. However often a word or a pair occurs, it
is one number a block. Words, and pairs, are named by 64 bits: two words of one name would be counted as one,
which a hundred million words make likely in three of ten thousand corpora, two billion pairs in one of ten.

``models`` and ``scored`` are the small form, with a closed vocabulary of the ``size`` - 1 most frequent
words and a sign for all others, for callers that want a table of fixed size.

Defined results: null or empty text, or text without words, has no tokens and a null score. Labels with a
null id, and rows of docs with one, are never target. A document with several labels is target if one is
good. Without target documents both models are uniform where they lack counts, and scores are still defined.
Repeated rows are counted as often as they occur. An empty table gives an empty table. Columns other than
those named aren't read; one that has the result's name gets ``_given`` behind its own where others are returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import with_results, written
from .words import blocks, mixed, spans

SIZE = 2048
#: A word of more bytes than this is never in the vocabulary.
LONGEST = 64
OTHER = 0


def words_of(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words between white space."""
    return (text or "").encode("utf-8", "replace").lower().split()  # of bytes, these know ASCII letters and white space only


@dataclass(frozen=True)
class Vocabulary:
    """Words by number from 1 on; 0 is every other word."""

    words: tuple[bytes, ...]

    @property
    def size(self) -> int:
        return len(self.words) + 1

    def numbers(self) -> dict[bytes, int]:
        return {w: n for n, w in enumerate(self.words, 1)}


def pairs(text: str | None, numbers: dict[bytes, int], size: int) -> np.ndarray:
    """A number for each word and the one before it; the first word has OTHER before it."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.int64)
    get = numbers.get
    at = np.fromiter((get(w, OTHER) for w in words), np.int64, len(words))
    before = np.concatenate([[OTHER], at[:-1]])
    return before * size + at


def vocabulary(docs: DataFrame, text_col: str = "text", size: int = SIZE, held: int = 400_000) -> Vocabulary:
    """The most frequent words over all of docs; ties by bytes. A task holds ``held`` words, then hands them on."""

    def count(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(w for w in words_of(text.as_py()) if len(w) <= LONGEST)
                if len(seen) > held:
                    yield out()
                    seen.clear()
        yield out()

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "word").limit(size - 1).collect()
    return Vocabulary(tuple(bytes(r["word"]) for r in rows))


def pair_counts(docs: DataFrame, words: Vocabulary, text_col: str = "text", target_col: str = "target") -> DataFrame:
    """(pair, n, n_target) over all of docs, added up in each task first."""
    size = words.size

    def count(batches):
        numbers, all_, good = words.numbers(), np.zeros(size * size, np.int32), np.zeros(size * size, np.int32)
        for batch in batches:
            for text, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                keys, n = np.unique(pairs(text.as_py(), numbers, size), return_counts=True)
                all_[keys] += n.astype(np.int32)
                if target:
                    good[keys] += n.astype(np.int32)
        keys = np.flatnonzero(all_)
        for at in range(0, len(keys), 100_000):
            k = keys[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(all_[k], pa.int64()), pa.array(good[k], pa.int64())], ["pair", "n", "n_target"])

    texts = docs.select(F.col(text_col).alias("text"), F.col(target_col).alias("target"))
    counted = texts.mapInArrow(count, "pair long, n long, n_target long")
    return counted.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def log_probabilities(counts: np.ndarray) -> np.ndarray:
    """log p(word | word before) from a square table of counts.

    Witten-Bell: a context's own distribution is mixed with the single-word one by how many kinds of words
    have followed it; the single-word one is mixed with the uniform one in the same way.
    """
    size = len(counts)
    single = counts.sum(axis=0)
    kinds = np.count_nonzero(single)
    base = (single + kinds / size) / (single.sum() + kinds) if kinds else np.full(size, 1 / size)
    follow, total = np.count_nonzero(counts, axis=1)[:, None], counts.sum(axis=1)[:, None]
    mixed = (counts + follow * base) / np.maximum(total + follow, 1)
    return np.log(np.where(total > 0, mixed, base))


def differences(counted: DataFrame, size: int) -> np.ndarray:
    """Background loss minus target loss of each pair. At most size x size numbers reach the driver."""
    table = np.zeros((2, size * size))
    seen = counted.toArrow()
    keys = seen.column("pair").to_numpy()
    table[0, keys], table[1, keys] = seen.column("n").to_numpy(), seen.column("n_target").to_numpy()
    background, target = (log_probabilities(t.reshape(size, size)) for t in table)
    return (target - background).astype(np.float32).ravel()


def models(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> tuple[Vocabulary, np.ndarray]:
    """The shared vocabulary and the table of differences; ``good`` holds the ids of target documents."""
    words = vocabulary(docs, text_col, size)
    named = good.select(F.col(id_col).alias("__id")).distinct().withColumn("target", F.lit(True))
    met = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(named.hint("merge"), "__id", "left")
    counted = written(pair_counts(met.withColumn("target", F.coalesce("target", F.lit(False))), words), "pair-counts")
    return words, differences(counted, words.size)


def scored(docs: DataFrame, words: Vocabulary, table: np.ndarray, text_col: str = "text", into: str = "lm") -> DataFrame:
    """docs with a struct of n_tokens and score, the mean difference per token."""
    shared = docs.sparkSession.sparkContext.broadcast((words, table))

    @F.arrow_udf("struct<n_tokens: long, score: double>")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, diff = shared.value
        numbers, size = known.numbers(), known.size
        for texts in batches:
            keys = [pairs(t.as_py(), numbers, size) for t in texts]
            n = [len(k) for k in keys]
            mean = [round(float(diff[k].mean(dtype=np.float64)), 6) if len(k) else None for k in keys]
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(mean, pa.float64())], ["n_tokens", "score"])

    return with_results(docs, {into: score(F.col(text_col))})


#: Bytes of text beyond which a block of documents ends, and of all texts for a bucket of keys.
BLOCK, BUCKET = 8 << 20, 12 << 20
#: Rows beyond which a block ends though its texts are short, and the least number of buckets.
BLOCK_ROWS, BUCKETS = 1 << 18, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ASKED = "bucket long, block long, n long, keys binary, counts binary"
_ANSWERED = "kind long, block long, bucket long, n long, sums binary, kinds long, kinds_target long, every long, every_target long"


def _packed(raw: np.ndarray) -> bytes:
    """Numbers byte by byte of their places, so the high bytes of small ones, all zero, take next to nothing."""
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize).T) if raw.size else raw
    return pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unpacked(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.Codec("zstd").decompress(data, n * width, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def text_blocks(docs: DataFrame, most: int = BLOCK, most_rows: int = BLOCK_ROWS) -> DataFrame:
    """(block, ids, targets, size, places, data) of (id, text, target): a row for the documents of some ``most`` bytes, not over ``most_rows``."""
    kind = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)), T.StructField("targets", T.ArrayType(T.BooleanType()))]
        + [T.StructField("size", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("data", T.BinaryType())]
    )

    def work(batches):
        from pyspark import TaskContext

        number, parts, size, rows = TaskContext.get().partitionId() << 33, [], 0, 0

        def out():
            ids, targets = (pa.concat_arrays([p[k] for p in parts]) for k in (0, 1))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, targets)]
            data = np.concatenate([p[2] for p in parts])
            places = np.cumsum(np.concatenate([[0], *[np.diff(p[3]) for p in parts]])).astype(np.int64)
            blobs = [pa.array([x], pa.binary()) for x in (_packed(places), _packed(data))]
            return pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([len(data)]), *blobs], kind.names)

        for batch in batches:
            for first, data, places in spans(batch.column(1), most // 4):
                n = len(places) - 1
                if parts and (size + len(data) > most or rows + n > most_rows):
                    yield out()
                    number, parts, size, rows = number + 1, [], 0, 0
                # Copies: a slice would hold its whole batch in memory.
                take = pa.array(np.arange(first, first + n))
                parts.append((batch.column(0).take(take), batch.column(2).take(take), data.copy(), places))
                size, rows = size + len(data), rows + n
        if parts:
            yield out()

    return docs.select("id", "text", "target").mapInArrow(work, kind)


class _Counted:
    """The words and pairs of words of a block, by sorted names; the first word of a text has OTHER before it."""

    def __init__(self, targets: np.ndarray, size: int, places: bytes, data: bytes):
        places, data = _unpacked(places, len(targets) + 1, np.int64), _unpacked(data, size, np.uint8)
        texts = pa.LargeStringArray.from_buffers(len(targets), pa.py_buffer(places), pa.py_buffer(data))
        parts = list(blocks(texts))  # naming takes many times a piece's bytes, so it goes by small ones
        names, self.n = np.concatenate([p.names for p in parts]), np.concatenate([np.diff(p.bounds) for p in parts])
        self.text = np.repeat(np.arange(len(targets)), self.n)
        self.target = targets[self.text]
        self.words, at = np.unique(np.concatenate([np.array([OTHER], np.uint64), names]), return_inverse=True)
        self.word, self.before = at[1:], np.concatenate([at[:1], at[1:-1]])[: len(at) - 1]
        self.before[(np.cumsum(self.n) - self.n)[self.n > 0]] = at[0]
        names = mixed(self.words[self.before] * _STEP + self.words[self.word])
        self.pairs, self.first, self.pair = np.unique(names, return_index=True, return_inverse=True)

    def both(self, at: np.ndarray, many: int) -> list[np.ndarray]:
        """How often each number occurs, in all texts and in target ones."""
        return [np.bincount(at, minlength=many), np.bincount(at[self.target], minlength=many)]

    def pair_counts(self) -> np.ndarray:
        return np.array(self.both(self.pair, len(self.pairs)))

    def word_counts(self, owned: np.ndarray) -> np.ndarray:
        """Each word's occurrences, those as a context, and the pairs it begins that the block counts for all blocks."""
        many, begins = len(self.words), self.before[self.first]
        follow = [np.bincount(begins[own > 0], minlength=many) for own in owned]
        return np.array([*self.both(self.word, many), *self.both(self.before, many), *follow])


def _counted(table) -> _Counted:
    """Of a table or batch of one block."""
    targets = np.array(table.column("targets").to_pylist()[0], bool)
    return _Counted(targets, *(table.column(c)[0].as_py() for c in ("size", "places", "data")))


def _asked(block: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket, a range of keys: sorted keys as differences, and their counts in the block."""
    at = np.searchsorted(((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1).astype(np.uint64))
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if a < b]
    columns = [[k for k, _, _ in rows], [block] * len(rows), [b - a for _, a, b in rows]]
    blobs = [[_packed(np.diff(keys[a:b], prepend=np.uint64(0))) for _, a, b in rows], [_packed(counts[:, a:b].ravel()) for _, a, b in rows]]
    arrays = [pa.array(c, pa.int64()) for c in columns] + [pa.array(b, pa.binary()) for b in blobs]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "block", "n", "keys", "counts"])


def _answered(asked: DataFrame, kind: int, many: int, owners: bool) -> DataFrame:
    """To each block the sums over all blocks of its keys' ``many`` counts, in its order of keys.

    With ``owners``, two more rows of numbers: 1 where of all blocks with the key (and with it in target
    texts) this one counts it. The last four columns, in one row a bucket, are the keys whose first (second)
    sum isn't zero and these sums' totals.
    """

    def work(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        ends = np.cumsum(n)
        keys = np.concatenate([np.cumsum(_unpacked(d.as_py(), k, np.uint64)) for d, k in zip(table.column("keys"), n.tolist(), strict=True)])
        counts = np.concatenate([_unpacked(d.as_py(), many * k, np.int64).reshape(many, k) for d, k in zip(table.column("counts"), n.tolist(), strict=True)], 1)
        names, first, at = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.array([np.bincount(at, c, len(names)) for c in counts]).astype(np.int64)
        told = sums[:, at]
        if owners:
            own = np.zeros((2, len(keys)), np.int64)
            own[0, first] = 1
            target = np.flatnonzero(counts[1])
            own[1, target[np.unique(at[target], return_index=True)[1]]] = 1
            told = np.concatenate([told, own])
        blobs = [_packed(told[:, b - k : b].ravel()) for b, k in zip(ends.tolist(), n.tolist(), strict=True)]
        totals = np.zeros((4, len(n)), np.int64)
        totals[:, 0] = [np.count_nonzero(sums[0]), np.count_nonzero(sums[1]), sums[0].sum(), sums[1].sum()]
        columns = [pa.array(np.full(len(n), kind)), table.column("block"), table.column("bucket"), table.column("n"), pa.array(blobs, pa.binary()), *map(pa.array, totals)]
        return pa.table(columns, names=[c.split()[0] for c in _ANSWERED.split(", ")])

    return asked.groupBy("bucket").applyInArrow(work, _ANSWERED)


def _told(answers: pa.Table, kind: int, many: int) -> np.ndarray:
    """The sums for a block's keys, in their order."""
    rows = [r for r in answers.select(["kind", "bucket", "n", "sums"]).to_pylist() if r["kind"] == kind]
    parts = [_unpacked(r["sums"], many * r["n"], np.int64).reshape(many, -1) for r in sorted(rows, key=lambda r: r["bucket"])]
    return np.concatenate(parts, 1) if parts else np.empty((many, 0), np.int64)


PAIRS, WORDS = 0, 1


def scored_whole(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "lm") -> DataFrame:
    """The id of each row of docs with a struct of n_tokens and score, by models of every pair of words of docs.

    Blocks of documents ask for the counts of their distinct pairs, then of their words and contexts, and
    are scored with the answers. Smoothed as in ``log_probabilities``; the vocabulary is every word of docs.
    """
    named = good.select(F.col(id_col).alias("__id")).distinct().withColumn("target", F.lit(True))
    met = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(named.hint("merge"), "__id", "left")
    known = written(text_blocks(met.select(F.col("__id").alias("id"), "text", F.coalesce("target", F.lit(False)).alias("target"))), "text-blocks")
    buckets = max(BUCKETS, -(-(known.agg(F.sum("size")).first()[0] or 0) // BUCKET))

    def ask_pairs(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1)
                counted = _counted(row)
                yield _asked(row.column("block")[0].as_py(), counted.pairs, counted.pair_counts(), buckets)

    pairs = written(_answered(known.mapInArrow(ask_pairs, _ASKED), PAIRS, 2, True), "pair-sums")

    def ask_words(block: pa.Table, answers: pa.Table) -> pa.Table:
        counted = _counted(block)
        owned = _told(answers, PAIRS, 4)[2:]
        return pa.Table.from_batches([_asked(block.column("block")[0].as_py(), counted.words, counted.word_counts(owned), buckets)])

    asked = known.groupBy("block").cogroup(pairs.groupBy("block")).applyInArrow(ask_words, _ASKED)
    words = written(_answered(asked, WORDS, 6, False), "word-sums")
    kinds, kinds_target, every, every_target = (x or 0 for x in words.agg(*[F.sum(c) for c in ("kinds", "kinds_target", "every", "every_target")]).first())

    def loss(n, total, follow, base):
        return np.log(np.where(total > 0, (n + follow * base) / np.maximum(total + follow, 1), base))

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        counted = _counted(block)
        d_sums, sums = np.zeros(len(counted.n)), _told(answers, WORDS, 6)
        if len(counted.pairs):
            all_, good_ = _told(answers, PAIRS, 4)[:2]
            before, word = counted.before[counted.first], counted.word[counted.first]
            base = (sums[0, word] + 1.0) / (every + kinds)
            base_target = (sums[1, word] + kinds_target / kinds) / (every_target + kinds_target) if kinds_target else np.full(len(word), 1 / kinds)
            d = loss(good_, sums[3, before], sums[5, before], base_target) - loss(all_, sums[2, before], sums[4, before], base)
            d_sums = np.bincount(counted.text, d[counted.pair], len(counted.n))
        ids = block.column("ids").combine_chunks().flatten()
        return pa.table([ids, pa.array(counted.n.astype(np.int64)), pa.array(d_sums)], names=["id", "n", "d"])

    kind = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("d", T.DoubleType())])
    answers = pairs.unionByName(words)
    sums = known.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, kind)
    mean = F.when(F.col("n") > 0, F.round(F.col("d") / F.col("n"), 6))
    return sums.select(F.col("id").alias(id_col), F.struct(F.col("n").alias("n_tokens"), mean.alias("score")).alias(into))
