"""Near-duplicate documents by bottom-k sketches.

One hash function orders a document's word shingles; its sketch is the k smallest. Documents whose sets are
identical form a class at once. Between classes, inverted lists of the retained values generate overlaps:
similar sketches share so many values that they must share one of each one's rarest few, so only those are
listed. The k smallest values of two sketches together estimate the similarity and filter the pairs; the
Jaccard similarity of the full sets decides.

No list is expanded into all its pairs, whatever its size. First each document is paired with one, the
pivot of most of its lists, which joins families of near copies: a list's pivot is the member whose
values lie in most sketches on average, so the text that the others were made from, not one of them. Then the members of lists that still hold different
components are listed anew with sketches sixteen times as deep, where rank and size rule out almost every
pair, and only pairs of different components are compared. No list is capped or skipped.

A pair of similarity at or above the threshold is lost only if its sketches share five standard deviations
fewer values than expected; between sets that sketches hold whole, none is. Shingles are compared by 64 bits.

Defined results: null or empty text, or text without words, has no shingles and is linked with nothing. A
row with a null id is linked with nothing and has a null component. Rows that share an id are each judged by
their own text, but links name documents by id. Texts of fewer words than a shingle have their whole
sequence as one. An empty table gives an empty table. Columns other than id and text aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HEAVY, components, join_groups, numbered, written
from .words import blocks, mixed

WORDS = 5
SKETCH, DEEP = 64, 1024
_STEP, _SHORT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x5851F42D4C957F2D)


def _run(names: np.ndarray, width: int, seed: np.uint64 = np.uint64(0)) -> np.ndarray:
    """A number for each run of ``width`` words."""
    runs = np.full(len(names) - width + 1, seed)
    for at in range(width):
        runs = runs * _STEP + names[at : at + len(runs)]
    return mixed(runs).view(np.int64)


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first, sets): the sorted distinct 64-bit numbers of the shingles of each text from ``first`` on."""
    for block in blocks(texts):
        n = np.diff(block.bounds)
        runs = np.empty(0, np.int64)
        if len(block.names) >= words:
            left = np.repeat(block.bounds[1:], n) - np.arange(len(block.names))
            runs = _run(block.names, words)[left[: len(block.names) - words + 1] >= words]
        ends = np.cumsum(np.maximum(n - words + 1, 0))
        starts = np.concatenate([[0], ends[:-1]])
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            runs[a:b].sort()
        new = np.ones(len(runs), bool)
        new[1:] = runs[1:] != runs[:-1]
        new[starts[ends > starts]] = True
        at = np.concatenate([[0], np.cumsum(new)])
        runs = runs[new]
        sets = [runs[a:b] for a, b in zip(at[starts].tolist(), at[ends].tolist(), strict=True)]
        for k in np.flatnonzero((n > 0) & (n < words)).tolist():
            own = block.names[block.bounds[k] : block.bounds[k + 1]]
            sets[k] = _run(own, len(own), _SHORT)
        yield block.first, sets


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def sketched(texts: DataFrame, words: int, k: int) -> DataFrame:
    """(id, n, key, sketch) of each row of (id, text): the size of its set, a digest of it, and its k smallest."""
    fields = [T.StructField("n", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sketch", T.ArrayType(T.LongType()))]

    def work(batches):
        import xxhash

        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), words):
                keys = pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary())
                columns = [pa.array([len(s) for s in sets], pa.int64()), keys, _lists([s[:k] for s in sets])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), *columns], ["id", "n", "key", "sketch"])

    return texts.select("id", "text").mapInArrow(work, T.StructType([texts.schema["id"], *fields]))


def full_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of each row of (id, text)."""

    def work(batches):
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), words):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(sets)), _lists(sets)], ["node", "shingles"])

    kind = T.StructType([T.StructField("node", texts.schema["id"].dataType), T.StructField("shingles", T.ArrayType(T.LongType()))])
    return texts.select("id", "text").mapInArrow(work, kind)


class Similar:
    """The bounds that a similarity of ``percent`` in a hundred sets."""

    def __init__(self, percent: int):
        self.percent, self.t = percent, percent / 100

    def shared(self, size: float) -> float:
        """How many of ``size`` values of a union two similar sets share at least, five deviations down."""
        return self.t * size - 5 * math.sqrt(size * self.t * (1 - self.t))

    def whole(self, k: int) -> int:
        """Sets up to this size, and all sets similar to them, lie whole in a sketch of k."""
        return math.floor(self.t * k)

    def prefix(self, n: Column, k: int) -> Column:
        """How many of a sketch's rarest values must hold one that a similar sketch's rarest values hold."""
        exact = n - F.ceil(n * self.percent / 100) + 1
        rough = F.least(n, F.lit(k)) - max(1, math.floor(self.shared(k))) + 1
        return F.when(n <= self.whole(k), exact).otherwise(F.greatest(rough, F.lit(1)))

    def partner(self, n: Column, rank: Column, k: int) -> Column:
        """The largest set with which the value at a rank can be the first that both share."""
        exact = F.floor((n - rank) * (100 + self.percent) / self.percent) - n
        return F.when(n <= self.whole(k), exact).otherwise(F.ceil(n * 100 / self.percent))


def _join_values(rows: DataFrame, groups: DataFrame, size: str, total: int) -> DataFrame:
    """``join_groups`` on ``value``, for a table of groups: the driver reads the heavy values, fewer than HEAVY.

    So a filter tells their rows apart, not a join, and without heavy values there is one join only.
    """
    heavy = F.col(size) * HEAVY > F.lit(total)
    values = [r[0] for r in groups.where(heavy).select("value").collect()]
    if not values:
        return rows.join(groups, "value", "left")
    hot = F.col("value").isin(values)
    first = rows.where(hot).join(F.broadcast(groups.where(heavy)), "value")
    return first.unionByName(rows.where(~hot).join(groups.where(~heavy), "value", "left"))


def listed(sketches: DataFrame, like: Similar, k: int) -> DataFrame:
    """(value, node, n, rank, spread): the rarest values of each sketch, with their rank from the rarest up.

    ``sketches`` has (node, n, sketch). Values in one sketch only are counted in the ranks but not listed;
    ``spread`` is the mean number of sketches that hold a value of the node's.
    """
    each = sketches.select("node", "n", F.explode("sketch").alias("value"))
    often = written(each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "value-counts")
    total = sketches.agg(F.sum(F.size("sketch"))).first()[0] or 0
    shared = _join_values(each, often, "df", total).where("df is not null").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
    alone = F.least("n", F.lit(k)) - F.size("v")
    kept = F.slice("v", F.lit(1), F.greatest(like.prefix(F.col("n"), k) - alone, F.lit(0)).cast("int"))
    spread = (F.aggregate("v", F.lit(0).cast("long"), lambda total, v: total + v["df"]) + alone) / F.least("n", F.lit(k))
    cut = shared.select("node", "n", alone.alias("alone"), spread.alias("spread"), F.posexplode(kept).alias("at", "v"))
    return cut.select("v.value", "node", "n", (F.col("alone") + F.col("at")).alias("rank"), "spread")


def _near(sets: DataFrame, like: Similar, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar. A pair carries the set of b to the set of a."""
    right = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = right.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.where(common * 100 >= union * like.percent).select("a", "b")


def _star_pairs(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """Each node with one other, so pairs are no more than nodes; ``lists`` has (value, size, pivot).

    Of the pivots of its lists it is the one that most of them share, the smallest of equals.
    """
    met = _join_values(entries.select("value", "node"), lists, "size", entries.count())
    overlaps = met.where("pivot is not null and node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("shared"))
    best = overlaps.groupBy("node").agg(F.min(F.struct((-F.col("shared")).alias("fewest"), "pivot")).alias("best"))
    pairs = best.select(F.least("best.pivot", "node").alias("a"), F.greatest("best.pivot", "node").alias("b"))
    return pairs.distinct()


def _estimated(pairs: DataFrame, classes: DataFrame, like: Similar, k: int) -> DataFrame:
    """The pairs whose union sketch doesn't rule similarity out."""
    side = lambda name, s: classes.select(F.col("node").alias(name), F.col("sketch").alias(s))
    both = pairs.join(side("b", "sb"), "b").join(side("a", "sa"), "a")
    both = both.withColumn("union", F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k))
    both = both.withColumn("last", F.element_at("union", -1))
    common = F.size(F.filter(F.array_intersect("sa", "sb"), lambda v: v <= F.col("last")))
    size = F.size("union")
    return both.where(common >= size * like.t - 5 * F.sqrt(size * (like.t * (1 - like.t)))).select("a", "b")


def _in_mixed_lists(entries: DataFrame, lists: DataFrame, known: DataFrame) -> DataFrame:
    """The nodes of the lists that hold more than one component."""
    named = entries.select("value", "node").join(known, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kinds = named.groupBy("value").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most")
    kinds = written(kinds.join(lists.select("value", "size"), "value"), "mixed-lists")
    met = _join_values(named.select("value", "node"), kinds, "size", entries.count())
    return written(met.where("size is not null").select("node").distinct(), "mixed-nodes")


def _deep_pairs(sets: DataFrame, nodes: DataFrame, known: DataFrame, like: Similar, deep: int) -> DataFrame:
    """Pairs of different components from deep sketches of some nodes.

    ``sets`` has (node, shingles), ``known`` (node, component). The larger set looks for the smaller one
    under the value and a band of sizes, so only sizes and ranks that allow a link meet.
    """
    some = sets.join(nodes, "node", "left_semi")
    sketches = some.select("node", F.size("shingles").cast("long").alias("n"), F.slice("shingles", 1, deep).alias("sketch"))
    entries = listed(written(sketches, "deep-sketches"), like, deep).join(known, "node", "left")
    n, rank = F.col("n"), F.col("rank")
    entries = entries.withColumn("component", F.coalesce("component", "node")).withColumn("partner", like.partner(n, rank, deep))
    entries = written(entries, "deep-lists")
    held = entries.groupBy("value", "component").agg(F.count("*").alias("c"))
    lists = held.groupBy("value").agg(F.max_by("component", "c").alias("main"), F.count("*").alias("parts"), F.sum("c").alias("size"))
    lists = written(lists.where("parts > 1").select("value", "main", "size"), "deep-sizes")
    entries = _join_values(entries, lists, "size", entries.count()).where("main is not null")
    entries = entries.withColumn("in_main", F.col("component") == F.col("main"))
    band = lambda c: F.floor(F.log(F.greatest(c.cast("double"), F.lit(1.0))) / math.log(1.02)).cast("int")
    least = F.ceil(n * like.percent / 100)
    top = F.least(n, F.col("partner"))
    looks = entries.where(top >= least).select(
        "value", F.col("node").alias("a"), F.col("n").alias("na"), "in_main", F.col("component").alias("ca"),
        F.col("partner").alias("pa"), F.explode(F.sequence(band(least), band(top))).alias("band"),
    )
    found = entries.where(F.col("partner") >= n).select(
        "value", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("in_main").alias("main_b"),
        F.col("component").alias("cb"), F.col("partner").alias("pb"), band(n).alias("band"),
    )
    fits = F.expr("ca <> cb and nb <= na and nb <= pa and na <= pb and (nb < na or b < a)")
    rest = looks.where("not in_main").join(found, ["value", "band"]).where(fits)
    main = looks.where("in_main").join(found.where("not main_b"), ["value", "band"]).where(fits)
    return rest.unionByName(main).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 85,
    words: int = WORDS,
    k: int = SKETCH,
    deep: int = DEEP,
) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the smallest id it is linked with), kept."""
    like = Similar(percent)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = written(sketched(texts, words, k), "sketches")
    classes = (
        known.where("n > 0 and id is not null")
        .groupBy("key")
        .agg(F.min("id").alias("node"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    classes = written(classes, "classes")
    entries = written(listed(classes, like, k), "lists")
    pivot = F.min(F.struct((-F.col("spread")).alias("narrow"), "node"))["node"]
    lists = written(entries.groupBy("value").agg(F.count("*").alias("size"), pivot.alias("pivot")).where("size > 1"), "list-sizes")
    pairs = written(_estimated(_star_pairs(entries, lists), classes, like, k), "candidates")
    members = _join_values(entries.select("value", "node"), lists, "size", entries.count()).where("pivot is not null")
    # Sorted and merged at every size: a broadcast of the wanted ids would do for small inputs only.
    wanted = texts.join(members.select(F.col("node").alias("id")).distinct().hint("merge"), "id", "left_semi")
    sets = written(full_sets(wanted, words), "sets")
    links = written(_near(sets, like, pairs), "links")
    first = written(components(links), "first-components")
    deeper = _estimated(_deep_pairs(sets, _in_mixed_lists(entries, lists, first), first, like, deep), classes, like, k)
    deeper = written(_near(sets, like, written(deeper, "deep-candidates")), "deep-links")
    # The first components stand for their links: stars, which only the deep links join.
    links = first.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(deeper)
    named = components(links).withColumnRenamed("component", "__c")
    groups = classes.select("key", "size", "node").join(named, "node", "left")
    groups = groups.select("key", "size", F.coalesce("__c", "node").alias("component_id"))
    groups = written(groups.where("size > 1 or component_id is not null"), "components")
    linked = known.select("id", "n", F.when(F.expr("n > 0 and id is not null"), F.col("key")).alias("key"))
    found = join_groups(linked.where("key is not null"), groups, "key", "size", known.count())
    alone = linked.where("key is null").select("id", "n", F.col("id").alias("component_id"))
    found = found.select("id", "n", "component_id").unionByName(alone)
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("component_id").eqNullSafe(F.col("id")).alias("kept"),
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns.

    Here a document is an id, null or not, with a text: rows that repeat both stay or go together, and other
    rows of the same id are other documents. The smallest id stays, a null one comes last.
    """
    rows = numbered(docs)
    given, text = F.col("doc")[id_col], F.col("doc")[text_col]
    name = F.struct(given.isNull().alias("no"), given.alias("id"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"))
    linked = near_groups(rows.select("row", text.alias("text")), "row", "text", percent).select("row", "component_id")
    found = written(linked.join(rows.select("row", name.alias("name")), "row"), "near")
    best = found.groupBy("component_id").agg(F.min("name").alias("best"), F.count("*").alias("size")).where("size > 1")
    gone = join_groups(found, written(best, "near-best"), "component_id", "size", found.count()).where("name <> best")
    return rows.join(gone.select("row"), "row", "left_anti").select("doc.*")
