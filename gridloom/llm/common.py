"""What the operators share: tables on shared storage, joins that survive hot keys, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: With it, an execution's shuffle files go when it ends; without, when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a folder of this machine only where none is named."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Executions begun herein leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(frame: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, lost executors cost nothing.

    The table is removed when the driver's JVM ends, the shuffle files that its making took as soon as it is written.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/gridloom-{what}-{uuid.uuid4().hex}"
    with tidy(spark):
        frame.write.parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(frame.schema).parquet(path)


def with_results(docs: DataFrame, results: dict[str, Column]) -> DataFrame:
    """docs with further columns. A column of docs that has a result's name stays, with ``_given`` put behind its name."""
    taken = {c.lower() for c in (*docs.columns, *results)}

    def free(name: str) -> str:
        while name.lower() in taken:
            name += "_given"
        taken.add(name.lower())
        return name

    named = {r.lower() for r in results}
    kept = [F.col(f"`{c}`").alias(free(c) if c.lower() in named else c) for c in docs.columns]
    return docs.select(*kept, *[v.alias(r) for r, v in results.items()])


def numbered(docs: DataFrame) -> DataFrame:
    """(row, doc): the rows of docs, each as a struct beside a number of its own, as a table on shared storage."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "numbered")


_HELD: dict = {}


def held(key, make):
    """What an operator remembers in a Python worker from task to task.

    A worker remembers for one operator at a time: the first task of another one frees the memory.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


#: A key counts as heavy when it holds more than one row in this many; so at most this many keys are heavy.
HEAVY = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], size: str, total: int) -> DataFrame:
    """Left join of rows to groups on one or more key columns, where some keys hold a large part of all rows.

    ``groups`` has one row a key, ``size`` is its number of rows, and the sizes add up to ``total`` at most.
    Fewer than HEAVY keys can be heavy whatever the input, so these are broadcast and their rows never
    meet in one task; no other key has more than one row in HEAVY.
    """
    heavy = F.col(size) * HEAVY > F.lit(total)
    hot = F.broadcast(groups.where(heavy))
    first = rows.join(hot, key, "inner")
    rest = rows.join(hot.select(*([key] if isinstance(key, str) else key)), key, "left_anti").join(groups.where(~heavy), key, "left")
    return first.unionByName(rest)


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; texts of ASCII alone take the faster function."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an undirected graph; a component's name is its smallest node.

    Alternating large-star and small-star steps until only stars are left; the edges are a table on shared
    storage after each step, and nothing goes to the driver but a count.
    """
    known = written(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )

    def strays(edges: DataFrame) -> int:
        """How many upper ends are a lower end too or have more than one; without any, each lower end is its component's smallest."""
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("ups"), F.lit(0).alias("low"))
        ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("ups"), F.lit(1).alias("low")))
        ends = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.max("low").alias("low"))
        with tidy(edges.sparkSession):
            return ends.where("ups > 1 or ups = 1 and low = 1").agg(F.count("*")).first()[0]

    while strays(known):
        both = known.unionByName(known.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Tables on both sides of a join: then Spark splits the rows of a hub, which an aggregate beneath would forbid.
        low = written(both.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        large = (
            both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        )
        large = written(large.distinct(), "large-star")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "lowest")
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        known = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    tops = known.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return known.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops).distinct()
