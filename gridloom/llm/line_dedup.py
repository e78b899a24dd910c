"""Line deduplication: explode lines, hash, count documents a hash, drop, reassemble by position.

Only 16-byte hashes of lines and their positions are shuffled to find the lines to drop; texts move once,
to meet the positions that they lose. A key that a third of all documents hold is counted by partial
aggregation and joined by broadcast (see join_groups), so it never meets in one task.

Defined results: null text is one empty line. A null id is not a document in the count and never the
largest, so such a row loses its frequent lines. Rows that repeat an id and text count once and are both
returned. Texts that share an id count as one document. An empty table gives an empty table. Columns other
than id and text aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, join_groups, lower_ascii, written


def line_key(line: Column) -> Column:
    return lower_ascii(F.trim(line, F.lit(SPACES)))


def _row(id_col: Column, text: Column) -> Column:
    """A fixed-size name of a row's id and text."""
    return F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("-")), F.lit(":"), text))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """(id, text, n_lines, n_dropped) with the text that is left of each row.

    Keys of ``min_chars`` code points or more that ``min_docs`` documents or more hold lose all their lines
    but those in the largest id.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    named = base.withColumn("row", _row(F.col("id"), F.col("text")))
    lines = named.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    # A line shorter than the limit can't be a key: spare it the trim and the lower-casing.
    keyed = lines.where(F.length("line") >= min_chars).select("id", "row", "at", line_key(F.col("line")).alias("key"))
    keyed = keyed.where(F.length("key") >= min_chars).select("id", "row", "at", F.unhex(F.md5("key")).alias("hash"))
    keyed = written(keyed, "line-keys")
    each = keyed.groupBy("hash", "id").agg(F.count("*").alias("n"))
    common = (
        each.groupBy("hash")
        .agg(F.count("id").alias("n_docs"), F.sum("n").alias("n_rows"), F.max("id").alias("last_id"))
        .where(F.col("n_docs") >= min_docs)
    )
    common = written(common, "frequent-lines")
    lost = join_groups(keyed, common, "hash", "n_rows", keyed.count()).where("n_docs is not null and not (id <=> last_id)")
    lost = lost.groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("lost"))
    met = named.join(lost, "row", "left")
    every = F.split("text", "\n", -1)
    # The runs of lines between lost ones are cut out whole: a search for each line would take the square.
    marks = F.concat(F.array(F.lit(-1)), "lost", F.array(F.size("lines")))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("marks") - 2),
        lambda k: F.slice("lines", F.get("marks", k) + 2, F.get("marks", k + 1) - F.get("marks", k) - 1),
    )
    met = met.withColumn("lines", F.when(F.col("lost").isNotNull(), every)).withColumn("marks", marks)
    left = F.array_join(F.flatten(runs), "\n")
    return met.select(
        F.col("id").alias(id_col),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(left).alias(text_col),
        F.size(every).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.col("lost")), F.lit(0)).cast("long").alias("n_dropped"),
    )
