"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A normalised text is cut where its own characters say so, so equal texts have equal chunks in equal
order. Each chunk gets a 64-bit identifier; an identifier is verified by the chunk's SHA-256, and where
two chunks share one, theirs are replaced. Texts are equal when their ordered identifier lists are. Texts
themselves are read once and never shuffled: a recipe is a small fraction of its text.

Defined results: null text is the empty text, and all empty texts are equal. A null id comes last among
ties. Rows that repeat both id and text are one document in two rows, and both get the same answer.
An empty table gives an empty table. Columns other than id and text are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_groups, numbered, written


def _every(of: int, at: int) -> str:
    """A character class of one in ``of`` letters and signs, for Latin, Greek, Cyrillic and the first CJK pages."""
    return "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x21, 0x600) if c % of == at) + "]"


def cut_pattern(least: int = 1024, most: int = 8192) -> str:
    """Shortest run of ``least`` characters or more that ends in a cutting pair, else up to ``most``."""
    return f"(?s).{{{least - 2},{most - 2}}}?{_every(8, 5)}{_every(8, 1)}|.{{1,{most}}}"


def squeezed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", "")


def recipes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts: str | None = None, id_bits: int = 64
) -> DataFrame:
    """(id, n_code_points, text_sha256, chunks): chunks holds an identifier and a digest for each chunk.

    ``id_bits`` shortens identifiers, for tests that need two chunks to share one.
    """
    short = (lambda c: F.xxhash64(c)) if id_bits == 64 else (lambda c: F.pmod(F.xxhash64(c), F.lit(1 << id_bits)))
    text = docs.select(
        F.col(id_col).alias("id"),
        F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_code_points"),
        squeezed(F.col(text_col)).alias("norm"),
    )
    cut = text.withColumn("cut", F.regexp_extract_all("norm", F.lit(cuts or cut_pattern()), F.lit(0)))
    return cut.select(
        "id",
        "n_code_points",
        F.sha2("norm", 256).alias("text_sha256"),
        F.transform("cut", lambda c: F.struct(short(c).alias("chunk"), F.unhex(F.sha2(c, 256)).alias("digest"))).alias("chunks"),
    )


def _settle(known: DataFrame) -> DataFrame:
    """Add recipe, the ordered list of verified identifiers, as strings."""
    pieces = known.select(F.explode("chunks").alias("c")).select("c.chunk", "c.digest")
    shared = pieces.groupBy("chunk").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    shared = written(shared.select("chunk"), "shared-identifiers")
    plain = F.transform("chunks", lambda c: c["chunk"].cast("string"))
    if shared.isEmpty():
        return known.withColumn("recipe", plain)
    # A few identifiers stand for more than one chunk: documents with such a chunk name it by digest.
    named = known.withColumn("row", F.sha2(F.to_json(F.struct("id", "text_sha256", "n_code_points")), 256))
    hit = (
        named.select("row", F.explode("chunks").alias("c"))
        .select("row", F.col("c.chunk").alias("chunk"))
        .distinct()
        .join(shared, "chunk", "left_semi")
        .groupBy("row")
        .agg(F.collect_set("chunk").alias("twice"))
    )
    name = F.transform(
        "chunks",
        lambda c: F.when(F.array_contains(F.coalesce("twice", F.array().cast("array<bigint>")), c["chunk"]), F.hex(c["digest"])).otherwise(
            c["chunk"].cast("string")
        ),
    )
    return named.join(hit, "row", "left").withColumn("recipe", name).drop("row", "twice")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cuts: str | None = None, id_bits: int = 64
) -> DataFrame:
    """One row a document: id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with most code points stays, then the one with the smallest id.
    """
    known = written(recipes(docs, id_col, text_col, cuts, id_bits), "recipes")
    listed = _settle(known).select(
        "id", "n_code_points", "text_sha256", "recipe", F.sha2(F.array_join("recipe", ","), 256).alias("recipe_key")
    )
    best = F.min(F.struct((-F.col("n_code_points")).alias("n"), F.col("id").isNull().alias("no"), F.col("id").alias("id")))
    groups = (
        listed.groupBy("recipe_key", "recipe")
        .agg(best.alias("best"), F.count("*").alias("group_size"))
        .where("group_size > 1")
        .select("recipe_key", F.col("best.id").alias("keep_id"), "group_size")
    )
    groups = written(groups, "copies")
    found = join_groups(listed.drop("recipe"), groups, "recipe_key", "group_size", known.count())
    alone = F.col("group_size").isNull()
    found = found.withColumn("keep_id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")))
    return found.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("keep_id").eqNullSafe(F.col("id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of copies, with all their columns; only numbers of dropped rows move.

    Rows are told apart by a number each, so that null and repeated ids are as good as any: of rows that tie
    in length and id too, one stays.
    """
    rows = numbered(docs)
    given = F.col("doc")[id_col]
    named = rows.select(F.struct(given.isNull().alias("no"), given.alias("id"), "row").alias("id"), F.col("doc")[text_col].alias("text"))
    gone = exact_groups(named, "id", "text").where("not kept").select("id.row")
    return rows.join(gone, "row", "left_anti").select("doc.*")
