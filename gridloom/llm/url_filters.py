"""Temporal list join: dated list entries become validity intervals, and every capture meets those of its time.

A list is a log: on a date an entry is added to a category or removed from it. A window turns the log of one
entry and category into disjoint intervals [since, until). An entry is a domain, which covers its subdomains,
or a domain with a path, which covers that host's paths below it. A capture's URL is expanded into the few
keys that could be listed: each parent domain, and the host with each leading part of the path down to the
depth of the deepest entry. Keys then meet intervals by equality and date, never entry by entry.

DataFrame functions only. Captures of one URL and moment are judged once. A key that more than one capture in
HEAVY has (a host may hold a third of all) is dealt over salts on both sides; only the names of such keys,
fewer than HEAVY times the keys of a URL, are broadcast. Pages themselves (html) are neither read nor moved.

Defined results: a null or empty URL, or one without a host, has no keys and is allowed. A null time meets no
interval. Entries with a null key, category or date are ignored. Of entries that repeat or contradict each
other at one moment, adding wins. Captures that repeat are each returned. An empty list allows everything; an
empty table gives an empty table. Other columns pass through; one that has a result's name gets ``_given``
behind its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HEAVY, join_groups, with_results, written


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and final dot; null where there is none."""
    host = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]+)", 1)
    host = F.regexp_replace(F.lower(host), r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Parts of the path, without query and fragment; empty parts don't count."""
    path = F.regexp_extract(F.trim(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.filter(F.split(path, "/"), lambda p: p != "")


def keys_of(url: Column, depth: int) -> Column:
    """All keys under which a list of this depth could name a URL."""
    labels = F.split(host_of(url), r"\.")
    places = F.sequence(F.lit(1), F.size(labels))
    domains = F.transform(places, lambda at: F.array_join(F.slice(labels, at, F.size(labels)), "."))
    parts = F.slice(path_of(url), 1, depth) if depth else F.array().cast("array<string>")
    places = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts))).otherwise(F.array().cast("array<int>"))
    paths = F.transform(places, lambda at: F.concat(host_of(url), F.lit("/"), F.array_join(F.slice(parts, 1, at), "/")))
    return F.when(host_of(url).isNotNull(), F.concat(domains, paths)).otherwise(F.array().cast("array<string>"))


def entry_key(entry: Column) -> Column:
    """A list entry (host, host/path or URL) as a key."""
    url = F.when(entry.contains("//"), entry).otherwise(F.concat(F.lit("//"), F.trim(entry)))
    return F.when(host_of(url).isNotNull(), F.array_join(F.concat(F.array(host_of(url)), path_of(url)), "/"))


def intervals(log: DataFrame) -> DataFrame:
    """(key, category, since, until) from a log of (entry, category, at, added); until is null while it holds."""
    each = log.select(entry_key(F.col("entry")).alias("key"), "category", "at", F.col("added").cast("boolean").alias("added"))
    each = each.dropna(subset=["key", "category", "at"]).groupBy("key", "category", "at").agg(F.max(F.coalesce("added", F.lit(False))).alias("added"))
    order = W.partitionBy("key", "category").orderBy("at")
    each = each.withColumn("before", F.lag("added").over(order)).where("added <> coalesce(before, false)")
    each = each.withColumn("until", F.lead("at").over(order))
    return each.where("added").select("key", "category", F.col("at").alias("since"), "until")


def _met(keyed: DataFrame, listed: DataFrame) -> DataFrame:
    """Captures' keys with the intervals that hold at their time, hot keys dealt over salts."""
    total = keyed.count()
    hot = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * HEAVY > total)
    hot = written(hot.select("key", F.ceil(F.col("n") * HEAVY / F.lit(max(total, 1))).cast("int").alias("salts")), "hot-keys")
    salts = F.coalesce("salts", F.lit(1))
    left = keyed.join(F.broadcast(hot), "key", "left").withColumn("salt", F.pmod(F.xxhash64("url", "at"), salts).cast("int")).drop("salts")
    right = listed.join(F.broadcast(hot), "key", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return left.join(right, ["key", "salt"]).where("since <= at and (until is null or at < until)")


def judged(captures: DataFrame, log: DataFrame, url_col: str = "url", at_col: str = "fetched_at") -> DataFrame:
    """captures with n_active (entries that hold), listed_key and category of the most specific, and allowed.

    The most specific entry has the most parts, then the first key, then the first category by name.
    """
    listed = written(intervals(log), "intervals")
    depth = listed.agg(F.max(F.size(F.split("key", "/")))).first()[0]
    once = captures.select(F.col(url_col).alias("url"), F.col(at_col).alias("at")).dropna().groupBy("url", "at").agg(F.count("*").alias("n"))
    keyed = once.withColumn("key", F.explode(keys_of(F.col("url"), (depth or 1) - 1))).join(listed.select("key").distinct(), "key", "left_semi")
    met = _met(written(keyed, "capture-keys"), listed)
    parts = F.size(F.split("key", "/")) * 1000 + F.size(F.split("key", r"\."))
    best = F.min(F.struct((-parts).alias("p"), "key", "category"))
    found = met.groupBy("url", "at").agg(F.count("*").alias("n_active"), best.alias("best"), F.first("n").alias("n"))
    found = found.select("url", "at", "n_active", F.col("best.key").alias("listed_key"), F.col("best.category").alias("category"), "n")
    found = written(found, "verdicts")
    rows = captures.select(F.struct("*").alias("doc"), F.col(url_col).alias("url"), F.col(at_col).alias("at"))
    done = join_groups(rows, found, ["url", "at"], "n", captures.count())
    active = F.coalesce("n_active", F.lit(0)).cast("long")
    made = {"n_active": active, "listed_key": F.col("listed_key"), "category": F.col("category"), "allowed": F.col("listed_key").isNull()}
    names = with_results(captures, dict.fromkeys(made, F.lit(None))).columns
    given = [F.col("doc")[c].alias(n) for c, n in zip(captures.columns, names, strict=False)]
    return done.select(*given, *[c.alias(n) for n, c in made.items()])
