"""The registered queries of this subpackage and, where SQL can express one, its SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_bpe, exact_dedup, language_id, line_dedup, lm_scoring, near_dedup, packing, pii, quality_rules, url_filters
from .common import table, written

#: Vocabulary files lie with an installed package, at the same place on every executor; see tokenizer().
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _register(name, sql=None):
    def keep(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return keep


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_register("op1_quality_rules")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = written(quality_rules.with_counts(docs).drop("text"), "counts")
    found = quality_rules.judged(counted, quality_rules.fit(counted))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *[f"__counts.{c}" for c in base], "base_failed", "kept", "quality")


@_register("op2_packing")
def op2(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_register("op9_byte_bpe")
def op9(spark, sf_dir):
    import public_tokenizers

    digests = byte_bpe.digests_udf(tokenizer(BYTE_BPE), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", digests("text").alias("d"))
    return docs.select("doc_id", "d.*")


@_register(
    "op6_exact_dedup",
    r"""
    with t as (
      select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
      from documents
    )
    select doc_id,
           first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) as keep_id,
           count(*) over (partition by text_sha256) as group_size,
           first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id) = doc_id as kept,
           text_sha256
    from t
    """,
)
def op6(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@_register(
    "op5_line_dedup",
    r"""
    with l as (
      select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
      from documents
    ), k as (
      select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
      from l
    ), f as (
      select key, max(doc_id) as last_id from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5
    ), m as (
      select k.*, f.key is not null and k.doc_id <> f.last_id as lost from k left join f using (key)
    )
    select doc_id, count(*) as n_lines, count(*) filter (lost) as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not lost), '')) as kept_sha256
    from m group by doc_id
    """,
)
def op5(spark, sf_dir):
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@_register("op8_pii")
def op8(spark, sf_dir):
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = [k.name for k in pii.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(names))

    def count(name):
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")

    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{n}") for n in names],
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
    )


@_register("op4_near_dedup")
def op4(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"))


@_register("op7_language_id")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    profiles = language_id.learned(docs.where(~held_out))
    found = language_id.identified(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "language.*")


@_register("op10_lm_scoring")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.scored_whole(docs, good).select("doc_id", "lm.*")


#: The query's list, as (entry, category, date, added): the tables hold none. Pages are taken to have been
#: fetched one after another, a minute apart and a year round, from FIRST_FETCH on.
LIST_LOG = (
    ("cheap-pills.example.com", "spam", "2024-01-01", True),
    ("cheap-pills.example.com", "spam", "2024-05-01", False),
    ("cheap-pills.example.com", "spam", "2024-09-01", True),
    ("ads-track.example.org", "ads", "2024-02-01", True),
    ("https://WWW.Ads-Track.example.org/en/", "tracking", "2024-03-01", True),
    ("example.net", "abuse", "2024-04-01", True),
    ("example.net", "abuse", "2024-04-11", False),
    ("example.net", "abuse", "2024-10-01", True),
    ("example.net", "abuse", "2024-10-06", False),
    ("tionsh.example.net", "malware", "2024-04-05", True),
    ("tionsh.example.net", "malware", "2024-04-05", False),
    ("tionsh.example.net", "malware", "2024-07-15", False),
    ("tionsh.example.net/de", "spam", "2024-06-01", True),
    ("tionsh.example.net/de", "spam", "2024-06-20", True),
    ("tionsh.example.net/de", "spam", "2024-08-01", False),
    ("ththth.example.org", "spam", "2024-03-10", True),
    ("ththth.example.org", "ads", "2024-03-20", True),
    ("ththth.example.org", "spam", "2024-11-10", False),
)
FIRST_FETCH = "2024-01-01"
_LOG_ROWS = ", ".join(f"('{e}', '{c}', timestamp '{d} 00:00:00', {str(a).lower()})" for e, c, d, a in LIST_LOG)


@_register(
    "op3_url_filters",
    rf"""
    with log as (
      select regexp_replace(regexp_replace(entry, '^https?://', ''), '/+$', '') as entry, category, moment, added
      from (values {_LOG_ROWS}) as v(entry, category, moment, added)
    ), named as (
      select lower(split_part(entry, '/', 1)) || substr(entry, length(split_part(entry, '/', 1)) + 1) as key, category, moment, bool_or(added) as added
      from log group by all
    ), changes as (
      select *, lag(added) over (partition by key, category order by moment) as before from named
    ), spans as (
      select key, category, added, moment as since, lead(moment) over (partition by key, category order by moment) as until
      from changes where added <> coalesce(before, false)
    ), captures as (
      select page_id, url, timestamp '{FIRST_FETCH} 00:00:00' + to_minutes(page_id % 527040) as fetched_at,
             lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host,
             regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) || '/' as path
      from pages
    ), met as (
      select c.page_id, s.key, s.category
      from captures c, spans s
      where s.added and s.since <= c.fetched_at and (s.until is null or c.fetched_at < s.until)
        and case when contains(s.key, '/') then starts_with(c.host || c.path, s.key || '/')
                 else c.host = s.key or ends_with(c.host, '.' || s.key) end
    ), best as (
      select *, count(*) over (partition by page_id) as n_active,
             row_number() over (partition by page_id order by length(regexp_replace(key, '[^/]', '', 'g')) desc,
                                length(regexp_replace(key, '[^.]', '', 'g')) desc, key, category) as place
      from met
    )
    select c.page_id, c.host, c.fetched_at, coalesce(b.n_active, 0) as n_active, b.key as listed_key, b.category, b.key is null as allowed
    from captures c left join best b on b.page_id = c.page_id and b.place = 1
    """,
)
def op3(spark, sf_dir):
    log = spark.sql(f"select * from values {_LOG_ROWS} as v(entry, category, at, added)")
    minutes = F.make_dt_interval(F.lit(0), F.lit(0), (F.col("page_id") % 527040).cast("int"))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", (F.lit(f"{FIRST_FETCH} 00:00:00").cast("timestamp") + minutes).alias("fetched_at"))
    found = url_filters.judged(pages, log)
    return found.select("page_id", url_filters.host_of(F.col("url")).alias("host"), "fetched_at", "n_active", "listed_key", "category", "allowed")
