"""Columns that bear a result's name stay; language distances against plain Python; empty tables."""

from collections import Counter
from datetime import datetime

import public_tokenizers
import regex

from gridloom.llm import byte_bpe, language_id, packing, pii, quality_rules, url_filters
from gridloom.llm.queries import BYTE_BPE, WORD_BPE, tokenizer

PROSE = "the man said that he would come to the house and sit by the fire with us for a while this evening."
CLASH = "doc_id long, text string, kept string, quality string, base_failed string, __counts string, ids string, spans string, __text string, language string, n string"


def test_columns_of_the_results_names_stay(spark):
    rows = [(i, f"{PROSE} It was the year {i}." if i % 4 else "### $$$ %%% " * 20, *"abcdefghi") for i in range(40)]
    docs = spark.createDataFrame(rows, CLASH)
    kept = quality_rules.keep_good(docs)
    assert kept.schema == docs.schema and {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] % 4}
    found = pii.find(docs)
    assert found.columns == [*(c if c != "spans" else "spans_given" for c in docs.columns), "spans"]
    assert {tuple(r)[:-1] for r in found.collect()} == set(rows)
    ids = byte_bpe.encoded(docs, tokenizer(BYTE_BPE), public_tokenizers.PATTERN)
    assert {tuple(r)[:-1] for r in ids.collect()} == set(rows) and ids.columns[-1] == "ids" and "ids_given" in ids.columns
    named = language_id.identified(docs, language_id.learned(docs.withColumn("lang", docs["n"])))
    assert {tuple(r)[:-1] for r in named.collect()} == set(rows) and "language_given" in named.columns
    judged = quality_rules.judged(quality_rules.with_counts(docs), quality_rules.fit(quality_rules.with_counts(docs)))
    assert judged.count() == 40 and {"kept_given", "quality_given", "base_failed_given", "kept"} <= set(judged.columns)


def test_captures_with_any_columns(spark):
    at = datetime(2024, 1, 5)
    kind = "n long, category string, allowed string, doc string, url string, key string, fetched_at timestamp, listed_key string"
    rows = [(i, "c", "a", "d", u, "k", at, "l") for i, u in enumerate(["http://bad.org/x", "http://[2001:db8::1]:80/", None, "", "http://good.org", "http://good.org"])]
    rows.append((9, None, None, None, "http://bad.org/x", None, None, None))
    log = spark.createDataFrame([("bad.org", "spam", datetime(2024, 1, 1), True), ("http://[2001:db8::1]/", "ip", datetime(2024, 1, 1), True), (None, None, None, None)], "entry string, category string, at timestamp, added boolean")
    captures = spark.createDataFrame(rows, kind)
    got = url_filters.judged(captures, log)
    assert got.columns == ["n", "category_given", "allowed_given", "doc", "url", "key", "fetched_at", "listed_key_given", "n_active", "listed_key", "category", "allowed"]
    assert sorted((r["n"], r["allowed"], r["category"]) for r in got.collect() if r["category"] is None) == [(2, True, None), (3, True, None), (4, True, None), (5, True, None), (9, True, None)]
    assert sorted((r["n"], r["category"]) for r in got.collect() if r["category"]) == [(0, "spam"), (1, "ip")]
    assert url_filters.judged(captures.limit(0), log).count() == 0 and url_filters.judged(captures, log.limit(0)).where("not allowed").count() == 0


def grams(text):
    plain = " " + regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip(" ") + " "
    found = Counter(plain[i : i + n] for n in (1, 2, 3) for i in range(len(plain) - n + 1))
    found.pop(" ", None)
    return found


def ranked(counted, most):
    """By frequency; ties by code points, the shorter n-gram first."""
    return sorted(counted, key=lambda g: (-counted[g], len(g), g))[:most]


def test_language_distances_against_brute_force(spark):
    texts = [("aa", "Lorem ipsum dolor sit amet, lorem ipsum"), ("bb", "Stra\xdfe und \xfcber nicht schnell, und nicht"), ("aa", "dolor dolor amet 12"), ("bb", "ab ab ba"), ("cc", "ab ab ba")]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learned(docs, most=12)
    own = {lang: ranked(sum((grams(t) for x, t in texts if x == lang), Counter()), 12) for lang in ("aa", "bb", "cc")}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identified(docs, profiles).select("doc_id", "language.*").collect()}
    for i, text, _ in rows:
        mine = ranked(grams(text), 12)
        apart = {x: sum(abs(p.index(g) - k) if g in p else 12 for k, g in enumerate(mine)) for x, p in own.items()}
        best = min(sorted(apart), key=apart.get)
        assert got[i] == (best, round(1 - apart[best] / (12 * len(mine)), 6)), text


def test_empty_tables(spark, odd):
    none = odd.limit(0)
    assert byte_bpe.encoded(none, tokenizer(BYTE_BPE), public_tokenizers.PATTERN).count() == 0 == packing.pack(none, tokenizer(WORD_BPE)).count()
    assert language_id.identified(none, language_id.learned(none)).count() == 0 == pii.find(none).count()
    assert pii.find(odd).count() == 9 and "spans_given" in pii.find(odd).columns
