"""op10's models against plain Python: every word and every pair counts, however rare."""

import math
import os
import random
from collections import Counter

from pyspark.sql import functions as F

from gridloom.llm import lm_scoring
from gridloom.llm.common import shared_dir


def brute_scores(rows, good):
    texts = [(i, lm_scoring.words_of(t)) for i, t in rows]
    pairs = {False: Counter(), True: Counter()}
    for i, words in texts:
        for p in zip([None, *words], words, strict=False):
            pairs[False][p] += 1
            pairs[True][p] += i in good
    vocabulary = {w for _, words in texts for w in words}

    def model(counts):
        counts = +counts
        single, total, follow = Counter(), Counter(), Counter()
        for (a, b), n in counts.items():
            single[b] += n
            total[a] += n
            follow[a] += 1
        kinds, every = len(single), sum(single.values())
        base = lambda b: (single[b] + kinds / len(vocabulary)) / (every + kinds) if kinds else 1 / len(vocabulary)
        return lambda a, b: math.log((counts[a, b] + follow[a] * base(b)) / (total[a] + follow[a]) if total[a] else base(b))

    background, target = model(pairs[False]), model(pairs[True])
    found = []
    for i, words in texts:
        score = sum(target(a, b) - background(a, b) for a, b in zip([None, *words], words, strict=False)) / len(words) if words else None
        found.append((i, len(words), score))
    return found


def same(rows, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    rows, expected = sorted(map(tuple, rows), key=key), sorted(expected, key=key)
    assert [r[:2] for r in rows] == [r[:2] for r in expected]
    assert all(a == b if b is None else abs(a - b) < 2e-6 for (*_, a), (*_, b) in zip(rows, expected, strict=True))


def test_every_word_counts(spark, odd):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(6000)]
    rows = [(i, " ".join(rng.choice(words) if rng.random() < 0.7 else "The" for _ in range(200))) for i in range(120)]
    rows += [(3, rows[3][1]), (3, "another text"), (None, "w1 w2"), (501, None), (502, " \n"), (503, "x" * 100 + " the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for good in (set(range(0, 60, 2)) | {3}, set()):
        labels = spark.createDataFrame([(i,) for i in good] + [(None,)], "doc_id long")
        same(lm_scoring.scored_whole(docs, labels).select("doc_id", "lm.*").collect(), brute_scores(rows, good))
    assert lm_scoring.scored_whole(docs.limit(0), labels).count() == 0
    plain = odd.select("doc_id", "text")
    same(lm_scoring.scored_whole(plain, plain.where("doc_id = 1")).select("doc_id", "lm.*").collect(), brute_scores([tuple(r) for r in plain.collect()], {1}))


def test_query_tells_rare_words_apart(spark, tmp_path):
    """Words beyond the 2,047 most frequent must move op10's score."""
    rows = [(i, " ".join(f"c{k}" for k in range(i * 30, i * 30 + 30))) for i in range(100)]
    rows += [(200 + i, "rarea rareb rarec") for i in range(2)] + [(210 + i, "rared raree raref") for i in range(2)]
    rows += [(300 + i, " ".join(f"c{k}" for k in range(3000))) for i in range(3)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(200, 1, 0), (201, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    from gridloom.llm.queries import QUERIES

    got = {r["doc_id"]: r["score"] for r in QUERIES["op10_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[200] > got[210]
    same([(i, len(t.split()), got[i]) for i, t in rows], brute_scores(rows, {200, 201}))


def size_of(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_tables_take_no_more_than_the_texts(spark):
    """Rare pairs take some bytes each, not rows of names: what op10 keeps on shared storage is less than its input."""
    rng = random.Random(23)
    rows = [(i, " ".join(f"w{rng.randrange(30_000)}" for _ in range(300))) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()
    folder = shared_dir(spark).removeprefix("file:")
    before = size_of(folder)
    assert lm_scoring.scored_whole(docs, docs.where("doc_id < 500")).count() == 2000
    assert size_of(folder) - before < sum(len(t) for _, t in rows)


def test_blocks_and_buckets_of_any_size(spark, monkeypatch):
    """Documents of one block or many, and keys of few buckets or many, get the same scores; ids may be strings."""
    rng = random.Random(5)
    rows = [(rng.choice([f"d{i}", None]), " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(30)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").coalesce(2)
    good = {i for i, _ in rows[::7] if i}
    labels = spark.createDataFrame([(i,) for i in good], "doc_id string")
    got = []
    for buckets in (1, 300):
        monkeypatch.setattr(lm_scoring, "BUCKETS", buckets)
        got.append(sorted(map(tuple, lm_scoring.scored_whole(docs, labels).select("doc_id", "lm.*").collect()), key=str))
    assert got[0] == got[1]
    expected = sorted(brute_scores(rows, good), key=str)
    assert sorted((str(a), b) for a, b, _ in got[0]) == sorted((str(a), b) for a, b, _ in expected)
    assert abs(sum(c or 0 for *_, c in got[0]) - sum(c or 0 for *_, c in expected)) < 3e-4
    texts = spark.createDataFrame(rows, "id string, text string").coalesce(1).withColumn("target", F.lit(True))
    many = lm_scoring.text_blocks(texts, 500, 40).collect()
    assert len({r["block"] for r in many}) == len(many) > 7 and sorted(map(str, (i for r in many for i in r["ids"]))) == sorted(str(i) for i, _ in rows)
    assert max(len(r["ids"]) for r in many) <= 40
