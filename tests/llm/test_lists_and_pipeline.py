import random
from datetime import datetime, timedelta

import corpus_pipeline
from gridloom.llm import quality_rules, url_filters


def test_intervals_against_brute_force(spark):
    rng = random.Random(10)
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    log = [(rng.choice(["a.org", "b.a.org", "c.net/x", "c.net/x/y", "net"]), rng.choice(["s", "t"]), day(rng.randrange(30)), rng.random() < 0.6) for _ in range(60)]
    urls = ["http://a.org/", "https://b.a.org:80/q?x", "http://C.NET/x/y/z", "http://c.net/x", "http://c.net/xx", "http://u@net", "//a.org.evil.com", "nonsense", "", None]
    captures = [(i, rng.choice(urls), day(rng.randrange(35))) for i in range(300)] + [(999, "http://a.org", None)]
    keys = {"http://a.org/": ["a.org"], "https://b.a.org:80/q?x": ["b.a.org", "a.org"], "http://C.NET/x/y/z": ["net", "c.net/x", "c.net/x/y"], "http://c.net/x": ["net", "c.net/x"], "http://c.net/xx": ["net"], "http://u@net": ["net"]}

    def active(url, at):
        n = 0
        for key in keys.get(url, []):
            for category in "st":
                past = [(a, added) for e, c, a, added in log if e == key and c == category and at is not None and a <= at]
                n += bool(past) and max(past)[1]
        return n

    got = url_filters.judged(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp"), spark.createDataFrame(log, "entry string, category string, at timestamp, added boolean"))
    rows = got.collect()
    assert len(rows) == len(captures)
    assert {r["page_id"]: (r["n_active"], r["allowed"]) for r in rows} == {i: (active(u, t), active(u, t) == 0) for i, u, t in captures}
    empty = spark.createDataFrame([], "entry string, category string, at timestamp, added boolean")
    assert url_filters.judged(spark.createDataFrame(captures, "page_id long, url string, fetched_at timestamp"), empty).where("not allowed").count() == 0


def test_stages_keep_columns_and_take_odd_rows(spark, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, docs, str(tmp_path))
        assert done.columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    done = corpus_pipeline.run(spark, str(tmp_path))
    assert done.columns == ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    kept = quality_rules.keep_good(docs)  # none of the odd rows is a copy of another but the repeated ones
    assert {r[0] for r in done.select("doc_id").collect()} == {r[0] for r in kept.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "pii", "packing"]
