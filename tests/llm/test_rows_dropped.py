"""What the stages drop are rows, whatever their ids."""

import random

from gridloom.llm import exact_dedup, near_dedup

KIND = "doc_id long, text string, n long"


def test_exact_copies_go_by_row(spark):
    rows = [(1, "alpha", 0), (None, "alpha", 1), (None, "beta", 2), (7, "gamma", 3), (8, "alpha", 4), (8, "delta", 5), (9, "eps", 6), (9, "eps", 7), (None, "zeta", 8), (None, "ze ta", 9), (None, "zeta", 10)]
    kept = exact_dedup.drop_copies(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(r["n"] for r in kept if r["text"] not in ("eps",)) == [0, 2, 3, 5, 9]
    assert [r["text"] for r in kept].count("eps") == 1 and len(kept) == 6


def test_near_copies_go_by_row(spark):
    rng = random.Random(13)
    long = lambda: [f"w{rng.randrange(10**6)}" for _ in range(120)]
    a, b, c, d = long(), long(), long(), long()
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a), 0), (5, near(a), 1), (5, " ".join(b), 2), (None, " ".join(c), 3), (6, near(c), 4), (None, " ".join(d), 5), (5, " ".join(b), 6), (2, None, 7), (2, "", 8)]
    kept = near_dedup.drop_near(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(r["n"] for r in kept) == [0, 2, 4, 5, 6, 7, 8]
