"""The pipeline's rows, and op1's counts and votes, against plain Python."""

import random
import re
import struct
from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import pii, quality_rules
from gridloom.llm.queries import QUERIES, WORD_BPE, tokenizer

KIND = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = " \t\n\x0b\x0c\r"


def counts(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(SPACES)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": sum(lines[i] in lines[:i] for i in range(len(lines))), "n_repeat_words": len(again),
        "upper": sum(w.isupper() for w in words if len(w) > 1), "letters": sum(w.isalpha() or w[:-1].isalpha() for w in words),
        "lines": len(lines), "distinct": len(set(words)), "echoes": sum(a == b for a, b in zip(words, words[1:], strict=False)),
    }


def votes(c):
    n = c["n_words"]
    share = lambda part, whole="n_words": (lambda sign, p: 100 * c[part] > p * c[whole] if sign == ">" else 100 * c[part] < p * c[whole])
    sym, up, let, rep, echo = share("n_symbols"), share("upper"), share("letters"), share("n_repeat_words"), share("echoes")
    pairs = [
        (False, sym(">", 20)), (False, up(">", 30)), (let(">", 85) and echo("<", 10), let("<", 65)), (False, rep(">", 20)), (False, echo(">", 25)),
        (False, share("distinct")("<", 12) and n < 2000), (False, share("n_dup_lines", "lines")(">", 30)), (False, c["word_chars"] < 2 * n or c["word_chars"] > 15 * n),
        (sym("<", 5) and up("<", 10) and let(">", 75) and rep("<", 10) and echo("<", 10), (sym(">", 12) or up(">", 20)) and let("<", 75) or echo(">", 25)),
    ]
    return tuple(-1 if bad else int(good) for good, bad in pairs)


def judged(rows):
    """{place: (counts, failed, kept)} by the two-class mixture of independent votes, estimated in plain loops."""
    seen = [counts(t) for _, t, *_ in rows]
    cast = [votes(c) for c in seen]
    pattern = Counter(cast)
    prior, p = 0.8, {True: [[0.05, 0.6, 0.35]] * 9, False: [[0.35, 0.6, 0.05]] * 9}
    post = {}
    for _ in range(500):
        for v in pattern:
            odds = {k: np.log(prior if k else 1 - prior) + sum(np.log(p[k][r][x + 1]) for r, x in enumerate(v)) for k in (True, False)}
            post[v] = 1 / (1 + np.exp(odds[False] - odds[True]))
        weight = {k: {v: n * (post[v] if k else 1 - post[v]) for v, n in pattern.items()} for k in (True, False)}
        prior = (sum(weight[True].values()) + 8) / (len(rows) + 10)
        for k in (True, False):
            made = [[1 + sum(w for v, w in weight[k].items() if v[r] == x) for x in (-1, 0, 1)] for r in range(9)]
            p[k] = [[x / sum(m) for x in m] for m in made]
    out = {}
    for i, (c, v) in enumerate(zip(seen, cast, strict=True)):
        odds = np.log(prior / (1 - prior)) + sum(np.log(p[True][r][x + 1] / p[False][r][x + 1]) for r, x in enumerate(v))
        failed = c["n_words"] < 20 or 100 * c["n_repeat_words"] > 30 * c["n_words"]
        out[i] = (c, failed, not failed and odds >= 0)
    return out


def planted():
    rng = random.Random(16)
    vocabulary = ["".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    prose = lambda n: (" ".join(rng.choice(vocabulary) for _ in range(n)) + ".").capitalize()
    texts = [prose(rng.randint(25, 300)) for _ in range(80)]
    texts += [t.replace(" ", rng.choice([" ", "  ", "\n"])) for t in texts[:10]]
    texts += [" ".join([*t.split()[:-2], "altered", "ending."]) for t in texts[20:40] if len(t.split()) > 120]
    texts += [" ".join(rng.choice(["###", "$$", "BUY", "NOW|", "%%"]) for _ in range(60)) for _ in range(12)]
    texts += [prose(40) + " Write to jo.doe@mail.example.org or call +49 (30) 1234-567 now. " + prose(20) for _ in range(3)]
    texts += [prose(6), "", None, "same line of text here\n" * 30, "word " * 50]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


def kept_rows(rows):
    verdict = judged(rows)
    rows = [r for i, r in enumerate(rows) if verdict[i][2]]
    best = {}
    for r in rows:
        key = re.sub("[\x20\x09-\x0d]", "", r[1])
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x[1]), x[0]))
    rows = sorted(best.values())
    sets = {}
    for r in rows:
        words = r[1].lower().split()
        sets[r[0]] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    top = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = (min(top[a], top[b]), max(top[a], top[b]))
                top = {k: x if v == y else v for k, v in top.items()}
    return [r for r in rows if top[r[0]] == r[0]]


def test_pipeline_against_brute_force(spark, tmp_path):
    rows = planted()
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = kept_rows(rows)
    assert 60 < len(expected) < len(rows) - 20
    one = Tokenizer.from_file(tokenizer(WORD_BPE))
    ids, lengths = {}, Counter()
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        ids[p["doc_id"]] = ids.get(p["doc_id"], b"") + p["ids"]
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == lengths[p["sequence_id"]]
        lengths[p["sequence_id"]] += p["length"]
    assert max(lengths.values()) <= 4096
    clean = {}
    for i, text, *_ in expected:
        text = re.sub(r"jo\.doe@mail\.example\.org", "[EMAIL]", text)
        clean[i] = re.sub(r"\+49 \(30\) 1234-567", "[PHONE]", text)
    assert any("[EMAIL]" in t for t in clean.values())
    assert {i: list(struct.unpack(f"<{len(x) // 4}I", x)) for i, x in ids.items()} == {i: [*one.encode(t, add_special_tokens=False).ids, 2] for i, t in clean.items()}


def test_op1_against_brute_force(spark, tmp_path):
    rows = planted()
    spark.createDataFrame(rows, KIND).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in QUERIES["op1_quality_rules"](spark, str(tmp_path)).collect()}
    for i, (c, failed, kept) in judged(rows).items():
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, kept), rows[i]
        assert all(got[i][k] == c[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))


def test_rates_of_one_sided_rules_are_found():
    """Rules that only ever vote against: how often they do, given a bad document, comes out whatever it is."""
    rng = np.random.default_rng(17)
    good = rng.random(60_000) < 0.8
    true = np.linspace(0.1, 0.9, 7)
    cast = [-(rng.random(len(good)) < np.where(good, 0.01, t)).astype(int) for t in true]
    for _ in range(2):
        u = rng.random(len(good))
        cast.append(np.where(good, np.where(u < 0.8, 1, np.where(u < 0.9, 0, -1)), np.where(u < 0.6, -1, np.where(u < 0.8, 0, 1))))
    patterns, n = np.unique(np.stack(cast, axis=1), axis=0, return_counts=True)
    model = quality_rules.fit_counts(patterns, n.astype(float))
    assert abs(model.prior - 0.8) < 0.02
    assert all(abs(model.bad[r][0] - t) < 0.05 and abs(model.good[r][0] - 0.01) < 0.02 for r, t in enumerate(true))


def test_context_words_after_a_match(spark):
    frame = spark.createDataFrame([(1, "123-45-6789 is my ssn"), (2, "123-45-6789 is my number")], "doc_id long, text string")
    assert {r["doc_id"]: len(r["spans"]) for r in pii.find(frame).collect()} == {1: 1, 2: 0}
