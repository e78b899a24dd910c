import hashlib
import random
import re
import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridloom.llm import byte_bpe, language_id, lm_scoring, packing, pii, quality_rules
from gridloom.llm.queries import BYTE_BPE, WORD_BPE, tokenizer

KIND = "doc_id long, text string"


def brute_repeats(words, window=8):
    seen = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(window)})


def test_repeated_words_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice("abc") for _ in range(rng.randint(0, 60))]
        assert quality_rules.repeated_words(words, {}) == brute_repeats(words)


def test_quality_rules(spark, odd):
    prose = "the man said that he would come to the house and sit by the fire with us for a while this evening."
    rng = random.Random(5)
    good = [(i, " ".join(rng.sample(prose.split(), 20)).capitalize() + ".") for i in range(80)]
    bad = [(100 + i, " ".join(rng.choice(["###", "$$$ %%", "BUY", "A*B|", "!!"]) for _ in range(40))) for i in range(30)]
    docs = spark.createDataFrame(good + bad, KIND)
    kept = {r[0] for r in quality_rules.keep_good(docs).select("doc_id").collect()}
    assert kept == {i for i, _ in good}
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.keep_good(odd.limit(0)).count() == 0


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["Alpha", "beta,", "d'accord", "x1", "\xdcber!"]) for _ in range(rng.choice([0, 5, 300, 5000])))) for i in range(40)] + [(99, None)]
    pieces = packing.pack(spark.createDataFrame(rows, KIND).repartition(5), tokenizer(WORD_BPE), size=512, open_windows=4).collect()
    one = Tokenizer.from_file(tokenizer(WORD_BPE))
    for i, text in rows:
        own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
        ids = b"".join(p["ids"] for p in own)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == [*one.encode(text or "", add_special_tokens=False).ids, 2]
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
    lengths = {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert lengths.get(p["sequence_id"], 0) == p["offset"]
        lengths[p["sequence_id"]] = p["offset"] + p["length"]
    assert max(lengths.values()) <= 512
    padding = sum(0 if n & (n - 1) == 0 else 512 - n for n in lengths.values())
    assert padding < 0.02 * sum(lengths.values())
    assert packing.pack(odd, tokenizer(WORD_BPE)).select("doc_id").distinct().count() == 8 and packing.pack(odd.limit(0), tokenizer(WORD_BPE)).count() == 0


def test_chunk_encoder_equals_the_tokenizer():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(15)
    bits = [*"aAbBz\xe9\xc9\xdf\xff\xc0\xd7\xf7\xb5\xaa\xba 0123.,;:!?-_'\"<>|#\n\t\x1c\x85\xa0\u0301\u4e2d\u0416\U0001f600\u0130\u03a3\u0152\ufb01\u2163\xbd\x00", "'s", "'LL", "don't", "the", "ing", "<|endoftext|>", "<|EndOfText|>"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["", None, "x" * 5000, "\xe9" * 40, "a" * 64, "a" * 65]
    one, own = Tokenizer.from_file(tokenizer(WORD_BPE)), packing.ChunkEncoder(tokenizer(WORD_BPE), 2, most=300)
    for size in (1, 500, 1 << 20):
        for text, raw in zip(texts, own.encode(pa.array(texts), size), strict=True):
            assert list(struct.unpack(f"<{len(raw) // 4}I", raw)) == [*one.encode(text or "", add_special_tokens=False).ids, 2], text


def test_byte_bpe_equals_tiktoken(spark, odd):
    ranks = byte_bpe.read_ranks(tokenizer(BYTE_BPE))
    gold = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = byte_bpe.ByteBpe(tokenizer(BYTE_BPE), public_tokenizers.PATTERN)
    rng = random.Random(7)
    letters = "abcdefgh \n\t.,'\"0123\xe9\xdf中Ж\U0001f600́"
    for _ in range(300):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        ids = own.encode(text)
        assert ids == gold.encode_ordinary(text) and own.decode(ids) == text.encode()
    got = odd.select("text", byte_bpe.digests_udf(tokenizer(BYTE_BPE), public_tokenizers.PATTERN)("text").alias("d")).collect()
    for r in got:
        ids = gold.encode_ordinary(r["text"] or "")
        assert r["d"]["n_tokens"] == len(ids) and r["d"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(m)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
}


def luhn(text):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", text))]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def test_base_spans_against_brute_force(spark):
    rng = random.Random(8)
    bits = ["a@b.co", "x.y@z", "..a@b-c.d.e", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 1234-567", "+1", "00.1.2.3", " ", "\n", ".", "-", "7", "\xe9", "+", "@", "4" * 20, "tel ", "\U0001f600"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))) for i in range(400)]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in BASE] for r in pii.find(spark.createDataFrame(rows, KIND)).collect()}
    order = list(BASE)
    for i, text in rows:
        expected = [(m.start(), order.index(k), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text) if ok(m[0])]
        assert got[i] == [(order[k], a, b) for a, k, b in sorted(expected)], text


def test_added_kinds_and_redaction(spark, odd):
    text = "Account DE89 3704 0044 0532 0130 00, not DE89 3704 0044 0532 0130 01. My ssn is 123-45-6789; write to me@site.org."
    frame = spark.createDataFrame([(1, text), (2, None)], KIND)
    kinds = [s["kind"] for s in pii.find(frame).where("doc_id = 1").first()["spans"]]
    assert "iban" in kinds and kinds.count("iban") == 1 and "national_id" in kinds and "email" in kinds
    clean = {r[0]: r[1] for r in pii.redact(frame).collect()}
    assert clean[2] is None and "DE89 3704 0044 0532 0130 00" not in clean[1] and "me@site.org" not in clean[1] and "123-45-6789" not in clean[1]
    done = pii.redact(odd)
    assert done.columns == odd.columns and pii.find(odd.drop("spans")).count() == 9 and pii.redact(odd.limit(0)).count() == 0
    assert done.where("doc_id = 5").first()["text"] == odd.where("doc_id = 5").first()["text"]


def test_language_profiles(spark, odd):
    rng = random.Random(9)
    words = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["schnell", "stra\xdfe", "\xfcber", "nicht"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(12)), lang) for i, lang in enumerate(["aa", "bb"] * 30)]
    docs = spark.createDataFrame(rows, KIND + ", lang string")
    profiles = language_id.learned(docs.where("doc_id < 40"))
    got = language_id.identified(docs.where("doc_id >= 40"), profiles).select("lang", "language.*").collect()
    assert all(r["lang"] == r["lang_pred"] and 0 <= r["score"] <= 1 for r in got)
    none = language_id.identified(spark.createDataFrame([(1, None), (2, ""), (3, "12 !?")], KIND), profiles).select("language.*").collect()
    assert all(tuple(r) == ("und", 0.0) for r in none)
    assert language_id.identified(odd, language_id.learned(odd)).count() == 9
    empty = language_id.learned(docs.limit(0))
    assert language_id.identified(docs, empty).select("language.lang_pred").distinct().collect()[0][0] == "und"


def test_lm_scores_and_counts(spark, odd):
    good = [(i, "the cat sat on the mat and the dog sat on the cat") for i in range(20)]
    bad = [(100 + i, "zz qq zz the zz qq mat qq on zz dog") for i in range(20)]
    docs = spark.createDataFrame(good + bad, KIND)
    words, table = lm_scoring.models(docs, spark.createDataFrame([(i,) for i, _ in good[:15]], "doc_id long"), size=16)
    got = {r["doc_id"]: r["lm"] for r in lm_scoring.scored(docs, words, table).collect()}
    assert min(got[i]["score"] for i, _ in good) > 0 > max(got[i]["score"] for i, _ in bad) and got[0]["n_tokens"] == 13
    counts = {r["pair"]: (r["n"], r["n_target"]) for r in lm_scoring.pair_counts(docs.withColumn("target", F.col("doc_id") < 15), words).collect()}
    number = words.numbers()
    assert counts[number[b"cat"] * words.size + number[b"sat"]] == (20, 15)
    assert lm_scoring.scored(odd, words, table).where("lm.score is null").count() == 3 and lm_scoring.scored(odd.limit(0), words, table).count() == 0
    lm_scoring.models(odd, odd.select("doc_id"))


@pytest.mark.parametrize("alpha", [0, 1])
def test_smoothing_sums_to_one(alpha):
    import numpy as np

    counts = np.random.default_rng(1).integers(0, 3, (7, 7)) * alpha
    assert np.allclose(np.exp(lm_scoring.log_probabilities(counts)).sum(axis=1), 1)
