"""Redaction cuts out every span that find() confirms on the original text."""

import random

from gridloom.llm import pii

KIND = "doc_id long, text string"


def brute_redaction(text, spans):
    runs = []
    for start, end, kind in spans:
        if runs and start < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], end)
            runs[-1][2].append((start, end, kind))
        else:
            runs.append([start, end, [(start, end, kind)]])
    for start, end, all_ in reversed(runs):
        kind = max(all_, key=lambda s: s[1] - s[0])[2]
        text = f"{text[:start]}[{kind.upper()}]{text[end:]}"
    return text


def test_overlapping_spans_go_whole(spark):
    rows = [(1, "Call +33.1.42.68.53.00 now"), (2, "+33 1.42.68.53.00"), (3, "no data"), (4, None), (5, ""), (6, "iban GB98 MIDL 0700 9312 3456 78 ok"), (7, "a@b.co")]
    got = {r[0]: r[1] for r in pii.redact(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: "Call [PHONE] now", 2: "[PHONE]", 3: "no data", 4: None, 5: "", 6: "iban [IBAN] ok", 7: "[EMAIL]"}


def test_redaction_against_brute_force(spark):
    rng = random.Random(12)
    bits = ["a@b.co", "1.2.3.4", "+33.1.42.68.53.00", "4111 1111 1111 1111", "+49 (30) 1234-567", "123-45-6789", "ssn ", "DE89 3704 0044 0532 0130 00", " ", "\n", ".", "-", "7", "\xe9", "\U0001f600", "+"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.choice([0, 3, 12, 400])))) for i in range(200)]
    frame = spark.createDataFrame(rows, KIND)
    spans = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in pii.find(frame).collect()}
    got = {r[0]: r[1] for r in pii.redact(frame).collect()}
    assert max(map(len, spans.values())) > pii.BLOCK / 4
    for i, text in rows:
        assert got[i] == brute_redaction(text, spans[i]), text
