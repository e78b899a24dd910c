import random
import re
from collections import defaultdict

import pytest

from gridloom.llm import exact_dedup, line_dedup, near_dedup
from gridloom.llm.common import components

KIND = "doc_id long, text string"


def test_components_of_chains_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 7)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_exact_groups_and_colliding_identifiers(spark):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefg \n") for _ in range(300)) for _ in range(12)]
    rows = [(i, rng.choice(base).replace("a", rng.choice(["a", "a ", "a\t"]))) for i in range(60)] + [(90, None), (91, " "), (92, "")]
    by = defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i))
    expected = {i: (min(g)[1], len(g), min(g)[1] == i) for g in by.values() for _, i in g}
    docs = spark.createDataFrame(rows, KIND)
    for bits in (64, 3):
        got = exact_dedup.exact_groups(docs, cuts="(?s).{4,40}?[bc]|.{1,40}", id_bits=bits)
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in got.collect()} == expected
    assert {r[0] for r in exact_dedup.drop_copies(docs).select("doc_id").collect()} == {i for i, v in expected.items() if v[2]}


def brute_lines(rows, least, most):
    where = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                where[key(line)].add(i)
    lost = {k: max(v) for k, v in where.items() if len(v) >= most}
    return {i: "\n".join(x for x in (t or "").split("\n") if key(x) not in lost or lost[key(x)] == i) for i, t in rows}


def test_lines_against_brute_force(spark):
    rng = random.Random(2)
    lines = ["Line number %d with letters" % i for i in range(9)] + ["", "  short ", "\xc9TRANGE line of some length here"]
    rows = [(i, "\n".join(rng.choice(["", " "]) + rng.choice(lines) for _ in range(rng.randint(0, 8)))) for i in range(40)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(spark.createDataFrame(rows, KIND), min_chars=15, min_docs=3).collect()}
    assert got == brute_lines(rows, 15, 3)


def brute_near(rows, percent):
    sets = {}
    for i, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    ids, top = list(sets), {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("deep", [1024, 80])
def test_near_groups_against_brute_force(spark, deep):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    rows = []
    for family in range(14):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 80, 240]))] + (passage if family % 3 == 0 else [])
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 12])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), rng.choice([" ", "\n", "\t"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    rows += [(500, None), (501, ""), (502, "  "), (503, "one two"), (504, "ONE\ttwo")]
    got = near_dedup.near_groups(spark.createDataFrame(rows, KIND), deep=deep)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()} == brute_near(rows, 85)


def test_a_template_and_a_large_family(spark):
    """2,000 pages share a template and are alike, yet below the threshold; 1,500 near copies of a page are one group."""
    rng = random.Random(14)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template, page = fresh(330), fresh(300)
    rows = [(i, " ".join(template + fresh(70))) for i in range(2000)]
    for i in range(2000, 3500):
        copy = list(page)
        copy[rng.randrange(300)] = f"v{i}"
        rows.append((i, " ".join(copy)))
    rows += [(4000, " ".join(page[:270] + fresh(30))), (4001, " ".join(page[:200] + fresh(100)))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, KIND).repartition(8), percent=80).collect()}
    assert got == {i: 2000 if 2000 <= i <= 4000 else i for i, _ in rows}


def test_odd_rows_of_near_groups(spark, odd):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_groups(odd).collect()), key=str)
    expected = [(1, 12, 1, True), (1, 12, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (None, 13, None, True), (7, 1, 7, True), (8, 1, 8, True)]
    assert got == sorted(expected, key=str)


def test_defined_results(spark, odd):
    assert exact_dedup.exact_groups(odd).count() == 9 and line_dedup.dedup_lines(odd).count() == 9 and near_dedup.near_groups(odd).count() == 9
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns and {r[0] for r in kept.select("doc_id").collect()} == {1, 4, 5, None, 7, 8}
    near = near_dedup.drop_near(odd)
    assert near.columns == odd.columns and near.count() == 9
    for empty in (odd.limit(0),):
        for f in (exact_dedup.exact_groups, line_dedup.dedup_lines, near_dedup.near_groups):
            assert f(empty).count() == 0


def test_heavy_values_take_no_anti_join(spark):
    """Rows of heavy values are told apart by a filter: each row goes through one join, and none is lost."""
    rows = spark.createDataFrame([(1, i) for i in range(3000)] + [(2 + i // 2, i) for i in range(600)], "value long, node long")
    groups = spark.createDataFrame([(1, 3000)] + [(2 + i, 2) for i in range(200)], "value long, size long")
    got = near_dedup._join_values(rows, groups, "size", 3600)
    assert "LeftAnti" not in got._jdf.queryExecution().toString()
    sizes = {1: 3000, **{2 + i: 2 for i in range(200)}}
    assert sorted(map(tuple, got.select("value", "node", "size").collect()), key=str) == sorted(((r[0], r[1], sizes.get(r[0])) for r in rows.collect()), key=str)
