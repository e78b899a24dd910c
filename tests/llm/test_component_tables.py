from gridloom.llm import common


def tables(monkeypatch, spark, edges):
    """(components, names of the tables written for them) of a list of edges."""
    made, written = [], common.written
    monkeypatch.setattr(common, "written", lambda frame, what: made.append(what) or written(frame, what))
    return dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect()), made


def test_stars_are_components_without_a_round(monkeypatch, spark):
    got, made = tables(monkeypatch, spark, [(1, 5), (6, 1), (7, 1), (2, 3), (3, 2), (4, 4)])
    assert got == {1: 1, 5: 1, 6: 1, 7: 1, 2: 2, 3: 2}
    assert made == ["edges"]


def test_joined_stars_take_rounds_until_stars_are_left(monkeypatch, spark):
    got, made = tables(monkeypatch, spark, [(1, 5), (1, 6), (2, 7), (2, 8), (8, 5), (3, 9), (10, 9)])
    assert got == dict.fromkeys([1, 2, 5, 6, 7, 8], 1) | dict.fromkeys([3, 9, 10], 3)
    assert made.count("edges") == 1 and made.count("small-star") <= 2
