"""Kernels in tiles, against the definition."""

import math
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from gridloom.operators import tiles
from gridloom.sources.tables import demo, from_array

KERNELS = {
    "linear": (1, lambda t: np.maximum(1 - np.abs(t), 0)),
    "cubic": (2, lambda t: np.where(np.abs(t) < 1, 1.5 * np.abs(t) ** 3 - 2.5 * t**2 + 1, np.where(np.abs(t) < 2, -0.5 * np.abs(t) ** 3 + 2.5 * t**2 - 4 * np.abs(t) + 2, 0))),
    "lanczos": (4, lambda t: np.where(np.abs(t) < 4, np.sinc(t) * np.sinc(t / 4), 0)),
    "area": (0.5, lambda t: ((t >= -0.5) & (t < 0.5)).astype(float)),
}


def expected(a, kernel, s, t, size, fill=np.nan):
    """The weighted mean of all taps, the border where one is outside or missing (a masked value)."""
    reach, f = KERNELS[kernel]
    values, known, out = np.ma.getdata(a), ~np.ma.getmaskarray(a), np.full(size[::-1], np.nan)

    def axis(n, k):
        at = (np.arange(n) + 0.5 - t[k]) / s[k]
        wide = max(1.0, 1 / s[k])
        far = math.ceil(reach * wide) + 2
        each = [np.arange(math.floor(p) - far, math.floor(p) + far + 1) for p in at]
        w = [f((i + 0.5 - p) / wide) for i, p in zip(each, at, strict=True)]
        return [(i[np.abs(v) >= 1e-9], v[np.abs(v) >= 1e-9]) for i, v in zip(each, w, strict=True)]

    xs = axis(size[0], 0)
    for y, (i, wy) in enumerate(axis(size[1], 1)):
        for x, (j, wx) in enumerate(xs):
            both = np.outer(wy, wx)
            ins = np.outer((i >= 0) & (i < a.shape[0]), (j >= 0) & (j < a.shape[1]))
            block = np.ix_(i.clip(0, a.shape[0] - 1), j.clip(0, a.shape[1] - 1))
            there = ins & known[block]
            if abs(both[there].sum() - both.sum()) < 1e-6:  # as the SQL has it
                out[y, x] = (both * values[block])[there].sum() / both.sum()
            elif not np.isnan(fill):
                out[y, x] = (both * np.where(there, values[block], fill)).sum() / both.sum()
    return out


@pytest.fixture
def small(monkeypatch):
    """Tiles so small that these rasters have many."""
    monkeypatch.setattr(tiles, "HELD", 1200)
    monkeypatch.setattr(tiles, "MADE", 100)


@pytest.mark.parametrize("kernel", list(KERNELS))
@pytest.mark.parametrize("few", [256, 0])
def test_kernels_in_many_tiles(spark, small, monkeypatch, kernel, few):
    monkeypatch.setattr(tiles, "FEW", few)
    a = np.ma.array(np.random.default_rng(1).random((41, 33)), mask=False)
    a[20, 17] = np.ma.masked
    a[31:41, 0:3] = np.ma.masked
    a.data[10, 25], a.data[30, 20] = np.nan, np.inf
    for s, t in (((1.2, 1.7), (0.0, 0.0)), ((0.4, 2.3), (1.25, -3.5)), ((0.7, 0.6), (-2.0, 4.0))):
        made = from_array(spark, a).warp({"scale": s, "offset": t}, interpolation=kernel)
        e = expected(a, kernel, s, t, made.dsize)
        assert np.isfinite(e).any() and np.allclose(made.to_array(spark)[..., 0], e, equal_nan=True)
        assert np.allclose(made[5:17, 3:11].to_array(spark)[..., 0], e[5:17, 3:11], equal_nan=True)


@pytest.mark.parametrize("kernel", list(KERNELS))
def test_strong_shrinking_sums_parts(spark, small, kernel):
    a = np.ma.array(np.random.default_rng(2).random((300, 90)), mask=False)
    a[150, 40] = np.ma.masked
    for s in ((0.02, 0.02), (1.3, 0.02), (0.02, 0.5)):
        made = from_array(spark, a).scale(s, interpolation=kernel, border_value=0.0)
        assert np.allclose(made.to_array(spark)[..., 0], expected(a, kernel, s, (0, 0), made.dsize, 0.0))


def test_missing_pixels_show_the_border(spark, small):
    a = np.ma.array(np.ones((30, 30)), mask=False)
    a[5:25, 5:25] = np.ma.masked
    raster = from_array(spark, a)
    assert np.allclose(raster.scale(1.5, border_value=7.0).to_array(spark)[..., 0], expected(a, "linear", (1.5, 1.5), (0, 0), (45, 45), 7.0))
    rows = raster.scale(1.5, border_value="null").finalize(spark).collect()
    assert len(rows) == 45 * 45 and sum(r[2] is None for r in rows) == np.isnan(expected(a, "linear", (1.5, 1.5), (0, 0), (45, 45))).sum()


def shuffled(node):
    """Rows that a plan's exchanges have written."""
    own = node.metrics().apply("shuffleRecordsWritten").value() if "Exchange" in node.nodeName() else 0
    return own + sum(shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_a_source_pixel_is_shuffled_about_once(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for kernel in KERNELS:
            ran = demo(spark, (100, 3000)).take_channels("r").scale(1.2, interpolation=kernel).finalize(spark)._jdf.queryExecution()
            assert ran.toRdd().count() == 120 * 3600
            assert shuffled(ran.executedPlan()) < 1.1 * 100 * 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_tiles_are_bounded():
    for kernel, (reach, _) in KERNELS.items():
        for s in (1e-4, 0.003, 0.02, 0.3, 0.9, 1.2, 7.0, 300.0):
            wide = max(1.0, 1 / s)
            count, n = min(math.ceil(1e6 * s), 10**6), 10**6
            cut = tiles.Cut(kernel, s, 0.0, 0, count, n, wide, reach * wide, 1024, 256)
            spans = [cut.span(k) for k in (*range(min(cut.tiles, 50)), cut.tiles - 1)]
            assert all(i1 - i0 <= min(1024, cut.held()) and o1 - o0 <= 256 for o0, o1, i0, i1 in spans)


def test_workers_need_no_package(tmp_path):
    cut = tiles.Cut("lanczos", 1.2, 0.0, 0, 120, 100, 1.0, 4.0, 1024, 256)
    (tmp_path / "f").write_bytes(cloudpickle.dumps(tiles.maker(cut, cut, 1, ["y", "x", "__whole", "__v0", "__w0"])))
    code = f"""
import pickle, pyarrow as pa
f = pickle.load(open({str(tmp_path / "f")!r}, "rb"))
rows = pa.table({{"__sy": pa.array([3, None]), "__sx": pa.array([4, None]), "__b0": pa.array([1.0, None])}})
assert f((pa.scalar(0), pa.scalar(0)), rows).num_rows == 14400
"""
    subprocess.run([sys.executable, "-I", "-c", code], cwd=tmp_path, check=True)
