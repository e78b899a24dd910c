import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.geometry import Affine, CoordinateCompatibilityError, as_slice, auto_dsize, level_dsize, level_for
from gridloom.plans.nodes import Concat, Crop, Dequantize, Load, Nans, Overview, Warp
from gridloom.sources.tables import demo, from_array, from_keys, from_tiles, nonzero, parse_envi_header, to_tiles, with_pyramid
from gridloom.streaming.pixels import on_stream

A = np.random.default_rng(0).random((20, 30, 2))


@pytest.fixture(scope="module")
def r(spark):
    return from_array(spark, A, ("p", "q"))


def same(a, b):
    return np.allclose(a, b, equal_nan=True)


def test_geometry_golden():
    assert [level_dsize((29, 31), k) for k in (1, 2)] == [(15, 16), (8, 8)]
    assert level_dsize((513, 517), 3) == (65, 65)
    assert auto_dsize(Affine.scale(1.1), (512, 512)) == (564, 564) and auto_dsize(Affine.scale(1.1), (564, 564)) == (621, 621)
    assert auto_dsize(Affine.scale(1 / 30), (512, 512)) == (18, 18) and auto_dsize(Affine.translate(-600, 0), (512, 512)) == (0, 512)
    assert [level_for(Affine.scale(s), 9) for s in (0.5, 0.4, 0.25, 0.2, 0.13, 1 / 64, 0.9)] == [1, 1, 2, 2, 2, 6, 0]
    assert as_slice(slice(-10, 216), 256) == (0, 216) and as_slice(slice(3, -2), 10) == (3, 8) and as_slice(slice(300, 400), 256) == (256, 256)
    with pytest.raises(ValueError):
        as_slice(slice(0, 4, 2), 10)
    m = Affine.of(scale=(2, 3), offset=(5, 7), theta=0.4, shearx=0.2)
    assert Affine.of(**m.decompose()).near(m, 1e-9) and (m @ m.inverse()).near(Affine(), 1e-9)


def test_crops_fuse_and_select(r, spark):
    c = r.crop((slice(3, 12), slice(4, 20))).crop((slice(1, 5), slice(0, 6)), [1])
    best = c.optimize()
    assert isinstance(best, Crop) and isinstance(best.child, Load) and best.dsize == (6, 4)
    assert same(c.to_array(spark), A[4:8, 4:10][..., [1]])
    assert same(r[2:5, 1:3, 0].to_array(spark), A[2:5, 1:3, :1])
    assert r.crop((slice(0, 99), slice(None)), lazy=True) is r and r.crop((slice(400, 500), slice(0, 3))).dsize == (3, 0)
    with pytest.raises(NotImplementedError):
        r.crop((slice(0, 2), slice(0, 2)), clip=False)


def test_padded_crop(r, spark):
    p = r.crop((slice(-2, 5), slice(-3, 4)), clip=False, wrap=False)
    e = np.full((7, 7, 2), np.nan)
    e[2:, 3:] = A[:5, :4]
    assert p.dsize == (7, 7) and same(p.to_array(spark), e)


def expected_nearest(s, t, w, h):
    out = np.full((h, w, 2), np.nan)
    for i in range(h):
        for j in range(w):
            y, x = int(np.floor((i - t[1]) / s[1])), int(np.floor((j - t[0]) / s[0]))
            if 0 <= y < 20 and 0 <= x < 30:
                out[i, j] = A[y, x]
    return out


def expected_linear(s, t, w, h):
    out = np.full((h, w, 2), np.nan)
    for i in range(h):
        for j in range(w):
            py, px = (i + 0.5 - t[1]) / s[1] - 0.5, (j + 0.5 - t[0]) / s[0] - 0.5
            y0, x0, v = int(np.floor(py)), int(np.floor(px)), 0
            for y, wy in ((y0, 1 - (py - y0)), (y0 + 1, py - y0)):
                for x, wx in ((x0, 1 - (px - x0)), (x0 + 1, px - x0)):
                    if wy * wx > 1e-9:
                        v = v + wy * wx * (A[y, x] if 0 <= y < 20 and 0 <= x < 30 else np.nan)
            out[i, j] = v
    return out


def test_nearest(r, spark):
    n = r.warp({"scale": (1.3, 0.7), "offset": (2, -1)}, interpolation="nearest")
    e = expected_nearest((1.3, 0.7), (2, -1), *n.dsize)
    assert same(n.to_array(spark), e)
    assert same(n[2:9, 5:30].to_array(spark), e[2:9, 5:30])
    up = r.scale(8.6, interpolation="nearest").to_array(spark)
    assert not np.isnan(up).any() and set(up[..., 0].ravel()) == set(A[..., 0].ravel())
    shifted = r.warp({"scale": 2, "offset": 0.5}, interpolation="nearest").to_array(spark)
    assert np.isnan(shifted[0]).all() and np.isnan(shifted[:, 0]).all() and np.isfinite(shifted[1:-1, 1:-1]).all()


def test_linear_and_its_window(r, spark):
    w = r.warp({"scale": (1.5, 2.25), "offset": (1.25, -0.5)})
    e = expected_linear((1.5, 2.25), (1.25, -0.5), *w.dsize)
    assert same(w.to_array(spark), e)
    cut = w[13:30, 14:30]
    assert same(cut.to_array(spark), e[13:30, 14:30])
    x0, y0, x1, y1 = cut.optimize().window
    assert 0 < x0 < x1 < 30 and 0 < y0 < y1 < 20


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_windows_and_bands_reach_the_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    made = demo(spark, (64, 48))
    made.frame.write.parquet(str(tmp_path / "d"))
    stored = Load(spark.read.parquet(str(tmp_path / "d")), ("r", "g", "b"), (64, 48))
    cut = stored.scale(2.5)[20:40, 30:60].take_channels("g")
    x0, y0, x1, y1 = cut.optimize().window
    text = plan(cut.finalize(spark))
    assert f"LessThan(x,{x1})" in text and f"GreaterThanOrEqual(y,{y0})" in text and "g:smallint" in text and "r:smallint" not in text
    assert "Exchange" not in plan(stored.scale(3, interpolation="nearest").finalize(spark))
    spark.range(1000).withColumn("v", F.rand(1)).write.parquet(str(tmp_path / "k"))
    keyed = from_keys(spark.read.parquet(str(tmp_path / "k")), "id", 50, {"v": "v"})
    assert "GreaterThanOrEqual(id,150)" in plan(keyed[3:5, 0:9].finalize(spark)) and keyed[3:5, 0:9].finalize(spark).count() == 18


def test_general_map_agrees_with_aligned_one(r, spark):
    e = expected_linear((1.5, 2.25), (1.25, -0.5), 47, 45)
    got = r.warp(Affine(1.5, 1e-7, 1.25, 0, 2.25, -0.5), (47, 45)).to_array(spark)
    both = np.isfinite(got) & np.isfinite(e)
    assert both.mean() > 0.8 and np.abs(got - e)[both].max() < 1e-5


@pytest.mark.parametrize("kernel", ["linear", "cubic", "lanczos", "area"])
def test_kernels_keep_constants(spark, kernel):
    flat = from_array(spark, np.full((24, 24), 3.0))
    for scale in (2.0, 0.4):
        got = flat.scale(scale, interpolation=kernel).to_array(spark)
        inside = got[np.isfinite(got)]
        assert len(inside) and np.allclose(inside, 3.0)


def test_border_values(spark):
    whole = from_array(spark, np.arange(12, dtype=np.uint8).reshape(3, 4))
    moved = whole.warp({"offset": 1}, (5, 4), interpolation="nearest")
    assert moved.to_array(spark)[0, 0, 0] == 0 and np.isnan(moved.with_params(border_value="null").to_array(spark)[0, 0, 0])
    assert moved.with_params(border_value=7).to_array(spark)[0, 0, 0] == 7


def test_chains_reach_normal_form(r, spark):
    chain = r.scale(2, interpolation="nearest")[3:15, 4:20].scale(3, interpolation="nearest")
    e = np.kron(np.kron(A, np.ones((2, 2, 1)))[3:15, 4:20], np.ones((3, 3, 1)))
    assert same(chain.to_array(spark), e)
    rng = np.random.default_rng(3)
    for _ in range(25):
        node = r if rng.random() < 0.5 else with_pyramid(r, 2)
        done = False
        for _ in range(rng.integers(1, 12)):
            kind = rng.integers(5)
            w, h = node.dsize
            if kind == 0 and w > 4 and h > 4:
                node = node[int(rng.integers(0, h // 2)) : int(rng.integers(h // 2 + 1, h + 1)), 0 : int(rng.integers(2, w))]
            elif kind == 1 and w < 200 and h < 200:
                node = node.scale(float(rng.choice([0.5, 0.75, 1.5, 2.0])))
            elif kind == 2:
                node = node.get_overview(int(rng.integers(0, 2)))
            elif kind == 3 and not done:
                node, done = node.dequantize({"quant_max": 255}), True
            else:
                node = node.take_channels(["p"] if len(node.channels) else [0]) if node.channels == ("p",) else node.take_channels("q|p")
        best = node.validate()
        names = [row[2] for row in best.graph_rows()]
        order = [n for n in ("Warp", "Dequantize", "Crop", "Overview", "Load") if n in names]
        assert names == order and best.optimize().nesting() == best.nesting()


def test_clip_is_remembered(spark):
    s = from_array(spark, np.ones((30, 30)))
    for kernel in ("nearest", "linear"):
        moved = s[0:15, 0:15].warp({"offset": 3}, (21, 21), interpolation=kernel)
        assert np.isfinite(moved.to_array(spark)).sum() == 225


def test_overviews(r, spark):
    v = r.get_overview(1).get_overview(1)
    assert isinstance(v.optimize(), Overview) and same(v.to_array(spark), A[::4, ::4])
    p = with_pyramid(r, 2)
    assert p.scale(0.2).optimize().child == Overview(p, 2) and isinstance(p.scale(0.25).optimize(), Overview)
    assert same(p.get_overview(1).to_array(spark), A.reshape(10, 2, 15, 2, 2).mean(axis=(1, 3)))
    assert r.get_overview(0).optimize() == r


def test_stacks(r, spark):
    z = from_array(spark, A[..., :1], ("z",))
    stack = Concat((r, z)).scale(2)[2:9, 1:7].take_channels("z|q|nope")
    best = stack.optimize()
    assert [type(p) for p in best.parts] == [Warp, Warp, Nans] and stack.channels == ("z", "q", "nope")
    got = stack.to_array(spark)
    assert got.shape == (7, 6, 3) and np.isnan(got[..., 2]).all()
    only = Concat((r, z)).take_channels("z").optimize()
    assert only.leafs()[0].channels == ("z",) and "p" not in only.finalize(spark).columns
    with pytest.raises(CoordinateCompatibilityError):
        Concat((r, z.scale(2)))
    with pytest.raises(ValueError):
        r.take_channels("nope", missing_channel_policy="error")
    with pytest.raises(KeyError):
        r.take_channels("p", missing_channel_policy="other")


def test_dequantize_once_and_below_maps(spark):
    q = from_array(spark, (np.arange(35).reshape(5, 7) * 7 % 256).astype(np.uint8), ("v",))
    made = q.dequantize({"quant_max": 255, "nodata": 0}).scale(2)
    best = made.optimize()
    assert isinstance(best, Warp) and isinstance(best.child, Dequantize)
    assert np.isnan(made.to_array(spark)).sum() > 4
    with pytest.raises(AssertionError):
        made.dequantize({"quant_max": 1})


def test_transforms_and_undo(r, spark):
    turned = r.warp({"scale": 0.5, "theta": 0.2, "offset": (3, 1)})
    assert turned.get_transform_from(r).near(turned.get_transform_from_leaf(), 1e-9)
    back = turned.undo_warp(retain=["offset"])
    parts = back.get_transform_from_leaf().decompose()
    assert np.allclose(parts["scale"], 1) and abs(parts["theta"]) < 1e-9
    assert r.scale(0.5).undo_warp(remove=["scale"]) == r
    n = Nans((40, 30), ("a",)).scale(0.5).undo_warp(remove=["scale"], squash_nans=True)
    assert n == Nans((1, 1), ("a",))
    sizes = [p.dsize for p in Concat((r.scale(2), with_pyramid(r, 1).scale(2))).undo_warps(remove=["scale"])]
    assert sizes == [(30, 20), (30, 20)]
    with pytest.raises(ValueError):
        r.undo_warp(remove=["scale"], retain=["theta"])


def test_masks_tiles_headers_and_probes(r, spark, tmp_path):
    masked = from_array(spark, np.ma.array(np.ones((3, 4)), mask=np.eye(3, 4, dtype=bool)))
    assert np.isnan(masked.to_array(spark)).sum() == 3
    tiles = to_tiles(r, "i", 8)
    assert same(from_tiles(tiles, ["p", "q"], (30, 20)).to_array(spark), A)
    assert from_tiles(tiles, ["q"], (30, 20), (5, 3, 17, 11)).frame.count() == 96
    head = parse_envi_header("ENVI\n; note\nSamples = 4\nlines=3\nband names = {a,\n b c}\n")
    assert head == {"samples": "4", "lines": "3", "band names": ["a", "b c"]}
    assert nonzero(demo(spark)) and not nonzero(from_array(spark, np.zeros((2, 2))))
    assert r.evaluate(spark).dsize == r.dsize if spark.sparkContext.getCheckpointDir() else True


def test_envi_files(spark, tmp_path):
    from gridloom.sources.tables import read_envi

    data = np.arange(24, dtype="<i2").reshape(2, 3, 4)
    data.tofile(tmp_path / "a.dat")
    (tmp_path / "a.hdr").write_text("ENVI\nsamples = 4\nlines = 3\nbands = 2\ndata type = 2\ninterleave = bsq\n")
    got = read_envi(spark, f"file://{tmp_path}/a.hdr", f"file://{tmp_path}/a.dat").to_array(spark)
    assert same(got, data.transpose(1, 2, 0))


def test_streams_take_pointwise_chains(spark, tmp_path):
    demo(spark, (8, 6)).frame.write.parquet(str(tmp_path / "in"))
    live = Load(spark.readStream.schema("y long, x long, r short, g short, b short").parquet(str(tmp_path / "in")), ("r", "g", "b"), (8, 6))
    out = on_stream(live[1:4, 2:8].take_channels("g").dequantize({"quant_max": 255}))
    q = out.writeStream.format("memory").queryName("pixels").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pixels").count() == 18
    with pytest.raises(ValueError):
        on_stream(live.scale(2))
