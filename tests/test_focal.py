import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellweave.operators import focal


def pixels(spark, a, name="code"):
    return spark.createDataFrame([(r, c, int(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], f"row int, col int, {name} int")


def grid(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[name] is None else r[name]
    return out


def brute(feature):
    rows, cols = np.indices(feature.shape)
    fr, fc = np.nonzero(feature)
    if not len(fr):
        return np.full(feature.shape, np.nan)
    return ((rows[..., None] - fr) ** 2 + (cols[..., None] - fc) ** 2).min(axis=-1)


@pytest.mark.parametrize("share", [0.0, 0.01, 0.3, 1.0])
def test_distance_is_exact(spark, share):
    a = (np.random.default_rng(3).random((23, 31)) < share).astype(int)
    got = grid(focal.squared_distance(pixels(spark, a), F.col("code") == 1), "d2", a.shape)
    np.testing.assert_array_equal(got, brute(a))
    near = grid(focal.squared_distance(pixels(spark, a), F.col("code") == 1, radius=4), "d2", a.shape)
    want = brute(a).astype(float)
    want[~(want <= 16)] = np.nan
    np.testing.assert_array_equal(near, want)
    wide = grid(focal.squared_distance(pixels(spark, a), F.col("code") == 1, radius=40), "d2", a.shape)
    np.testing.assert_array_equal(wide, brute(a))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), min_size=1, max_size=20), min_size=1, max_size=5))
def test_row_pass(rows):
    g2 = np.array([x * x for r in rows for x in r])
    cols = np.array([c for r in rows for c in range(len(r))])
    begins = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    want = [min((c - k) ** 2 + g * g for k, g in enumerate(r)) for r in rows for c in range(len(r))]
    assert focal._least_by_row(cols, g2, begins).tolist() == want


def test_keys_keep_rasters_apart(spark):
    a = np.zeros((3, 3), int)
    a[0, 0] = 1
    two = pixels(spark, a).withColumn("id", F.lit("a")).unionByName(pixels(spark, a * 0).withColumn("id", F.lit("b")))
    rows = focal.squared_distance(two, F.col("code") == 1, ["id"]).collect()
    assert {r["d2"] for r in rows if r["id"] == "b"} == {None}
    assert max(r["d2"] for r in rows if r["id"] == "a") == 8


def test_proximity(spark):
    a = np.random.default_rng(4).integers(0, 9, (12, 12))
    got = grid(focal.proximity(pixels(spark, a), [3, 5]), "distance", a.shape)
    np.testing.assert_allclose(got, np.sqrt(brute(np.isin(a, [3, 5]))))
    assert (got[np.isin(a, [3, 5])] == 0).all()
    capped = grid(focal.proximity(pixels(spark, a), [3], maxdist=2.5), "distance", a.shape)
    np.testing.assert_allclose(capped, np.minimum(np.sqrt(brute(a == 3)), 2.5))
    assert {r["distance"] for r in focal.proximity(pixels(spark, a), [77]).collect()} == {None}
    assert {r["distance"] for r in focal.proximity(pixels(spark, a), [77], maxdist=4).collect()} == {4.0}


def test_feather(spark):
    a = np.zeros((30, 30), int)
    a[4, 5], a[20:22, 17], a[29, 29] = 1, 256 + 7, 256  # 256 wraps to 0
    on = a % 256 != 0
    got = grid(focal.edge_feather(pixels(spark, a, "m"), sigma=2.0), "alpha", a.shape)
    want = np.floor(255 * np.exp(-brute(on) / 8.0))
    np.testing.assert_array_equal(got, want)
    assert (got[on] == 255).all()
    with pytest.raises(ValueError):
        focal.edge_feather(pixels(spark, a, "m"), sigma=0)
    with pytest.raises(ValueError):
        focal.edge_feather(pixels(spark, a, "m"), tile_size=0)


def test_feather_by_tiles(spark):
    a = np.zeros((20, 20), int)
    a[7, 7] = 1
    got = grid(focal.edge_feather(pixels(spark, a, "m"), sigma=2.0, truncate=1.0, tile_size=8), "alpha", a.shape)
    whole = grid(focal.edge_feather(pixels(spark, a, "m"), sigma=2.0), "alpha", a.shape)
    seen = np.zeros((20, 20), bool)
    seen[:10, :10] = True  # tile 0 sees it whole, the others as far as their halo of 2 goes
    for r in range(20):
        for c in range(20):
            inside = all(t * 8 - 2 <= 7 < t * 8 + 10 for t in (r // 8, c // 8))
            assert got[r, c] == (whole[r, c] if inside else 0)


def test_vignette(spark):
    base = pixels(spark, np.zeros((40, 50), int)).drop("code")
    got = grid(focal.vignette(base, 40, 50, border=25.0), "alpha", (40, 50))
    assert (got[0] == 0).all() and (got[:, -1] == 0).all() and got[20, 25] == 255
    assert (np.diff(got[20, :25]) >= 0).all()
    assert {r["alpha"] for r in focal.vignette(base, 40, 50, border=0).collect()} == {255}
    alpha = np.full((40, 50), 200)
    both = focal.vignette(pixels(spark, alpha, "a"), 40, 50, alpha="a", border=25.0, out="a")
    np.testing.assert_array_equal(grid(both, "a", alpha.shape), np.round(200 * got / 255))
    replaced = focal.vignette(pixels(spark, alpha, "a"), 40, 50, alpha="a", border=25.0, out="a", replace_alpha=True)
    np.testing.assert_array_equal(grid(replaced, "a", alpha.shape), got)
    noisy = [grid(focal.vignette(base, 40, 50, border=25.0, noise=20, warp=60, seed=5), "alpha", (40, 50)) for _ in range(2)]
    np.testing.assert_array_equal(*noisy)
    assert (noisy[0] <= got).all()  # warp and grain only pull inwards


def test_zoom_goes_through_its_points():
    small = np.random.default_rng(0).random((5, 4))
    np.testing.assert_allclose(focal.cubic_zoom(small, 17, 10)[::4, ::3], small, atol=1e-9)


def test_gaussian(spark):
    v = np.random.default_rng(6).integers(0, 200, (14, 11))
    k = np.array(focal.gaussian_kernel(1.2))
    r = len(k) // 2
    padded = np.pad(v.astype(float), r)
    down = sum(k[i] * padded[i : i + 14] for i in range(len(k)))
    want = sum(k[i] * down[:, i : i + 11] for i in range(len(k)))
    np.testing.assert_allclose(grid(focal.gaussian_blur(pixels(spark, v, "v"), sigma=1.2), "v", v.shape), want)
    assert abs(k.sum() - 1) < 1e-12


def test_inpaint_and_fill(spark):
    a = np.array([[1, 1, 2], [9, 9, 2], [3, 9, 9]])
    got = grid(focal.inpaint_mode(pixels(spark, a), [9]), "code", a.shape)
    np.testing.assert_array_equal(got, [[1, 1, 2], [1, 1, 2], [3, 2, 2]])
    lone = np.array([[9]])
    assert grid(focal.inpaint_mode(pixels(spark, lone), [9]), "code", (1, 1))[0, 0] == 9
    f = focal.fill_nodata(pixels(spark, np.array([[10, -1, 30, -1]]), "v").withColumn("v", F.col("v").cast("double")), -1.0, radius=1)
    assert grid(f, "v", (1, 4)).tolist() == [[10, 20, 30, 30]]
