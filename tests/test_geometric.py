import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import geometric as G


def pixels(spark, a, name="v"):
    return spark.createDataFrame([(r, c, float(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], f"row int, col int, {name} double")


def grid(df, shape, name="v"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = r[name]
    return out


@pytest.mark.parametrize(("w", "h", "size", "x", "y", "want"), [(100, 80, 40, 0.5, 0.5, (30, 20, 40, 40)), (100, 80, 81, 0.5, 0.5, (0, 0, 100, 80)), (100, 80, 80, 1.0, 1.0, (20, 0, 80, 80)), (101, 80, 40, 0.25, 0.1, (15, 4, 40, 40))])
def test_subset_window(w, h, size, x, y, want):
    assert G.subset_window(w, h, size, x, y) == want


def test_subset(spark):
    a = np.arange(63).reshape(7, 9)
    got = grid(G.create_subset(pixels(spark, a), 9, 7, 4, 1.0, 0.5), (4, 4))
    np.testing.assert_array_equal(got, a[1:5, 5:9])
    with pytest.raises(ValueError):
        G.subset_window(9, 9, 3, 2.0, 0)


SOURCE = G.Grid(0, 0, 1, -1, 8, 6, "EPSG:3857")


@pytest.mark.parametrize("method", ["nearest", "bilinear", "cubic", "average", "mode"])
def test_align_to_itself(spark, method):
    a = np.random.default_rng(1).integers(0, 50, (6, 8))
    np.testing.assert_allclose(grid(G.align(pixels(spark, a), SOURCE, SOURCE, method=method), a.shape), a)


def test_align_planes(spark):
    """Bilinear and cubic keep a plane inside the raster; half cells meet between four."""
    rows, cols = np.indices((6, 8))
    a = 3.0 * rows + 5.0 * cols
    half = G.Grid(0.5, -0.5, 1, -1, 7, 5, "EPSG:3857")
    for method in ("bilinear", "cubic"):
        got = grid(G.align(pixels(spark, a), SOURCE, half, method=method), (5, 7))
        np.testing.assert_allclose(got[1:4, 1:6], (a[:-1, :-1] + 4.0)[1:4, 1:6])
    coarse = G.Grid(0, 0, 2, -2, 4, 3, "EPSG:3857")
    np.testing.assert_allclose(grid(G.align(pixels(spark, a), SOURCE, coarse, method="average"), (3, 4)), a.reshape(3, 2, 4, 2).mean(axis=(1, 3)))


def test_align_nodata_and_outside(spark):
    a = np.array([[1.0, -9.0], [3.0, 5.0]])
    s = G.Grid(0, 0, 1, -1, 2, 2)
    one = G.Grid(0, 0, 2, -2, 1, 1)
    assert G.align(pixels(spark, a), s, one, method="average", nodata=-9.0).first()["v"] == 3.0
    assert G.align(pixels(spark, a), s, one, method="bilinear", nodata=-9.0).first()["v"] == 3.0
    far = G.Grid(50, 50, 1, -1, 2, 2)
    assert G.align(pixels(spark, a), s, far).count() == 0
    with pytest.raises(ValueError, match="CRS"):  # that of the source is not known
        G.align(pixels(spark, a), s, G.Grid(0, 0, 1, -1, 2, 2, "EPSG:4326"))
    with pytest.raises(ValueError, match="resampling"):
        G.align(pixels(spark, a), s, s, method="sinc")


def test_pyramid_equals_overviews(spark):
    a = np.random.default_rng(2).random((13, 10))
    p = G.pyramid(pixels(spark, a), (2, 4, 6))
    for level in (2, 4, 6):
        shape = (-(-13 // level), -(-10 // level))
        np.testing.assert_allclose(grid(p.where(f"level = {level}"), shape), grid(G.overview(pixels(spark, a), level), shape))


def test_tiles_round_trip(spark):
    a = np.random.default_rng(3).integers(0, 3, (9, 7)).astype(float)
    a[:4, :4] = 0
    t = G.to_tiles(pixels(spark, a), 4)
    assert (0, 0) not in {(r["tile_row"], r["tile_col"]) for r in t.collect()} and t.count() == 5
    whole = G.from_tiles(G.to_tiles(pixels(spark, a), 4, sparse=None), 4)
    np.testing.assert_array_equal(grid(whole, a.shape), a)


def test_zoom_of_resolution():
    res = 2 * G.MERCATOR / 256
    assert G.mercator_zoom(G.Grid(0, 0, res, -res, 1, 1)) == 0
    assert G.mercator_zoom(G.Grid(0, 0, res / 8, -res / 8, 1, 1)) == 3


@pytest.mark.parametrize("method", G.METHODS)
def test_every_method_keeps_a_constant(spark, method):
    got = G.align(pixels(spark, np.full((6, 8), 7.0)), SOURCE, G.Grid(1.3, -1.2, 1.5, -1.5, 3, 2, "EPSG:3857"), method=method).collect()
    want = {7.0} if method != "sum" else {7.0 * n for n in (1, 2, 4)}
    assert len(got) == 6 and {round(r["v"], 9) for r in got} <= want


def test_kernels_against_numpy(spark):
    """Each method from its definition, at one target pixel."""
    a = np.random.default_rng(4).random((8, 8))
    s, t = G.Grid(0, 0, 1, -1, 8, 8), G.Grid(3.2, -3.4, 1, -1, 1, 1)
    fr, fc = 3.4, 3.2  # the pixel's centre less half a cell
    sinc = lambda d: np.sinc(d) * np.sinc(d / 3) if abs(d) < 3 else 0.0

    def bspline(d):
        d = abs(d)
        return (4 - 6 * d * d + 3 * d**3) / 6 if d < 1 else (2 - d) ** 3 / 6 if d < 2 else 0.0

    for method, weight in (("lanczos", sinc), ("cubicspline", bspline)):
        w = np.array([[weight(r - fr) * weight(c - fc) for c in range(8)] for r in range(8)])
        assert abs(G.align(pixels(spark, a), s, t, method=method).first()["v"] - (w * a).sum() / w.sum()) < 1e-9


def test_nodata_goes_band_by_band(spark):
    df = spark.createDataFrame([(0, 0, 5.0, -9.0), (0, 1, -9.0, 6.0)], "row int, col int, a double, b double")
    g = G.Grid(0, 0, 1, -1, 2, 1)
    assert sorted(map(tuple, G.align(df, g, g, ("a", "b"), "nearest", -9.0).collect())) == [(0, 0, 5.0, None), (0, 1, None, 6.0)]


def test_known_coordinates(spark):
    """UTM on the central meridian is the scaled meridian arc; elsewhere an independent series; every system comes back."""
    import math

    from cellweave.functions.crs import transform

    def at(x, y, source, target):
        return tuple(spark.range(1).select(*transform(F.lit(float(x)), F.lit(float(y)), source, target)).first())

    e, n = at(15, 45, "EPSG:4326", "EPSG:32633")
    assert abs(e - 500000) < 1e-6 and abs(n - 0.9996 * 4984944.378) < 1e-2
    assert abs(at(15, -45, "EPSG:4326", "EPSG:32733")[1] + n - 1e7) < 1e-6
    f = 1 / 298.257223563
    e2, lat, away = f * (2 - f), math.radians(45), math.radians(2)  # the classic series in the longitude
    ep = e2 / (1 - e2)
    radius, t, c, a = 6378137 / math.sqrt(1 - e2 * math.sin(lat) ** 2), math.tan(lat) ** 2, ep * math.cos(lat) ** 2, away * math.cos(lat)
    east = 500000 + 0.9996 * radius * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep) * a**5 / 120)
    north = n + 0.9996 * radius * math.tan(lat) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * a**4 / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep) * a**6 / 720)
    got = at(17, 45, "EPSG:4326", "EPSG:32633")
    assert abs(got[0] - east) < 1e-2 and abs(got[1] - north) < 1e-2
    assert at(180, 0, "EPSG:4326", "EPSG:3857")[0] == pytest.approx(G.MERCATOR)
    x, y = at(-96, 23, "EPSG:4326", "EPSG:5070")
    assert abs(x) < 1e-6 and abs(y) < 1e-6
    for crs, lon, lat in (("EPSG:32613", -104.9, 39.7), ("EPSG:5070", -110.2, 36.1), ("EPSG:3857", 10.5, -33.3), ("EPSG:32755", 149.1, -35.3), ("EPSG:26911", -118.0, 34.0)):
        back = at(*at(lon, lat, "EPSG:4326", crs), crs, "EPSG:4326")
        assert abs(back[0] - lon) < 1e-8 and abs(back[1] - lat) < 1e-8
    # equal area: a small quadrangle has the same area anywhere, that of the ellipsoid's surface
    for lon, lat in ((-96, 37.5), (-120, 47), (-75, 28)):
        h = 1e-4
        (x0, y0), (x1, y1), (x2, y2) = at(lon, lat, "EPSG:4326", "EPSG:5070"), at(lon + h, lat, "EPSG:4326", "EPSG:5070"), at(lon, lat + h, "EPSG:4326", "EPSG:5070")
        s = math.sin(math.radians(lat + h / 2))
        surface = math.radians(h) ** 2 * math.cos(math.radians(lat)) * 6378137**2 * (1 - e2) / (1 - e2 * s * s) ** 2
        assert abs((x1 - x0) * (y2 - y0) - (x2 - x0) * (y1 - y0)) == pytest.approx(surface, rel=1e-5)
    with pytest.raises(ValueError, match="CRS"):
        transform(F.lit(0.0), F.lit(0.0), "EPSG:2056", "EPSG:4326")


def test_tiles_of_another_crs_have_no_holes(spark):
    a = np.random.default_rng(6).integers(1, 255, (40, 30))
    g = G.Grid(500000.0, 4400000.0, 30.0, -30.0, 30, 40, "EPSG:32613")
    top = G.native_zoom(g)
    out = G.tile_pyramid(pixels(spark, a), g, ("v",), top - 1, top + 1)
    for zoom, share in ((top + 1, 0.98), (top, 0.98)):
        rows = out.where(F.col("zoom") == zoom).selectExpr("tile_column * 256 + col as x", "tile_row * 256 + row as y").toPandas()
        inside = rows.groupby("y").x.agg(["min", "max", "count"])
        assert ((inside["max"] - inside["min"] + 1) == inside["count"]).all() and len(rows) > 1200 * share
