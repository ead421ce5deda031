"""Queries over rasters that grow in height: their tasks' share and the driver's must not grow with it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import focal
from cellweave.plans import file_queries, queries  # noqa: F401  the first registers its own
from conftest import SMALL


def distances(there, on):
    """Squared distances over the pixels that are there, over columns and then over the pixels of a row."""
    out = np.full(there.shape, np.nan)
    for r, c in zip(*np.nonzero(there), strict=True):
        best = np.inf
        for k in np.flatnonzero(there[r]):
            rows = np.flatnonzero(there[:, k] & on[:, k])
            if len(rows):
                best = min(best, (k - c) ** 2 + int(np.abs(rows - r).min()) ** 2)
        out[r, c] = best if np.isfinite(best) else np.nan
    return out


@pytest.mark.parametrize("radius", [None, 5, 20])
def test_bands_of_a_tall_sparse_raster(spark, radius):
    rng = np.random.default_rng(1)
    there, on = rng.random((300, 5)) < 0.7, rng.random((300, 5)) < 0.01
    cells = [(int(r), int(c), bool(on[r, c])) for r, c in zip(*np.nonzero(there), strict=True)]
    rows = focal.squared_distance(spark.createDataFrame(cells, "row int, col int, f boolean"), F.col("f"), radius=radius).collect()
    want = distances(there, on)
    if radius:
        want[~(want <= radius * radius)] = np.nan
    assert len(rows) == len(cells)
    for r in rows:
        w = want[r["row"], r["col"]]
        assert r["d2"] == (None if np.isnan(w) else w)


def plan(spark, name):
    return queries.QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString().lower()


@pytest.mark.parametrize("name", ["proximity", "edge_feather", "proximity_capped"])
def test_no_frame_is_read_again_for_each_pixel(spark, name):
    """A frame up to the last row costs the square of a column's pixels; windows are over the bands' ends."""
    found = plan(spark, name)
    assert "unboundedfollowing" not in found and found.count("hashpartitioning(col") == 0


@pytest.mark.parametrize("shape", [(700, 40), (5, 300), (1, 1), (130, 1)])
def test_noise_by_bands_is_the_whole_field(shape):
    """The bands' parts equal the fields that NumPy draws whole."""
    height, width = shape
    fade, grain, pull, seed = 40, 3, 20, 11
    random = np.random.default_rng(seed)
    total, weight, whole = np.zeros(shape, "f4"), 0.0, np.zeros(shape, "f4")
    for k in range(3):
        scale = max(50.0, fade * 1.5) / 2**k
        small = random.uniform(-1.0, 1.0, (max(1, int(height / scale)), max(1, int(width / scale)))).astype("f4")
        total += (focal.cubic_zoom(small.astype("f8"), height, width) * 0.5**k).astype("f4")
        weight += 0.5**k
    whole += total / np.float32(weight) * np.float32(pull) - np.float32(pull)
    whole -= random.uniform(0.0, float(grain), shape).astype("f4")
    noise = focal.Noise(height, width, fade, grain, pull, seed)
    parts = np.concatenate([noise.rows(i, min(i + 64, height)) for i in range(0, height, 64)])
    np.testing.assert_allclose(parts, whole, rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("name", ["vignette_noise", "vignette_alpha", "vignette_plain"])
def test_vignettes_shuffle_their_pixels_once(spark, name):
    found = plan(spark, name)
    assert "unboundedfollowing" not in found and "join" not in found and "localtablescan" not in found


def test_ascii_grids_are_written_and_read_in_parts(spark, tmp_path):
    """Neither the driver nor one task holds a grid; null and missing pixels are nodata."""
    from cellweave.operators.geometric import Grid
    from cellweave.sources import grids, tiff

    grid = Grid(5.0, 9.0, 2.0, -2.0, 300, 500)  # three runs of rows
    cells = spark.range(300 * 500).select((F.col("id") / 300).cast("int").alias("row"), (F.col("id") % 300).cast("int").alias("col"), F.when(F.col("id") % 7 != 0, F.col("id") / 8).alias("v"))
    kept = cells.where("row < 218 or row > 460").where("row <> 3 or col <> 4")
    path = str(tmp_path / "a.asc")
    grids.write_ascii(kept, path, grid, "v", -9999.0)
    with open(path) as file:
        assert grids.ascii_header(file.read())[:2] == (Grid(5.0, 9.0, 2.0, -2.0, 300, 500), -9999.0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        found = grids.read_ascii(spark, str(tmp_path)).drop("path")
        assert found.rdd.getNumPartitions() > 3
        want = cells.join(kept.select("row", "col", F.lit(True).alias("k")), ["row", "col"], "left").select("row", "col", F.when(F.col("k"), F.col("v")).alias("b1"))
        assert found.count() == 150_000 and found.exceptAll(want).count() == 0
        with open(path, "a") as file:
            file.write("7\n")
        with pytest.raises(tiff.NotARaster, match="150001 values"):
            grids.read_ascii(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ascii_query_collects_no_pixels(spark, monkeypatch):
    from pyspark.sql import DataFrame

    most, real = [0], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: (out := real(self), most.append(len(out)))[0])
    df = queries.QUERIES["file_ascii_grid"](spark, SMALL)
    assert max(most) < 100 and isinstance(df, DataFrame) and df.count() == 500 * 64


def test_tiles_are_encoded_by_all_tasks_at_once(spark, tmp_path, monkeypatch):
    """What the driver takes one by one is already made; small blocks don't make a task each."""
    from cellweave.sources import geotiff, tiff, tiles

    plans, kind = [], type(spark.range(1))
    real = kind.toLocalIterator
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a, **b: (plans.append(self._jdf.queryExecution().executedPlan().toString()), real(self, *a, **b))[1])
    path = str(tmp_path / "a.tif")
    cells = spark.range(64 * 8192).select((F.col("id") / 64).cast("int").alias("row"), (F.col("id") % 64).cast("int").alias("col"), (F.col("id") % 251).cast("int").alias("v"))
    geotiff.write_raster(cells, path, tiff.Header(64, 8192, "uint8", 1, compression=8, block=(32, 32)), ["v"])
    found = geotiff.read_local(spark, path)
    assert found.rdd.getNumPartitions() == 2
    assert found.select("row", "col", F.col("b1").alias("v")).exceptAll(cells).count() == 0 and found.count() == 64 * 8192
    one = cells.where("row < 64").withColumns({"zoom": F.lit(1), "tile_column": F.lit(0), "tile_row": F.lit(0)})
    tiles.write_mbtiles(tiles.encode_tiles(one, ["v"]), str(tmp_path / "a.mbtiles"), {})
    assert len(plans) == 2 and not any("MapInArrow" in p for p in plans)
