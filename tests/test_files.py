"""The TIFF codec, the GeoTIFF source and sink, containers, the command line and streams."""

import json
import sqlite3
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellweave import cli
from cellweave.sources import geotiff, tiff, tiles
from cellweave.streaming import pixels as streams

HEADER = tiff.Header(70, 50, "uint8", 3, compression=8, block=(16, 32), photometric=2, transform=(10.0, 0.0, 1000.0, 0.0, -10.0, 9000.0), crs="EPSG:3857", tags={"A": 'x<y"&'})


def save(path, a, header=HEADER, **changes):
    h = replace(header, height=a.shape[0], width=a.shape[1], count=a.shape[2], dtype=str(a.dtype), photometric=2 if a.shape[2] >= 3 else 1, **changes)

    def blocks():
        for i in range(h.blocks[0] * h.blocks[1]):
            r, c = divmod(i, h.blocks[1])
            t = np.zeros((*h.block, h.count), h.dtype)
            part = a[r * h.block[0] : (r + 1) * h.block[0], c * h.block[1] : (c + 1) * h.block[1]]
            t[: part.shape[0], : part.shape[1]] = part
            yield i, tiff.encode_block(t, h)

    with open(path, "wb") as file:
        tiff.write(file, h, blocks())


def load(path):
    read = tiff.file_reader(str(path))
    h = tiff.read_header(read)
    a = np.zeros((h.height, h.width, h.count), h.dtype)
    for i in range(h.blocks[0] * h.blocks[1]):
        b = geotiff.whole_block(read, h, i)
        r, c = divmod(i, h.blocks[1])
        a[r * h.block[0] : r * h.block[0] + b.shape[1], c * h.block[1] : c * h.block[1] + b.shape[2]] = b.transpose(1, 2, 0)
    return h, a


#: Predictor 2 is for integers, 3 for floats.
KINDS = [(d, p) for d in ("uint8", "int16", "uint16", "int32", "float32", "float64") for p in (1, 3 if d.startswith("float") else 2)]


@pytest.mark.parametrize(("dtype", "predictor"), KINDS)
@pytest.mark.parametrize("compression", sorted(tiff.COMPRESSIONS.values()))
def test_codec(tmp_path, dtype, compression, predictor):
    a = (np.random.default_rng(0).random((50, 70, 3)) * 200).astype(dtype)
    save(tmp_path / "x.tif", a, compression=compression, predictor=predictor, nodata=7.0)
    h, b = load(tmp_path / "x.tif")
    assert (a == b).all() and (h.crs, h.transform, h.tags, h.nodata) == ("EPSG:3857", HEADER.transform, HEADER.tags, 7.0)


def test_old_compressions():
    assert tiff._unpack_bits(bytes([254, 170, 2, 128, 0, 42, 253, 170, 3, 128, 0, 42, 34, 247, 170])) == bytes([170] * 3 + [128, 0, 42] + [170] * 4 + [128, 0, 42, 34] + [170] * 10)
    assert tiff._unpack_lzw(bytes([0x80, 0x01, 0xE0, 0x40, 0x80, 0x44, 0x08, 0x0C, 0x06, 0x80, 0x80])) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 255), st.integers(1, 300)), max_size=60))
def test_old_compressions_come_back(runs):
    data = b"".join(bytes([v]) * n for v, n in runs)
    assert tiff._unpack_bits(tiff._pack_bits(data)) == data and tiff._unpack_lzw(tiff._pack_lzw(data)) == data


def test_long_lzw_tables_are_cleared():
    data = np.random.default_rng(0).integers(0, 256, 40_000).astype("u1").tobytes()
    assert tiff._unpack_lzw(tiff._pack_lzw(data)) == data


def test_broken_files(tmp_path):
    for data in (b"", b"II*\0", b"hello world, this is text", b"II*\0\xff\xff\xff\xff" + b"\0" * 20):
        with pytest.raises((tiff.NotARaster, Exception)):
            tiff.read_header(tiff.bytes_reader(data))


def test_source_and_sink(spark, tmp_path):
    a = np.random.default_rng(1).integers(0, 255, (50, 70, 3)).astype("u1")
    path = str(tmp_path / "a.tif")
    save(path, a)
    for df in (geotiff.read_local(spark, path), geotiff.read_files(spark, path)):
        rows = df.orderBy("row", "col").toPandas()
        assert (rows[["b1", "b2", "b3"]].to_numpy().reshape(a.shape) == a).all()
    window = geotiff.read_local(spark, path).where("row between 3 and 5 and col = 40")
    assert [r["b1"] for r in window.orderBy("row").collect()] == a[3:6, 40, 0].tolist()
    reader = geotiff.GeoTiffReader([path])
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    list(reader.pushFilters([GreaterThanOrEqual(("row",), 32), LessThan(("col",), 32)]))
    assert [p.blocks for p in reader.partitions()] == [[6, 9]]
    out = str(tmp_path / "o.tif")
    geotiff.write_raster(geotiff.read_local(spark, path), out, replace(HEADER, block=(32, 16)), ["b1", "b2", "b3"])
    assert (load(out)[1] == a).all()
    zero = geotiff.read_local(spark, path).where("row >= 32")
    geotiff.write_raster(zero, out, replace(HEADER, block=(32, 16)), ["b1", "b2", "b3"], sparse=0)
    h, b = load(out)
    assert h.sizes.count(0) == 5 and (b[:32] == 0).all() and (b[32:] == a[32:]).all()
    with pytest.raises(Exception, match="FileNotFoundError"):  # Spark wraps it
        geotiff.read_local(spark, str(tmp_path / "none.tif")).count()


def test_metadata(spark, tmp_path):
    save(str(tmp_path / "a.tif"), np.zeros((4, 5, 1), "u1"))
    (tmp_path / "b.tif").write_bytes(b"not a raster")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in geotiff.metadata(spark, str(tmp_path)).collect()}
    assert (rows["a.tif"]["width"], rows["a.tif"]["height"], rows["a.tif"]["res"]) == (5, 4, [10.0, 10.0]) and rows["b.tif"]["raster_error"] == "no TIFF"


@pytest.fixture
def rasters(tmp_path):
    rng = np.random.default_rng(2)
    a, m = rng.integers(0, 255, (10, 10, 3)).astype("u1"), np.arange(100, dtype="u1").reshape(10, 10, 1)
    for name, x in (("a", a), ("b", a * 0), ("m", m)):
        save(str(tmp_path / f"{name}.tif"), x, block=(16, 16))
    return tmp_path, a, m


def test_blend_commands(spark, rasters):
    d, a, m = rasters
    at = lambda n: str(d / f"{n}.tif")
    for co in ([], ["COMPRESS=WEBP", "WEBP_QUALITY=90"], ["COMPRESS=JPEG", "JPEG_QUALITY=75"], ["COMPRESS=ZSTD"]):
        cli.main(["masked_blend", at("a"), at("b"), at("m"), at("o"), *(x for c in co for x in ("--co", c))])
        assert (load(at("o"))[1] == np.round(a * (m / 255.0))).all()
    for co in (["COMPRESS=WEBP", "PHOTOMETRIC=YCBCR"], ["COMPRESS=LZW", "PREDICTOR=3"]):
        with pytest.raises(ValueError):
            cli.main(["masked_blend", at("a"), at("b"), at("m"), at("o"), *(x for c in co for x in ("--co", c))])
    for co in ("LZW", "PACKBITS"):
        cli.main(["masked_blend", at("a"), at("b"), at("m"), at("o"), "--co", f"COMPRESS={co}"])
        assert load(at("o"))[0].compression == tiff.COMPRESSIONS[co.lower()] and (load(at("o"))[1] == np.round(a * (m / 255.0))).all()
    cli.main(["hillshade_blend", at("m"), at("a"), at("h"), "--shade-strength", "0"])
    assert (load(at("h"))[1] == a).all()


def test_other_commands(spark, rasters, monkeypatch, capsys):
    d, a, m = rasters
    at = lambda n: str(d / n)
    (d / "c.yml").write_text('classes:\n  - {name: a, ids: [1, 2], rgb: "ff0000"}\n  - {name: b, ids: [9]}\noptions: {report_unmapped: {enabled: true, max_ids: 3}}\n')
    cli.main(["reclassify", "--config", at("c.yml"), at("m.tif"), at("r.tif")])
    want = np.select([np.isin(m, [1, 2]), m == 9], [1, 2], 0)
    h, r = load(at("r.tif"))
    assert (r == want).all() and h.colormap[1] == (255, 0, 0) and (load(at("r_alpha.tif"))[1] == np.where(want, 255, 0)).all()
    assert "Unmapped ids: 0, 3, 4" in capsys.readouterr().out
    cli.main(["proximity", at("m.tif"), at("p.tif"), "--targets", "0,99", "--maxdist", "3"])
    p = load(at("p.tif"))[1]
    assert p[0, 0, 0] == 0 and p.max() == 3
    cli.main(["blur", at("m.tif"), at("f.tif"), "--tile-size", "16"])
    assert load(at("f.tif"))[1][0, 0, 0] == int(255 * np.exp(-0.5))
    cli.main(["vignette", at("a.tif"), at("v.tif"), "--seed", "1"])
    assert load(at("v.tif"))[1].shape == (10, 10, 4)
    cli.main(["create_subset", at("a.tif"), at("s.tif"), "--size", "4", "--x-anchor", "1"])
    h, s = load(at("s.tif"))
    assert (s == a[3:7, 6:10]).all() and h.transform[2] == 1060.0
    cli.main(["align_raster", at("a.tif"), at("s.tif"), at("al.tif"), "-r", "near"])
    assert (load(at("al.tif"))[1] == s).all()
    cli.main(["manifest", "--dir", str(d), "--output", at("manifest.json")])
    assert json.loads((d / "manifest.json").read_text())["files"]["a.tif"]["width"] == 10
    with pytest.raises(ValueError, match="fewer"):
        cli.main(["validate_raster", at("a.tif")])
    cli.main(["validate_raster", at("a.tif"), "--min-bytes", "10", "--min-pixels", "100"])
    monkeypatch.setattr(cli.catalog, "git_version", lambda folder: "abc-dirty")
    cli.main(["add_version", at("a.tif")])
    capsys.readouterr()
    cli.main(["get_version", at("a.tif")])
    assert capsys.readouterr().out.strip() == "abc-dirty" and (load(at("a.tif"))[1] == a).all()
    monkeypatch.setattr(cli.catalog, "git_version", lambda folder: None)
    with pytest.raises(ValueError):
        cli.main(["add_version", at("a.tif")])
    (d / "ramp.txt").write_text("# c\n0 10 20 30\n100 40 50 60")
    cli.main(["adjust_color_file", at("ramp.txt"), at("ramp2.txt"), "--elev-adjust", "2"])
    assert (d / "ramp2.txt").read_text() == "# c\n0.0 10 20 30\n200.0 40 50 60"
    cli.main(["color_relief", at("m.tif"), at("ramp.txt"), at("cr.tif")])
    assert load(at("cr.tif"))[1][5, 0].tolist() == [25, 35, 45]
    cli.main(["publish", at("a.tif"), str(d), "--rename", "z.tif"])
    assert (d / "z.tif").exists()
    with pytest.raises(ValueError, match="TILED"):
        cli.main(["run", "gdal_translate", "-co", "TILD=YES", "x", "y"])


def test_tile_containers(spark, rasters):
    d, a, _ = rasters
    cli.main(["create_mbtiles", str(d / "a.tif"), str(d / "x.mbtiles"), "--min-zoom", "13", "--max-zoom", "14", "--mo", "name=test"])
    with pytest.raises(FileExistsError):
        cli.main(["create_mbtiles", str(d / "a.tif"), str(d / "x.mbtiles")])
    db = sqlite3.connect(d / "x.mbtiles")
    about = dict(db.execute("SELECT name, value FROM metadata"))
    assert (about["name"], about["minzoom"], about["maxzoom"]) == ("test", "13", "14")
    data = [r[0] for r in db.execute("SELECT tile_data FROM tiles")]
    assert data and all(x.startswith(b"\x89PNG") for x in data)
    cli.main(["create_pmtiles", str(d / "x.mbtiles"), str(d / "x.pmtiles")])
    raw = (d / "x.pmtiles").read_bytes()
    assert raw[:8] == b"PMTiles\x03" and len(raw) > 127 + len(data[0])
    begin, size = (int.from_bytes(raw[i : i + 8], "little") for i in (56, 64))
    assert begin + size == len(raw) and size == sum(map(len, set(data)))
    with pytest.raises(ValueError, match="resampling"):
        cli.main(["create_mbtiles", str(d / "a.tif"), str(d / "y.mbtiles"), "-r", "SINC"])


def test_folder_of_tiles(spark, tmp_path):
    a = np.random.default_rng(5).integers(1, 255, (70, 90, 2)).astype("u1")
    a[:32, 64:] = 0
    path, out = str(tmp_path / "a.tif"), str(tmp_path / "tiles")
    save(path, a)
    h = replace(HEADER, width=90, height=70, count=2, block=(16, 32), photometric=1)
    geotiff.write_tiles(geotiff.read_local(spark, path), out, h, ["b1", "b2"], blocks=2, sparse=0)
    assert sorted(p.name for p in (tmp_path / "tiles").iterdir()) == ["0_0.tif", "1_0.tif", "1_1.tif", "2_0.tif", "2_1.tif"]
    rows = geotiff.read_tiles(spark, out, h).toPandas()
    back = np.zeros_like(a)
    back[rows.row, rows.col] = rows[["b1", "b2"]].to_numpy()
    assert (back == a).all()


def test_hilbert_ids():
    assert [tiles.hilbert_id(*x) for x in ((0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0))] == [0, 1, 2, 3, 4, 5]
    assert len({tiles.hilbert_id(4, x, y) for x in range(16) for y in range(16)}) == 256


def test_streams(spark, tmp_path):
    from pyspark.sql import functions as F

    from cellweave.operators import blend, focal

    source = str(tmp_path / "in")
    spark.range(64).select((F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.col("id").cast("int").alias("m")).write.parquet(source)
    stream = streams.read_pixels(spark, source, "row int, col int, m int")
    mixed = stream.select("row", "col", blend.blend_value(F.lit(200), F.lit(100), "m").alias("v"))
    streams.write_pointwise(mixed, str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 64
    streams.write_batches(streams.read_pixels(spark, source, "row int, col int, m int"), lambda b: focal.proximity(b, [9], "m"), str(tmp_path / "out2"), str(tmp_path / "c2")).awaitTermination()
    near = spark.read.parquet(str(tmp_path / "out2"))
    assert near.count() == 64 and near.where("row = 1 and col = 1").first()["distance"] == 0
    timed = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select("timestamp", F.lit(3).alias("row"), F.lit(300).alias("col"))
    assert streams.changed_tiles(timed, "timestamp").isStreaming


def test_registry():
    from cellweave import registry

    assert "proximity" in registry.OPERATORS
    with pytest.raises(ValueError):
        registry.operator("proximity")(lambda df: df)


def test_config_files(tmp_path):
    from cellweave.sources import config

    (tmp_path / "good.yml").write_text("classes: [{name: a, ids: [1]}]")
    assert config.load_reclass_config(str(tmp_path / "good.yml")).rules[0].ids == (1,)
    for name, text in (("list.yml", "- 1"), ("broken.yml", "a: [1"), ("empty.yml", "")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            config.load_yaml(str(tmp_path / name))
    (tmp_path / "s.json").write_text('{"a.tif": "u"}')
    assert config.load_sources(str(tmp_path / "s.json")) == {"a.tif": "u"} and config.load_sources(None) == {}
    (tmp_path / "l.json").write_text("[]")
    with pytest.raises(ValueError):
        config.load_sources(str(tmp_path / "l.json"))
