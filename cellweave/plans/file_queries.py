"""Registered queries over real files: each writes them to the shared folder, reads them back, and has a twin over the tables."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import blend, catalog, focal, geometric, ramp, reclassify
from cellweave.plans.queries import _CLASSED, TILED, _channel_sql, _feather_sql, _hsv_sql, query
from cellweave.plans.views import LAYERS, grid, layers, table
from cellweave.sources import config, geotiff, grids, tiff, tiles
from cellweave.sources.tables import shared_folder
from cellweave.streaming import pixels

_FOLDERS: dict[str, str] = {}


def folder(spark: SparkSession, name: str) -> str:
    """A new folder for a query's files; the one of its last run goes."""
    if name in _FOLDERS:
        shutil.rmtree(_FOLDERS[name], ignore_errors=True)
    path = f"{re.sub('^file:(//)?', '', shared_folder(spark))}/cellweave-files-{uuid.uuid4().hex}"
    os.makedirs(path)
    _FOLDERS[name] = path
    return path


def _header(spark: SparkSession, sf_dir: str, count: int, **changes) -> tiff.Header:
    g = grid(spark, sf_dir)
    fields = {"compression": 8, "block": (32, 32), "photometric": 2 if count >= 3 else 1, "transform": (g.dx, 0.0, g.x, 0.0, g.dy, g.y), "crs": g.crs}
    return tiff.Header(g.width, g.height, "uint8", count, **(fields | changes))


def _rgb_file(spark: SparkSession, sf_dir: str, name: str, **changes) -> str:
    path = f"{folder(spark, name)}/layers.tif"
    geotiff.write_raster(layers(spark, sf_dir).select("row", "col", "a1", "a2", "a3"), path, _header(spark, sf_dir, 3, **changes), ["a1", "a2", "a3"])
    return path


# ---------------------------------------------------------------- GeoTIFF


@query(f"WITH {LAYERS} SELECT row, col, a1 AS b1, a2 AS b2, a3 AS b3 FROM layers")
def file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in tiles, read back block by block."""
    return geotiff.read_local(spark, _rgb_file(spark, sf_dir, "file_scan")).drop("path")


@query(f"WITH {LAYERS} SELECT row, col, a2 AS b2 FROM layers WHERE row BETWEEN 40 AND 90 AND col >= 33")
def file_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filters skip blocks at the source."""
    return geotiff.read_local(spark, _rgb_file(spark, sf_dir, "file_window")).where("row between 40 and 90 and col >= 33").select("row", "col", "b2")


@query(f"WITH {LAYERS} SELECT 'layers.tif' AS name, count(*) AS pixels, sum(a1)::BIGINT AS s1, sum(a3)::BIGINT AS s3 FROM layers")
def file_scan_any_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents come through Spark's own reader."""
    path = _rgb_file(spark, sf_dir, "file_scan_any_store", compression=50000, predictor=2)
    rows = geotiff.read_files(spark, os.path.dirname(path))
    return rows.groupBy(F.element_at(F.split("path", "/"), -1).alias("name")).agg(F.count("*").alias("pixels"), F.sum("b1").alias("s1"), F.sum("b3").alias("s3"))


def _compressed(kind: int, name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return geotiff.read_local(spark, _rgb_file(spark, sf_dir, name, compression=kind)).select("row", "col", "b1")

    run.__name__ = name
    return query(f"WITH {LAYERS} SELECT row, col, a1 AS b1 FROM layers")(run)


file_lzw, file_packbits, file_uncompressed = _compressed(5, "file_lzw"), _compressed(32773, "file_packbits"), _compressed(1, "file_uncompressed")


@query(f"WITH {LAYERS} SELECT 'layers.tif' AS name, 'GTiff' AS driver, 'uint8' AS dtype, 3 AS \"count\", 'EPSG:3857' AS crs, 64 AS width, (max(row) + 1)::INTEGER AS height, 9.0::DOUBLE AS nodata, 1000.0::DOUBLE AS x, 9000.0::DOUBLE AS y, 10.0::DOUBLE AS res, 'v1' AS version, '' AS raster_error FROM layers UNION ALL SELECT 'text.tif', '', '', -1, '', -1, -1, -1, -1, -1, -1, '', 'no TIFF'")
def file_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of a folder; one file is none."""
    path = _rgb_file(spark, sf_dir, "file_metadata", nodata=9.0, tags={"VERSION": "v1"})
    with open(f"{os.path.dirname(path)}/text.tif", "w") as file:
        file.write("this is a text, and no raster at all")
    m = geotiff.metadata(spark, os.path.dirname(path))
    out = m.select(F.element_at(F.split("path", "/"), -1).alias("name"), "driver", "dtype", "count", "crs", "width", "height", "nodata", F.col("transform")[2].alias("x"), F.col("transform")[5].alias("y"), F.col("res")[0].alias("res"), F.col("tags")["VERSION"].alias("version"), "raster_error")
    return out.fillna(-1).fillna("")


@query(f"WITH {LAYERS} SELECT row, col, CASE WHEN max(CASE WHEN code > 45 THEN 1 ELSE 0 END) OVER (PARTITION BY row // 32, col // 32) = 1 THEN CASE WHEN code > 45 THEN m ELSE 0 END ELSE 0 END AS b1 FROM layers")
def file_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of zeros are not stored and read as zeros."""
    path = f"{folder(spark, 'file_sparse')}/sparse.tif"
    x = layers(spark, sf_dir).select("row", "col", F.when(F.col("code") > 45, F.col("m")).otherwise(0).alias("m"))
    geotiff.write_raster(x, path, _header(spark, sf_dir, 1, block=(32, 32)), ["m"], sparse=0)
    return geotiff.read_local(spark, path).drop("path")


_TILED_DISTANCE = """tiles AS (SELECT row, col, m <> 0 AND m < 60 AS f, tr.tr, tc.tc FROM layers, LATERAL (SELECT unnest(generate_series(greatest(0, floor((row - 3) / 16)::INTEGER), floor((row + 3) / 16)::INTEGER)) AS tr) tr, LATERAL (SELECT unnest(generate_series(greatest(0, floor((col - 3) / 16)::INTEGER), floor((col + 3) / 16)::INTEGER)) AS tc) tc),
near AS (SELECT a.row, a.col, min((a.row - b.row) * (a.row - b.row) + (a.col - b.col) * (a.col - b.col)) AS d2 FROM tiles a LEFT JOIN tiles b ON a.tr = b.tr AND a.tc = b.tc AND b.f AND abs(a.row - b.row) <= 7 AND abs(a.col - b.col) <= 7 WHERE a.row // 16 = a.tr AND a.col // 16 = a.tc GROUP BY a.row, a.col)"""


@query(f"WITH {LAYERS}, {_TILED_DISTANCE} SELECT row, col, coalesce({_feather_sql(1.0)}, 0) AS b1 FROM near")
def file_halo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mask file, feathered in tiles that see three pixels around them, written and read."""
    at = folder(spark, "file_halo")
    x = layers(spark, sf_dir).select("row", "col", F.when(F.col("m") < 60, F.col("m")).otherwise(0).alias("m"))
    geotiff.write_raster(x, f"{at}/mask.tif", _header(spark, sf_dir, 1), ["m"])
    alpha = focal.edge_feather(geotiff.read_local(spark, f"{at}/mask.tif"), "b1", sigma=1.0, truncate=2.5, tile_size=16)
    geotiff.write_raster(alpha, f"{at}/alpha.tif", _header(spark, sf_dir, 1), ["alpha"], sparse=0)
    return geotiff.read_local(spark, f"{at}/alpha.tif").drop("path")


@query("SELECT * FROM (VALUES (0, 0, 0, 0), (1, 255, 0, 0), (2, 0, 128, 64), (3, 9, 9, 9)) t(value, r, g, b)")
def file_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The color table of a written file."""
    colors = {1: (255, 0, 0), 2: (0, 128, 64), 3: (9, 9, 9)}
    path = f"{folder(spark, 'file_palette')}/classes.tif"
    x = layers(spark, sf_dir).select("row", "col", (F.col("code") % 4).alias("class"))
    geotiff.write_raster(x, path, _header(spark, sf_dir, 1, colormap=colors, photometric=3), ["class"])
    found = tiff.read_header(tiff.file_reader(path)).colormap
    return spark.createDataFrame([(k, *found[k]) for k in range(4)], "value int, r int, g int, b int")


@query("SELECT * FROM (VALUES ('OTHER', 'kept'), ('VERSION', 'abc-dirty')) t(key, value)")
def file_retag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version put into a file's tags, and looked up in its header."""
    path = _rgb_file(spark, sf_dir, "file_retag", tags={"OTHER": "kept", "VERSION": "old"})
    geotiff.retag(path, {"VERSION": "abc-dirty"})
    return geotiff.metadata(spark, path).select(F.explode("tags").alias("key", "value"))


@query(f"WITH {LAYERS} SELECT row, col, a1 AS b1, a2 AS b2 FROM layers")
def file_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files, each written by a task, read as one raster."""
    at, h = f"{folder(spark, 'file_tiles')}/tiles", _header(spark, sf_dir, 2)
    geotiff.write_tiles(layers(spark, sf_dir).select("row", "col", "a1", "a2"), at, h, ["a1", "a2"], blocks=1)
    return geotiff.read_tiles(spark, at, h)


@query(f"WITH {LAYERS} SELECT row, col, CASE WHEN code <> 40 THEN round(v, 6) END AS b1 FROM layers")
def file_ascii_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, g = f"{folder(spark, 'file_ascii_grid')}/v.asc", grid(spark, sf_dir)
    values = layers(spark, sf_dir).select("row", "col", F.when(F.col("code") != 40, F.round("v", 6)).alias("v"))
    grids.write_ascii(values, path, g, "v", -9999.0)
    return grids.read_ascii(spark, path).drop("path")


@query(f"WITH {LAYERS} SELECT row, col, CASE WHEN row < 60 OR row >= 80 THEN a1 ELSE a2 END AS b1, CASE WHEN col < 10 THEN 7 ELSE a3 END AS b2 FROM layers")
def file_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A virtual raster over two bands of one file; the second source of the first band lies over the first, and the second band leaves columns out."""
    path = _rgb_file(spark, sf_dir, "file_mosaic")
    g = grid(spark, sf_dir)
    rect = lambda tag, x, y, w, h: f'<{tag} xOff="{x}" yOff="{y}" xSize="{w}" ySize="{h}"/>'
    source = lambda band, *where: f'<SimpleSource><SourceFilename relativeToVRT="1">layers.tif</SourceFilename><SourceBand>{band}</SourceBand>{rect("SrcRect", *where)}{rect("DstRect", *where)}</SimpleSource>'
    bands = f'<VRTRasterBand dataType="Byte" band="1"><NoDataValue>7</NoDataValue>{source(1, 0, 0, g.width, g.height)}{source(2, 0, 60, g.width, 20)}</VRTRasterBand><VRTRasterBand dataType="Byte" band="2">{source(3, 10, 0, g.width - 10, g.height)}</VRTRasterBand>'
    mosaic = path.replace("layers.tif", "all.vrt")
    with open(mosaic, "w") as file:
        file.write(f'<VRTDataset rasterXSize="{g.width}" rasterYSize="{g.height}"><SRS>EPSG:3857</SRS><GeoTransform>{g.x}, {g.dx}, 0, {g.y}, 0, {g.dy}</GeoTransform>{bands}</VRTDataset>')
    return grids.read_vrt(spark, mosaic)


@query(f"WITH {LAYERS} SELECT 'all.vrt' AS name, 'VRT' AS driver, 'uint8' AS dtype, 64 AS width, (max(row) + 1)::INTEGER AS height, 'EPSG:3857' AS crs FROM layers UNION ALL SELECT * FROM (VALUES ('empty.tif', '', '', -1, -1, ''), ('v.asc', 'AAIGrid', 'float64', 2, 1, ''))")
def file_metadata_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of other kinds of files, and a file without a byte."""
    at, g = folder(spark, "file_metadata_kinds"), grid(spark, sf_dir)
    for name, text in (("v.asc", "ncols 2\nnrows 1\nxllcenter 0.5\nyllcenter 0.5\ncellsize 1\n1 2\n"), ("empty.tif", ""), ("all.vrt", f'<VRTDataset rasterXSize="{g.width}" rasterYSize="{g.height}"><SRS>EPSG:3857</SRS><VRTRasterBand dataType="Byte"/></VRTDataset>')):
        with open(f"{at}/{name}", "w") as file:
            file.write(text)
    return geotiff.metadata(spark, at).select(F.element_at(F.split("path", "/"), -1).alias("name"), "driver", "dtype", "width", "height", "crs").fillna(-1).fillna("")


# ---------------------------------------------------------------- tile containers


def _mbtiles(spark: SparkSession, sf_dir: str, name: str) -> str:
    path = f"{folder(spark, name)}/a1.mbtiles"
    made = geometric.tile_pyramid(layers(spark, sf_dir), grid(spark, sf_dir), ("a1",), 12, 15)
    tiles.write_mbtiles(tiles.encode_tiles(made, ["a1"]), path, {"name": "a1"})
    return path


@query(f"WITH {TILED} SELECT zoom, tile_column, tile_row, row, col, a1 FROM tiled WHERE a1 > 0")
def mbtiles_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of images in a container, read back to pixels; 0 is also what a tile holds outside of the raster."""
    return tiles.decode_tiles(tiles.read_mbtiles(spark, _mbtiles(spark, sf_dir, "mbtiles_round_trip")), ["a1"]).where("a1 > 0")


@query("SELECT * FROM (VALUES ('format', 'png'), ('minzoom', '12'), ('maxzoom', '15'), ('name', 'a1')) t(name, value)")
def mbtiles_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(sorted(tiles.read_metadata(_mbtiles(spark, sf_dir, "mbtiles_metadata")).items()), "name string, value string")


@query(f"WITH {TILED}, t AS (SELECT DISTINCT zoom, tile_column, tile_row FROM tiled) SELECT min(zoom) AS min_zoom, max(zoom) AS max_zoom, count(*) AS addressed FROM t")
def pmtiles_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the header of a converted archive says."""
    source = _mbtiles(spark, sf_dir, "pmtiles_header")
    path = source.replace(".mbtiles", ".pmtiles")
    tiles.mbtiles_to_pmtiles(source, path)
    with open(path, "rb") as file:
        head = file.read(127)
    return spark.createDataFrame([(head[100], head[101], int.from_bytes(head[72:80], "little"))], "min_zoom int, max_zoom int, addressed long")


# ---------------------------------------------------------------- texts and folders


@query("SELECT * FROM (VALUES ('a.tif', 3::BIGINT, sha256('abc'), 'https://example.org/a', 'set'), ('B.TIFF', 0::BIGINT, sha256(''), 'Unknown', ''), ('c.asc', 5::BIGINT, sha256('12345'), 'https://example.org/c', '')) t(name, size_bytes, sha256, url, dataset)")
def file_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder's raster files with their sources out of a JSON file; other files are left out."""
    at = folder(spark, "file_manifest")
    for name, text in (("a.tif", "abc"), ("B.TIFF", ""), ("c.asc", "12345"), ("notes.txt", "x"), ("d.tif.aux.xml", "x")):
        with open(f"{at}/{name}", "w") as file:
            file.write(text)
    with open(f"{at}/sources.json", "w") as file:
        json.dump({"a.tif": {"url": "https://example.org/a", "dataset": "set"}, "c.asc": "https://example.org/c", "none.tif": "x"}, file)
    found = catalog.with_sources(catalog.list_rasters(spark, at), catalog.sources_frame(spark, config.load_sources(f"{at}/sources.json")))
    return found.select("name", "size_bytes", "sha256", F.col("source")["url"].alias("url"), F.coalesce(F.col("source")["dataset"], F.lit("")).alias("dataset"))


@query("SELECT * FROM (VALUES (0::BIGINT, 'B.TIFF'), (1::BIGINT, 'a.tif')) t(ix, name) WHERE false UNION ALL SELECT * FROM (VALUES (0::BIGINT, 'a.tif'), (1::BIGINT, 'B.TIFF'), (2::BIGINT, 'c.asc')) t(ix, name)")
def file_manifest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the written manifest, which come by name without case."""
    at = folder(spark, "file_manifest_order")
    for name in ("B.TIFF", "c.asc", "a.tif"):
        with open(f"{at}/{name}", "w") as file:
            file.write(name)
    files = catalog.with_sources(catalog.list_rasters(spark, at), catalog.sources_frame(spark, {}))
    text = catalog.manifest_json({"directory": "x"}, files)
    names = sorted(json.loads(text)["files"], key=str.lower)
    return spark.createDataFrame(list(enumerate(names)), "ix long, name string")


_YAML = """classes:
  - {name: dark_rock, rgb: "4d4339", ids: [21, 22, 23, 24, 25, 26, 27]}
  - {name: playa, rgb: "e3dbca", ids: [30, 31, 32, 33, 34]}
  - {name: water, rgb: "7d95ab", ids: [38, 39, 40, 41], value: 10}
  - {name: grass, ids: [45, 46, 47]}
options: {default_value: 0, input_nodata: [33]}
RAMPS:
  plain: {mode: color, color: "EF3E15"}
  shifted: {mode: hsv, saturation: 1.5, mid-adjust: 0.1, min-hue: 60, max-hue: 180, target-hue: 150}
  stored: {mode: file, file: ramp.txt}
  live: {mode: dynamic}
"""


def _yaml(spark: SparkSession, name: str) -> str:
    at = folder(spark, name)
    with open(f"{at}/config.yml", "w") as file:
        file.write(_YAML)
    with open(f"{at}/ramp.txt", "w") as file:
        file.write("# stored\n900 60 120 50 200\n100 30 90 160")
    return at


@query(f"WITH {_CLASSED} SELECT class, count(*) AS pixels FROM classed GROUP BY class")
def file_reclass_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules out of a YAML file."""
    rules = config.load_yaml(f"{_yaml(spark, 'file_reclass_config')}/config.yml")
    rules.pop("RAMPS")
    return reclassify.reclassify(layers(spark, sf_dir), reclassify.parse_config(rules)).groupBy("class").agg(F.count("*").alias("pixels"))


_BASE = "base(elev, r, g, b) AS (VALUES (900.0::DOUBLE, 60, 120, 50), (100.0::DOUBLE, 30, 90, 160))"


@query(f"""WITH {_BASE}, {_hsv_sql('base', 1.5, 0.0, 0.1, 0.0, 60.0, 180.0, 150.0)}, shifted AS (SELECT 'shifted' AS ramp, 'hsv' AS mode, elev, {_channel_sql(5)} AS r, {_channel_sql(3)} AS g, {_channel_sql(1)} AS b FROM out0)
SELECT * FROM shifted UNION ALL SELECT 'stored', 'file', elev, r, g, b FROM base UNION ALL SELECT * FROM (VALUES ('plain', 'color', -100.0::DOUBLE, 239, 62, 21), ('plain', 'color', 10000.0::DOUBLE, 239, 62, 21), ('live', 'dynamic', -1.0::DOUBLE, -1, -1, -1))""")
def file_ramp_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mode of a configured ramp."""
    at = _yaml(spark, "file_ramp_config")
    settings = config.load_yaml(f"{at}/config.yml")
    base = ramp.ramp_from_config(spark, settings, "stored", folder=at)[1]
    out = spark.createDataFrame([("live", ramp.ramp_settings(settings, "live")[0], -1.0, -1, -1, -1)], "ramp string, mode string, elev double, r int, g int, b int")
    for name in ("plain", "shifted", "stored"):
        mode, made = ramp.ramp_from_config(spark, settings, name, base, at)
        out = out.unionByName(made.where("is_data").select(F.lit(name).alias("ramp"), F.lit(mode).alias("mode"), "elev", "r", "g", "b"))
    return out


@query("SELECT * FROM (VALUES (1, 100.0::DOUBLE, 30, 90, 160), (2, 900.0::DOUBLE, 60, 120, 50)) t(ix, elev, r, g, b)")
def file_ramp_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ramp file parsed strictly, sorted, written and read again."""
    at = _yaml(spark, "file_ramp_strict")
    first = ramp.sort_ramp(ramp.parse_ramp(ramp.read_lines(spark, f"{at}/ramp.txt"), strict=True))
    ordered = spark.createDataFrame([(i, *r) for i, r in enumerate(first.drop("line_no").collect(), 1)], first.schema)
    ramp.write_ramp(ordered, f"{at}/sorted.txt")
    return ramp.parse_ramp(ramp.read_lines(spark, f"{at}/sorted.txt"), strict=True).select(F.col("line_no").alias("ix"), "elev", "r", "g", "b")


_OPTIONS = '<CreationOptionList><Option name="COMPRESS" type="string-select"><Value>LZW</Value><Value>NONE</Value></Option><Option name="Q" type="int" min="1" max="9"/><Option name="S"/></CreationOptionList>'


@query("SELECT event_id AS id, CASE event_id % 5 WHEN 1 THEN CASE WHEN user_id % 12 < 1 THEN 'below the minimum' WHEN user_id % 12 > 9 THEN 'above the maximum' END WHEN 2 THEN 'unknown option' END AS error FROM events")
def file_option_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options checked against a driver's own list, an XML file."""
    at = folder(spark, "file_option_schema")
    with open(f"{at}/options.xml", "w") as file:
        file.write(_OPTIONS)
    with open(f"{at}/options.xml") as file:
        schema = catalog.option_schema_from_xml(spark, "OWN", file.read())
    kinds = [F.lit("COMPRESS=fake"), F.concat(F.lit("Q="), (F.col("user_id") % 12).cast("string")), F.lit("R=1"), F.lit("S=any"), F.lit("Q")]
    flag = F.element_at(F.array(*kinds), (F.col("event_id") % 5 + 1).cast("int"))
    flags = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.lit("own").alias("driver"), flag.alias("flag"))
    return catalog.check_options(flags, schema).select("id", "error")


@query("SELECT c_custkey AS path, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS value FROM customer")
def version_in_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag out of a raster description in JSON."""
    c = table(spark, sf_dir, "customer")
    tags = F.when(F.col("c_custkey") % 3 > 0, F.create_map(F.lit("VERSION"), F.col("c_name"), F.lit("A"), F.lit("b"))).otherwise(F.create_map(F.lit("A"), F.lit("b")))
    info = F.to_json(F.struct(F.lit("GTiff").alias("driver"), F.create_map(F.lit(""), tags).alias("metadata")))
    return c.select(F.col("c_custkey").alias("path"), catalog.tag_of_info(info).alias("value"))


@query("SELECT * FROM (VALUES ('b.tif', true), ('done', true), ('refused', true), ('disabled', true)) t(what, ok)")
def file_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file copied under another name with a marker; refused where it exists, and not copied when disabled."""
    at = folder(spark, "file_publish")
    os.makedirs(f"{at}/to")
    with open(f"{at}/a.tif", "w") as file:
        file.write("abc")
    catalog.publish(f"{at}/a.tif", f"{at}/to", marker=f"{at}/marks/done", rename="b.tif")
    try:
        catalog.publish(f"{at}/a.tif", f"{at}/to", rename="b.tif")
        refused = False
    except FileExistsError:
        refused = True
    disabled = catalog.publish(f"{at}/a.tif", f"{at}/to", disable=True) is None and not os.path.exists(f"{at}/to/a.tif")
    rows = [("b.tif", os.path.exists(f"{at}/to/b.tif")), ("done", os.path.exists(f"{at}/marks/done")), ("refused", refused), ("disabled", disabled)]
    return spark.createDataFrame(rows, "what string, ok boolean")


# ---------------------------------------------------------------- streams


@query(f"WITH {LAYERS} SELECT row, col, greatest(0, least(255, round_even(a1 * (m / 255.0::DOUBLE) + c1 * (1.0::DOUBLE - m / 255.0::DOUBLE), 0)::INTEGER)) AS v FROM layers")
def stream_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pointwise operator over a stream of files."""
    at = folder(spark, "stream_blend")
    x = layers(spark, sf_dir).select("row", "col", "a1", "c1", "m")
    x.repartition(4).write.parquet(f"{at}/in")
    stream = pixels.read_pixels(spark, f"{at}/in", "row int, col int, a1 int, c1 int, m int", files_per_batch=2)
    pixels.write_pointwise(stream.select("row", "col", blend.blend_value("a1", "c1", "m").alias("v")), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.schema("row int, col int, v int").parquet(f"{at}/out")


@query(f"WITH {LAYERS} SELECT row // 4 AS row, col // 4 AS col, round(avg(v), 9) AS v FROM layers GROUP BY ALL")
def stream_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An operator that needs whole blocks, over micro-batches of whole blocks."""
    at = folder(spark, "stream_overviews")
    x = layers(spark, sf_dir).select("row", "col", "v").withColumn("part", F.expr("cast(row div 4 % 3 as int)"))
    for part in range(3):
        x.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = pixels.read_pixels(spark, f"{at}/in", "row int, col int, v double", files_per_batch=1)
    pixels.write_batches(stream, lambda b: geometric.overview(b, 4), f"{at}/out", f"{at}/state").awaitTermination()
    out = spark.read.schema("row int, col int, v double").parquet(f"{at}/out")
    return out.select("row", "col", F.round("v", 9).alias("v"))


# ---------------------------------------------------------------- checks


def _fails(f: Callable[[], object]) -> bool:
    try:
        f()
    except Exception:  # which one is part of the operator's tests
        return True
    return False


def _rules(**changes) -> Callable[[], object]:
    one = {"name": "a", "ids": [1]} | changes
    return lambda: reclassify.parse_config({"classes": [one]})


_CHECKS = ["alpha code range", "blank name", "dimensions", "duplicate value", "empty classes", "empty ids", "gamma", "halo", "negative id", "protection", "range", "rgb", "subset anchor", "tile size", "unique output"]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', true)" for c in _CHECKS) + ") t(\"check\", fails)")
def refused_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks that run before any pixel is read."""
    from cellweave import cli

    x = layers(spark, sf_dir).select("row", "col", "a1", "m")
    checks = {
        "alpha code range": _rules(ids=[10_000]),
        "blank name": _rules(name=" "),
        "dimensions": lambda: blend.check_aligned({"a": x, "b": x.where("row > 0 and col < 9")}),
        "duplicate value": lambda: reclassify.parse_config({"classes": [{"name": "a", "ids": [1], "value": 3}, {"name": "b", "ids": [2], "value": 3}]}),
        "empty classes": lambda: reclassify.parse_config({"classes": []}),
        "empty ids": _rules(ids=[]),
        "gamma": lambda: blend.Shading(hill_gamma=0.0),
        "halo": lambda: focal.halo(0.0, 2.5),
        "negative id": _rules(ids=[-1]),
        "protection": lambda: blend.Shading(protect_shadows=1.5),
        "range": lambda: blend.Shading(shadow_range=(60, 0)),
        "rgb": _rules(rgb="12345"),
        "subset anchor": lambda: geometric.subset_window(9, 9, 3, 2.0, 0.0),
        "tile size": lambda: focal.edge_feather(x, "m", tile_size=0),
        "unique output": lambda: cli.guard_output("/x/a.tif", True, "/x/a.tif"),
    }
    return spark.createDataFrame([(k, _fails(f)) for k, f in checks.items()], "check string, fails boolean")


@query("SELECT * FROM (VALUES ('COMPRES', 'COMPRESS'), ('TILD', 'TILED'), ('QQQQQQ', '')) t(word, meant)")
def option_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r["name"] for r in catalog.option_schema(spark).where("driver = 'GTIFF'").select("name").distinct().collect()]
    return spark.createDataFrame([(w, catalog.closest(w, names) or "") for w in ("COMPRES", "TILD", "QQQQQQ")], "word string, meant string")


@query(f"WITH {LAYERS} SELECT code, count(*) AS pixels FROM layers WHERE code NOT IN (33, -9999) AND code NOT BETWEEN 21 AND 27 GROUP BY code ORDER BY code LIMIT 5")
def unmapped_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's limit: the first ids that no rule maps."""
    rules = reclassify.parse_config({"classes": [{"name": "a", "ids": list(range(21, 28))}], "options": {"input_nodata": [33]}})
    return reclassify.unmapped(layers(spark, sf_dir), rules, most=5)
