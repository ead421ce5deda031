"""Catalog operators: manifests, validation, versions, creation options, presence checks, publishing."""

from __future__ import annotations

import difflib
import json
import os
import shutil
import subprocess
from collections.abc import Iterable, Sequence
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.sources.listing import empty_files

EXTENSIONS = ("tif", "tiff", "vrt", "asc", "img")

# ---------------------------------------------------------------- manifest


def list_rasters(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, size_bytes, modified_utc, sha256 of a folder's raster files, by name without case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    known = files.select("path", name.alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("time"), F.sha2("content", 256).alias("sha256"))
    if empty := empty_files(spark, folder):
        rows = spark.createDataFrame(empty, "path string, name string, time timestamp")
        known = known.unionByName(rows.select("path", "name", F.lit(0).cast("long").alias("size_bytes"), "time", F.sha2(F.lit("").cast("binary"), 256).alias("sha256")))
    kept = known.where(F.lower("name").rlike(rf"\.({'|'.join(EXTENSIONS)})$"))
    return kept.select("path", "name", "size_bytes", utc(F.col("time")).alias("modified_utc"), "sha256")


def utc(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def sources_frame(spark: SparkSession, sources: dict) -> DataFrame:
    """name, source (a map) of a mapping from file name to a URL or to an object of strings."""
    rows = [(name, {"url": x} if isinstance(x, str) else {k: str(v) for k, v in (x or {}).items()}) for name, x in sources.items()]
    return spark.createDataFrame(rows, "name string, source map<string,string>")


def with_sources(files: DataFrame, sources: DataFrame) -> DataFrame:
    """files with their source; those without one get url Unknown."""
    unknown = F.create_map(F.lit("url"), F.lit("Unknown"))
    entry = F.when(F.map_contains_key("source", "url"), F.col("source")).otherwise(F.map_concat("source", unknown))
    return files.join(sources, "name", "left").withColumn("source", F.coalesce(entry, unknown))


def manifest_json(header: dict, files: DataFrame) -> str:
    """Indented JSON with sorted keys; files is a catalog of one folder."""
    rows = files.orderBy(F.lower("name")).toJSON().collect()
    entries = {}
    for row in map(json.loads, rows):
        name = row.pop("name")
        row.pop("path", None)
        entries[name] = row
    return json.dumps(header | {"files": entries}, indent=2, sort_keys=True)


# ---------------------------------------------------------------- validation


def validate_rasters(rasters: DataFrame, min_bytes: int = 1000, min_pixels: int = 1000) -> DataFrame:
    """rasters (size_bytes, width, height, null where unreadable) with `error`: the first check that fails, else null. A minimum itself passes."""
    small = F.format_string("%s bytes, fewer than %d", F.col("size_bytes").cast("string"), F.lit(min_bytes))
    few = F.format_string("%s pixels, fewer than %d", (F.col("width").cast("long") * F.col("height")).cast("string"), F.lit(min_pixels))
    error = (
        F.when(F.col("size_bytes").isNull(), F.lit("file is missing"))
        .when(F.col("size_bytes") < min_bytes, small)
        .when(F.col("width").isNull() | F.col("height").isNull(), F.lit("not a raster"))
        .when(F.col("width").cast("long") * F.col("height") < min_pixels, few)
    )
    return rasters.withColumn("error", error)


def require_valid(rasters: DataFrame, **limits: int) -> DataFrame:
    """The same rows, but the query fails at the first error."""
    checked = validate_rasters(rasters, **limits)
    return checked.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(F.lit(True))).drop("error")


def presence(pixels: DataFrame, ids: Sequence[int], x_cutoff: float, x_of: Column, code: str = "code", block: int | None = None, dx: float = 1.0, x0: float = 0.0, width: int | None = None) -> DataFrame:
    """code: which of the ids occur west of a cutoff. With a block width, whole blocks count by the x of their centre."""
    if block is not None:
        begin = F.floor(F.col("col") / block) * block
        wide = F.lit(float(block)) if width is None else F.least(F.lit(float(block)), F.lit(float(width)) - begin)
        x_of = (begin + wide / 2.0) * dx + x0
    return pixels.where(F.col(code).isin(list(ids)) & (x_of <= x_cutoff)).select(code).distinct()


# ---------------------------------------------------------------- versions


def git_version(folder: str = ".") -> str | None:
    """The commit of a folder's repository, with -dirty if files differ from it; None outside of one."""
    git = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True)
    head = git("rev-parse", "HEAD")
    if head.returncode:
        return None
    return head.stdout.strip() + ("-dirty" if git("status", "--porcelain").stdout.strip() else "")


def set_tags(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """metadata (path, key, value) with the changes put in: an upsert by path and key."""
    old = metadata.join(changes.select("path", "key"), ["path", "key"], "left_anti")
    return old.select("path", "key", "value").unionByName(changes.select("path", "key", "value"))


def get_tag(metadata: DataFrame, paths: DataFrame, key: str = "VERSION") -> DataFrame:
    """path, value of each path; null without that tag."""
    tags = metadata.where(F.col("key") == key).select("path", "value")
    return paths.select("path").join(tags, "path", "left")


def tag_of_info(info: Column, key: str = "VERSION") -> Column:
    """A tag out of a raster description in JSON, metadata under its empty domain."""
    domains = F.from_json(F.get_json_object(info, "$.metadata"), T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))
    return F.element_at(F.element_at(domains, F.lit("")), F.lit(key))


# ---------------------------------------------------------------- creation options

#: Options that every driver is taken to support.
GENERIC = ("COPY_SRC_OVERVIEWS", "COMPRESS", "NUM_THREADS", "BIGTIFF")

# Creation options of the drivers that the engine writes.
_GTIFF = {
    "COMPRESS": ("string-select", None, None, ["NONE", "LZW", "PACKBITS", "JPEG", "CCITTRLE", "CCITTFAX3", "CCITTFAX4", "DEFLATE", "LZMA", "ZSTD", "WEBP", "LERC", "LERC_DEFLATE", "LERC_ZSTD"]),
    "PREDICTOR": ("int", 1.0, 3.0, []),
    "ZLEVEL": ("int", 1.0, 12.0, []),
    "ZSTD_LEVEL": ("int", 1.0, 22.0, []),
    "JPEG_QUALITY": ("int", 1.0, 100.0, []),
    "WEBP_LEVEL": ("int", 1.0, 100.0, []),
    "WEBP_QUALITY": ("int", 1.0, 100.0, []),
    "WEBP_LOSSLESS": ("boolean", None, None, []),
    "TILED": ("boolean", None, None, []),
    "BLOCKXSIZE": ("int", None, None, []),
    "BLOCKYSIZE": ("int", None, None, []),
    "PHOTOMETRIC": ("string-select", None, None, ["MINISBLACK", "MINISWHITE", "PALETTE", "RGB", "CMYK", "YCBCR", "CIELAB", "ICCLAB", "ITULAB"]),
    "INTERLEAVE": ("string-select", None, None, ["BAND", "PIXEL"]),
    "ALPHA": ("string-select", None, None, ["YES", "NO", "PREMULTIPLIED", "NON-PREMULTIPLIED", "UNSPECIFIED"]),
    "NBITS": ("int", None, None, []),
    "SPARSE_OK": ("boolean", None, None, []),
    "TFW": ("boolean", None, None, []),
    "PROFILE": ("string-select", None, None, ["GDALGeoTIFF", "GeoTIFF", "BASELINE"]),
    "BIGTIFF": ("string-select", None, None, ["YES", "NO", "IF_NEEDED", "IF_SAFER"]),
    "NUM_THREADS": ("string", None, None, []),
}
_MBTILES = {
    "NAME": ("string", None, None, []),
    "DESCRIPTION": ("string", None, None, []),
    "TYPE": ("string-select", None, None, ["overlay", "baselayer"]),
    "VERSION": ("string", None, None, []),
    "BLOCKSIZE": ("int", 64.0, 8192.0, []),
    "TILE_FORMAT": ("string-select", None, None, ["PNG", "PNG8", "JPEG", "WEBP"]),
    "QUALITY": ("int", 1.0, 100.0, []),
    "ZLEVEL": ("int", 1.0, 9.0, []),
    "DITHER": ("boolean", None, None, []),
    "ZOOM_LEVEL_STRATEGY": ("string-select", None, None, ["AUTO", "LOWER", "UPPER"]),
    "RESAMPLING": ("string-select", None, None, ["NEAREST", "BILINEAR", "CUBIC", "CUBICSPLINE", "LANCZOS", "MODE", "AVERAGE"]),
    "WRITE_BOUNDS": ("boolean", None, None, []),
}
OPTION_SCHEMAS = {"GTIFF": _GTIFF, "MBTILES": _MBTILES}


def option_schema(spark: SparkSession, schemas: dict = OPTION_SCHEMAS) -> DataFrame:
    """driver, name, type, min, max, values."""
    rows = [(driver, name, *spec) for driver, options in schemas.items() for name, spec in options.items()]
    return spark.createDataFrame(rows, "driver string, name string, type string, min double, max double, values array<string>")


def option_schema_from_xml(spark: SparkSession, driver: str, xml: str) -> DataFrame:
    """The same of a driver's CreationOptionList, a short text that is parsed where the driver runs."""
    number = lambda x: None if x is None else float(x)
    options = {o.get("name"): (o.get("type", "string"), number(o.get("min")), number(o.get("max")), [v.text for v in o.findall("Value") if v.text]) for o in ElementTree.fromstring(xml).iter("Option") if o.get("name")}
    return option_schema(spark, {driver: options})


def installed_options(spark: SparkSession, driver: str) -> DataFrame | None:
    """The options of a driver that an installed gdalinfo describes; None without one or for an unknown driver."""
    tool = shutil.which("gdalinfo")
    if tool is None:
        return None
    said = subprocess.run([tool, "--format", driver], capture_output=True, text=True)
    start, end = said.stdout.find("<CreationOptionList"), said.stdout.find("</CreationOptionList>")
    if said.returncode or start < 0 or end < 0:
        return None
    return option_schema_from_xml(spark, driver.upper(), said.stdout[start : end + len("</CreationOptionList>")])


def check_options(flags: DataFrame, schema: DataFrame) -> DataFrame:
    """flags (id, driver, flag) with key, value and `error`, null if the option is allowed.

    Flags without = and generic options pass; so does everything for a driver without a
    schema. Numbers have to be in the range that the schema names.
    """
    generic = list(GENERIC)
    parsed = flags.withColumns({"key": F.upper(F.substring_index("flag", "=", 1)), "value": F.expr("substring(flag, instr(flag, '=') + 1)"), "has_value": F.col("flag").contains("=")})
    spec = schema.select(F.upper("driver").alias("__d"), F.upper("name").alias("key"), F.col("type").alias("__type"), F.col("min").alias("__min"), F.col("max").alias("__max"), F.col("values").alias("__values"))
    drivers = spec.select("__d").distinct().withColumnRenamed("__d", "__known")
    # schemas are fixed tables of a few hundred rows
    joined = parsed.join(F.broadcast(spec), (F.upper("driver") == F.col("__d")) & (parsed["key"] == spec["key"]), "left").drop(spec["key"])
    joined = joined.join(F.broadcast(drivers), F.upper("driver") == F.col("__known"), "left")
    number = F.when(F.col("value").rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.col("value").cast("double"))
    numeric = F.col("__type").isin("int", "integer", "float")
    error = (
        F.when(~F.col("has_value") | F.col("__known").isNull() | F.col("key").isin(generic), F.lit(None).cast("string"))
        .when(F.col("__type").isNull(), F.lit("unknown option"))
        .when(numeric & number.isNotNull() & (number < F.col("__min")), F.lit("below the minimum"))
        .when(numeric & number.isNotNull() & (number > F.col("__max")), F.lit("above the maximum"))
        .when((F.size("__values") > 0) & ~F.exists("__values", lambda v: F.upper(v) == F.upper("value")), F.lit("not an allowed value"))
    )
    return joined.withColumn("error", error).drop("has_value", "__d", "__type", "__min", "__max", "__values", "__known")


def closest(word: str, names: Iterable[str]) -> str | None:
    """The most similar name, if it is similar enough to be meant."""
    found = difflib.get_close_matches(word, list(names), n=1, cutoff=0.6)
    return found[0] if found else None


def conflicts(options: dict[str, str]) -> str | None:
    """Why options can't be combined for a GeoTIFF, or None: WebP has no YCbCr form, and predictor 3 is for floats."""
    given = {k.upper(): str(v).upper() for k, v in options.items()}
    if given.get("COMPRESS") == "WEBP" and given.get("PHOTOMETRIC") == "YCBCR":
        return "WEBP can't be combined with PHOTOMETRIC=YCBCR"
    if given.get("PREDICTOR") == "3" and given.get("__DTYPE", "UINT8").startswith(("UINT", "INT")):
        return "PREDICTOR=3 needs floating-point values"
    return None


def command_flags(spark: SparkSession, args: Sequence[str]) -> DataFrame:
    """id, driver, flag of a command line; only of tools that begin with gdal, and with a known driver."""
    driver = "GTiff" if args and args[0] in ("gdal_translate", "gdalwarp") else None
    flags, i = [], 1
    while i < len(args):
        if args[i] in ("-of", "-co") and i + 1 < len(args):
            if args[i] == "-of":
                driver = args[i + 1]
            else:
                flags.append(args[i + 1])
            i += 1
        i += 1
    rows = [(k, driver, x) for k, x in enumerate(flags)] if driver and args and args[0].startswith("gdal") else []
    return spark.createDataFrame(rows, "id int, driver string, flag string")


def require_options(spark: SparkSession, args: Sequence[str]) -> None:
    """Raises ValueError at the first wrong creation option of a command line, with a suggestion for unknown ones."""
    schema, flags = option_schema(spark), command_flags(spark, args)
    for driver in {r["driver"].upper() for r in flags.select("driver").distinct().collect()}:
        if (own := installed_options(spark, driver)) is not None:  # what is installed goes before the built-in table
            schema = schema.where(F.upper("driver") != driver).unionByName(own)
    wrong = check_options(flags, schema).where("error is not null").orderBy("id").first()
    if wrong is None:
        return
    names = [r["name"] for r in schema.where(F.upper("driver") == wrong["driver"].upper()).select("name").collect()]
    meant = closest(wrong["key"], [*names, *GENERIC]) if wrong["error"] == "unknown option" else None
    raise ValueError(f"driver {wrong['driver']}: {wrong['key']}: {wrong['error']}" + (f"; did you mean {meant}?" if meant else "") + (f" Options: {', '.join(sorted(names))}" if wrong["error"] == "unknown option" else ""))


# ---------------------------------------------------------------- publish


def publish(source: str, directory: str, host: str | None = None, marker: str | None = None, disable: bool = False, rename: str | None = None, overwrite: bool = False) -> str | None:
    """Copies a file into a folder here or on a host and leaves a marker file; what it made, or None if disabled."""
    if not os.path.exists(source):
        raise FileNotFoundError(source)
    name, made = rename or Path(source).name, None
    if not disable:
        if host and host != "None":
            made = f"{host}:{directory}/{name}"
            subprocess.run(["scp", source, made], check=True)
        else:
            if not os.path.isdir(directory):
                raise NotADirectoryError(directory)
            made = os.path.join(directory, name)
            if os.path.exists(made) and not overwrite:
                raise FileExistsError(f"{made} exists; it is replaced only with overwrite")
            shutil.copy2(source, made)
    if marker:
        Path(marker).parent.mkdir(parents=True, exist_ok=True)
        Path(marker).touch()
    return made
