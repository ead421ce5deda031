"""Command line: python -m cellweave COMMAND ..., one subcommand per raster operation."""

from __future__ import annotations

import argparse
import datetime
import os
import shutil
import subprocess
import sys
from collections.abc import Callable
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.crs import transform, ways
from cellweave.functions.expr import to_byte
from cellweave.operators import blend, catalog, focal, geometric, ramp, reclassify
from cellweave.sources import geotiff, tiff, tiles
from cellweave.sources.config import load_reclass_config, load_sources

COMMANDS: dict[str, tuple[Callable, Callable]] = {}


def command(name: str, arguments: Callable[[argparse.ArgumentParser], None]):
    def register(f: Callable) -> Callable:
        COMMANDS[name] = (arguments, f)
        return f

    return register


def session() -> SparkSession:
    spark = SparkSession.builder.appName("cellweave").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    geotiff.register(spark)
    return spark


# ---------------------------------------------------------------- files


def header_of(path: str) -> tiff.Header:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return tiff.read_header(tiff.file_reader(path))


def pixels_of(spark: SparkSession, path: str) -> DataFrame:
    return geotiff.read_local(spark, path).drop("path")


def bands_of(header: tiff.Header) -> list[str]:
    return [f"b{i + 1}" for i in range(header.count)]


def compression_of(name: str) -> int:
    """The number of a compression by its name. Those without an encoder here are replaced by deflate, which loses nothing, with a warning."""
    found = tiff.COMPRESSIONS.get(name.lower())
    if found is None:
        print(f"warning: no encoder for COMPRESS={name}; written with deflate, without loss", file=sys.stderr)
    return found or tiff.COMPRESSIONS["deflate"]


def out_header(like: tiff.Header, options: list[str] | None = None, **changes) -> tiff.Header:
    """A tiled header like an input's, with creation options KEY=VALUE."""
    kind = like.compression if like.compression in tiff.COMPRESSIONS.values() else 8
    h = replace(like, block=(256, 256), tiled=True, planar=1, predictor=1, compression=kind, order="<", offsets=[], sizes=[], colormap={}, **changes)
    given = {k.lower(): v for k, _, v in (o.partition("=") for o in options or []) if v}
    check = catalog.conflicts(given | {"__dtype": h.dtype})
    if check:
        raise ValueError(check)
    if "compress" in given:
        h.compression = compression_of(given["compress"])
    h.predictor = int(given.get("predictor", h.predictor))
    if "blockxsize" in given or "blockysize" in given:
        h.block = (int(given.get("blockysize", 256)), int(given.get("blockxsize", 256)))
    h.photometric = 2 if h.count >= 3 else 1
    return h


def guard_output(path: str, overwrite: bool, *inputs: str) -> None:
    if os.path.isdir(path):
        raise IsADirectoryError(path)
    if any(os.path.abspath(path) == os.path.abspath(i) for i in inputs):
        raise ValueError("output and input are the same file")
    if not Path(path).suffix:
        raise ValueError("the output needs a suffix")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(f"{path} exists; use --overwrite")


def _io(p: argparse.ArgumentParser) -> None:
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--overwrite", action="store_true", default=False)


def _co(p: argparse.ArgumentParser) -> None:
    p.add_argument("--co", action="append", default=[], metavar="KEY=VALUE")


# ---------------------------------------------------------------- ramps


def _adjust_args(p: argparse.ArgumentParser) -> None:
    _io(p)
    for name, default in (("saturation", 1.0), ("shadow-adjust", 0.0), ("mid-adjust", 0.0), ("highlight-adjust", 0.0), ("min-hue", 0.0), ("max-hue", 0.0), ("target-hue", 0.0), ("elev-adjust", 1.0)):
        p.add_argument(f"--{name}", type=float, default=default)


@command("adjust_color_file", _adjust_args)
def adjust_color_file(a: argparse.Namespace) -> None:
    table = ramp.parse_ramp(ramp.read_lines(session(), a.input))
    factors = {k: getattr(a, k) for k in ("saturation", "shadow_adjust", "mid_adjust", "highlight_adjust", "min_hue", "max_hue", "target_hue", "elev_adjust")}
    ramp.write_ramp(ramp.adjust_color_file(table, **factors), a.output)


# ---------------------------------------------------------------- pointwise


def _reclassify_args(p: argparse.ArgumentParser) -> None:
    _io(p)
    p.add_argument("--config", required=True)


@command("reclassify", _reclassify_args)
def reclassify_raster(a: argparse.Namespace) -> None:
    config = load_reclass_config(a.config)
    o, like = config.options, header_of(a.input)
    guard_output(a.output, True, a.input)
    out = Path(a.output)
    alpha_path = str(o.alpha_output or out.with_name(f"{out.stem}_alpha{out.suffix}"))
    if o.write_alpha:
        guard_output(alpha_path, True, a.input, a.output)
    spark = session()
    nodata = [int(like.nodata)] if like.nodata is not None and like.nodata == like.nodata else []
    classed = reclassify.reclassify(pixels_of(spark, a.input).select("row", "col", F.col("b1").alias("code")), config, input_nodata=nodata).persist()
    try:
        h = replace(out_header(like, dtype="uint8", count=1, nodata=float(o.nodata_value)), compression=compression_of(o.compress), block=(o.tile_size, o.tile_size))
        colors = {r["value"]: (r["r"], r["g"], r["b"]) for r in reclassify.palette(spark, config).collect()} if any(r.rgb for r in config.rules) else {}
        geotiff.write_raster(classed, a.output, replace(h, colormap=colors, photometric=3 if colors else 1), ["class"])
        if o.write_alpha:
            geotiff.write_raster(classed, alpha_path, replace(h, nodata=None, photometric=1), ["alpha"], sparse=0 if o.alpha_sparse_ok else None)
        if o.report_unmapped:
            left = reclassify.unmapped(classed, config, input_nodata=nodata, most=o.max_unmapped_ids).collect()
            print("Unmapped ids:", ", ".join(str(r["code"]) for r in left) or "none")
    finally:
        classed.unpersist()


def _blend_args(p: argparse.ArgumentParser) -> None:
    for name in ("layerA", "layerB", "mask", "output"):
        p.add_argument(name)
    _co(p)


@command("masked_blend", _blend_args)
def masked_blend(a: argparse.Namespace) -> None:
    ha, hb, hm = map(header_of, (a.layerA, a.layerB, a.mask))
    if len({(h.width, h.height) for h in (ha, hb, hm)}) > 1:
        raise ValueError("dimensions differ")
    h, spark = out_header(ha, a.co, dtype="uint8"), session()
    names = bands_of(ha)
    b = pixels_of(spark, a.layerB)
    if hb.count == 1:
        b = b.select("row", "col", *(F.col("b1").alias(n) for n in names))
    out = blend.masked_blend(pixels_of(spark, a.layerA), b, pixels_of(spark, a.mask).select("row", "col", F.col("b1").alias("m")), names)
    geotiff.write_raster(out, a.output, h, names)


def _shade_args(p: argparse.ArgumentParser) -> None:
    for name in ("hillshade", "color", "output"):
        p.add_argument(name)
    _co(p)
    d = blend.Shading()
    for name in ("protect-shadows", "protect-highlights", "hill-floor", "hill-gamma", "hill-ceil", "shade-strength"):
        p.add_argument(f"--{name}", type=float, default=getattr(d, name.replace("-", "_")))
    for name in ("shadow-range", "highlight-range"):
        p.add_argument(f"--{name}", type=float, nargs=2, default=list(getattr(d, name.replace("-", "_"))))


@command("hillshade_blend", _shade_args)
def hillshade_blend(a: argparse.Namespace) -> None:
    hh, hc = header_of(a.hillshade), header_of(a.color)
    if (hh.width, hh.height) != (hc.width, hc.height):
        raise ValueError("dimensions differ")
    if hc.count not in (3, 4):
        raise ValueError("the color raster needs 3 or 4 bands")
    options = blend.Shading(a.protect_shadows, a.protect_highlights, tuple(a.shadow_range), tuple(a.highlight_range), a.hill_floor, a.hill_gamma, a.hill_ceil, a.shade_strength)
    spark = session()
    out = blend.hillshade_blend(pixels_of(spark, a.hillshade).select("row", "col", F.col("b1").alias("hill")), pixels_of(spark, a.color), bands=("b1", "b2", "b3"), alpha="b4" if hc.count == 4 else None, options=options, dtype=hh.dtype, nodata=hh.nodata, fill=hh.nodata is not None)
    geotiff.write_raster(out, a.output, out_header(hc, a.co, dtype="uint8"), bands_of(hc))


# ---------------------------------------------------------------- neighbourhood


def _blur_args(p: argparse.ArgumentParser) -> None:
    _io(p)
    p.add_argument("--sigma", type=float, default=1.0)
    p.add_argument("--truncate", type=float, default=2.5)
    p.add_argument("--compress", default="deflate")
    p.add_argument("--tile-size", type=int, default=256)


@command("blur", _blur_args)
def blur(a: argparse.Namespace) -> None:
    like = header_of(a.input)
    if like.count != 1:
        raise ValueError(f"the mask needs one band, not {like.count}")
    alpha = focal.edge_feather(pixels_of(session(), a.input), "b1", a.sigma, a.truncate, a.tile_size)
    h = replace(out_header(like, dtype="uint8", nodata=None), compression=compression_of(a.compress), block=(a.tile_size, a.tile_size))
    geotiff.write_raster(alpha, a.output, h, ["alpha"], sparse=0)


def _proximity_args(p: argparse.ArgumentParser) -> None:
    _io(p)
    p.add_argument("--targets", default="0,1,2,3,5,6")
    p.add_argument("--maxdist", type=float, default=None)


@command("proximity", _proximity_args)
def proximity(a: argparse.Namespace) -> None:
    like = header_of(a.input)
    targets = [int(x) for x in a.targets.split(",") if x.strip()]
    out = focal.proximity(pixels_of(session(), a.input), targets, "b1", a.maxdist)
    geotiff.write_raster(out, a.output, out_header(like, dtype="float32", count=1, nodata=None), ["distance"])


def _vignette_args(p: argparse.ArgumentParser) -> None:
    _io(p)
    _co(p)
    for name, default in (("border", 5.0), ("noise", 20.0), ("warp", 60.0)):
        p.add_argument(f"--{name}", type=float, default=default)
    p.add_argument("--replace-alpha", action="store_true")
    p.add_argument("--seed", type=int, default=None)


@command("vignette", _vignette_args)
def vignette(a: argparse.Namespace) -> None:
    like = header_of(a.input)
    guard_output(a.output, True, a.input)
    if a.border <= 0:
        shutil.copy(a.input, a.output)
        return
    names = bands_of(like)
    alpha = names[-1] if like.count in (2, 4) else None
    out = focal.vignette(pixels_of(session(), a.input), like.height, like.width, alpha, a.border, a.noise, a.warp, a.replace_alpha, a.seed, out=alpha or "alpha")
    h = out_header(like, ["COMPRESS=DEFLATE", *a.co], count=like.count + (alpha is None))
    geotiff.write_raster(out, a.output, h, names if alpha else [*names, "alpha"])


# ---------------------------------------------------------------- geometry


def _subset_args(p: argparse.ArgumentParser) -> None:
    _io(p)
    p.add_argument("--size", type=int, default=4000)
    p.add_argument("--x-anchor", type=float, default=0.5)
    p.add_argument("--y-anchor", type=float, default=0.5)


@command("create_subset", _subset_args)
def create_subset(a: argparse.Namespace) -> None:
    like = header_of(a.input)
    guard_output(a.output, True, a.input)
    x, y, w, hgt = geometric.subset_window(like.width, like.height, a.size, a.x_anchor, a.y_anchor)
    out = geometric.create_subset(pixels_of(session(), a.input), like.width, like.height, a.size, a.x_anchor, a.y_anchor)
    h = out_header(like, width=w, height=hgt)
    if like.transform:
        dx, _, x0, _, dy, y0 = like.transform
        h.transform = (dx, 0.0, x0 + x * dx, 0.0, dy, y0 + y * dy)
    geotiff.write_raster(out, a.output, h, bands_of(like))


def _align_args(p: argparse.ArgumentParser) -> None:
    for name in ("source", "template", "output"):
        p.add_argument(name)
    p.add_argument("-r", "--resampling-method", default="bilinear", choices=geometric.METHODS)
    _co(p)


@command("align_raster", _align_args)
def align_raster(a: argparse.Namespace) -> None:
    hs, ht = header_of(a.source), header_of(a.template)
    out = geometric.align(pixels_of(session(), a.source), geotiff.grid_of(hs), geotiff.grid_of(ht), bands_of(hs), a.resampling_method, hs.nodata)
    if hs.dtype.startswith(("uint", "int")):
        top = blend.LARGEST.get(hs.dtype, 2.0**53)
        out = out.withColumns({b: F.greatest(F.lit(0.0 if hs.dtype[0] == "u" else -top - 1), F.least(F.lit(top), F.rint(b))) for b in bands_of(hs)})
    geotiff.write_raster(out, a.output, out_header(hs, a.co, width=ht.width, height=ht.height, transform=ht.transform, crs=ht.crs), bands_of(hs))


def _mbtiles_args(p: argparse.ArgumentParser) -> None:
    _io(p)
    _co(p)
    p.add_argument("--mo", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("--min-zoom", type=int, default=None)
    p.add_argument("--max-zoom", type=int, default=None)
    p.add_argument("-r", "--resampling", default="CUBIC")
    p.add_argument("--levels", type=int, nargs="*", default=[2, 4, 8, 16, 32, 64, 128])


@command("create_mbtiles", _mbtiles_args)
def create_mbtiles(a: argparse.Namespace) -> None:
    like = header_of(a.input)
    guard_output(a.output, a.overwrite, a.input)
    g = geotiff.grid_of(like)
    ways(g.crs)  # fails for a CRS that isn't known
    method = a.resampling.lower()
    if method not in geometric.METHODS:
        raise ValueError(f"unknown resampling {a.resampling}")
    spark = session()
    catalog.require_options(spark, ["gdal_translate", "-of", "MBTILES", *(x for o in a.co for x in ("-co", o))])
    top = geometric.native_zoom(g) if a.max_zoom is None else a.max_zoom
    low = max(0, top - len(a.levels)) if a.min_zoom is None else a.min_zoom
    names = bands_of(like)
    made = tiles.encode_tiles(geometric.tile_pyramid(pixels_of(spark, a.input), g, names, low, top, method=method, nodata=like.nodata), names)
    xmin, ymin, xmax, ymax = geometric.mercator_extent(g)
    corners = spark.createDataFrame([(xmin, ymin), (xmax, ymax)], "x double, y double")
    (west, south), (east, north) = corners.select(*transform(F.col("x"), F.col("y"), "EPSG:3857", "EPSG:4326")).collect()
    about = {"name": Path(a.output).stem, "type": "overlay", "version": "1.1", "description": Path(a.output).stem, "bounds": ",".join(f"{v:.9f}" for v in (west, south, east, north))}
    tiles.write_mbtiles(made, a.output, about | {k: v for k, _, v in (m.partition("=") for m in a.mo)})


@command("create_pmtiles", _io)
def create_pmtiles(a: argparse.Namespace) -> None:
    if not os.path.exists(a.input):
        raise FileNotFoundError(a.input)
    guard_output(a.output, a.overwrite, a.input)
    if not a.input.endswith(".mbtiles"):
        print(f"warning: {a.input} doesn't end in .mbtiles", file=sys.stderr)
    tiles.mbtiles_to_pmtiles(a.input, a.output)


# ---------------------------------------------------------------- catalog


def _manifest_args(p: argparse.ArgumentParser) -> None:
    p.add_argument("--dir", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--sources", default=None)


@command("manifest", _manifest_args)
def manifest(a: argparse.Namespace) -> None:
    if not os.path.isdir(a.dir):
        raise NotADirectoryError(a.dir)
    spark = session()
    sources = load_sources(a.sources)
    now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    header = {"generated_at_utc": now, "directory": os.path.abspath(a.dir), "hash_algo": "sha256", "tool_versions": {"python": sys.version.split()[0], "spark": spark.version}}
    files = catalog.with_sources(catalog.list_rasters(spark, a.dir), catalog.sources_frame(spark, sources))
    described = files.join(geotiff.metadata(spark, a.dir).drop("size_bytes", "tags"), "path", "left")
    with open(a.output, "w") as file:
        file.write(catalog.manifest_json(header, described))


def _validate_args(p: argparse.ArgumentParser) -> None:
    p.add_argument("input")
    p.add_argument("--min-bytes", type=int, default=1000)
    p.add_argument("--min-pixels", type=int, default=1000)


@command("validate_raster", _validate_args)
def validate_raster(a: argparse.Namespace) -> None:
    spark = session()
    if not os.path.exists(a.input):
        raise FileNotFoundError(a.input)
    error = catalog.validate_rasters(geotiff.metadata(spark, a.input), a.min_bytes, a.min_pixels).first()["error"]
    if error:
        raise ValueError(f"{a.input}: {error}")


def _target(p: argparse.ArgumentParser) -> None:
    p.add_argument("target_file")


@command("add_version", _target)
def add_version(a: argparse.Namespace) -> None:
    version = catalog.git_version(os.getcwd())
    if version is None:
        raise ValueError("not in a git repository")
    geotiff.retag(a.target_file, {"VERSION": version})


@command("get_version", _target)
def get_version(a: argparse.Namespace) -> None:
    try:
        print(header_of(a.target_file).tags.get("VERSION"))
    except tiff.NotARaster:
        print(None)


def _publish_args(p: argparse.ArgumentParser) -> None:
    p.add_argument("source_file")
    p.add_argument("directory")
    for name in ("host", "marker-file", "rename"):
        p.add_argument(f"--{name}", default=None)
    for name in ("disable", "stamp-version", "overwrite"):
        p.add_argument(f"--{name}", action="store_true")


@command("publish", _publish_args)
def publish(a: argparse.Namespace) -> None:
    if a.stamp_version and not a.disable:
        add_version(argparse.Namespace(target_file=a.source_file))
    print(catalog.publish(a.source_file, a.directory, a.host, a.marker_file, a.disable, a.rename, a.overwrite))


def _run_args(p: argparse.ArgumentParser) -> None:
    p.add_argument("line", nargs=argparse.REMAINDER)


@command("run", _run_args)
def run(a: argparse.Namespace) -> None:
    """Checks the creation options of a command line, then runs it."""
    if not a.line:
        raise ValueError("no command")
    catalog.require_options(session(), a.line)
    subprocess.run(a.line, check=True)


# ---------------------------------------------------------------- color relief, an addition for ramps


def _relief_args(p: argparse.ArgumentParser) -> None:
    p.add_argument("input")
    p.add_argument("ramp")
    p.add_argument("output")
    _co(p)


@command("color_relief", _relief_args)
def color_relief(a: argparse.Namespace) -> None:
    like, spark = header_of(a.input), session()
    stops = ramp.parse_ramp(ramp.read_lines(spark, a.ramp), strict=True)
    out = ramp.color_relief(pixels_of(spark, a.input), stops, "b1")
    bytes_only = out.withColumns({c: to_byte(F.col(c).cast("double")) for c in "rgb"})
    geotiff.write_raster(bytes_only, a.output, out_header(like, a.co, dtype="uint8", count=3, nodata=None), ["r", "g", "b"])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cellweave", description=__doc__)
    parser.add_argument("-v", "--verbose", action="store_true")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (arguments, _) in sorted(COMMANDS.items()):
        arguments(commands.add_parser(name, help=(COMMANDS[name][1].__doc__ or name.replace("_", " ")).splitlines()[0]))
    a = parser.parse_args(argv)
    if a.verbose:
        print(f"{a.command}: {vars(a)}", file=sys.stderr)
    COMMANDS[a.command][1](a)
    return 0
