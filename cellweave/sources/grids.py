"""Rasters that aren't TIFF files: ASCII grids and virtual mosaics of GeoTIFF files."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators.geometric import Grid
from cellweave.sources import geotiff, tiff
from cellweave.sources.tables import stored

# ---------------------------------------------------------------- ASCII grids


def ascii_header(text: str) -> tuple[Grid, float | None, int]:
    """Grid, nodata and where the values begin, of an ASCII grid's text or a beginning of it that holds its header."""
    found, at = {}, 0
    for m in re.finditer(r"\s*([A-Za-z_]+)\s+(\S+)[ \t]*\r?\n", text):
        if m.start() != at:
            break
        found[m[1].lower()] = float(m[2])
        at = m.end()
    try:
        width, height, size = int(found["ncols"]), int(found["nrows"]), found["cellsize"]
        x = found["xllcorner"] if "xllcorner" in found else found["xllcenter"] - size / 2
        y = found["yllcorner"] if "yllcorner" in found else found["yllcenter"] - size / 2
    except KeyError as e:
        raise tiff.NotARaster(f"no ASCII grid: {e.args[0]} is missing") from None
    return Grid(x, y + height * size, size, -size, width, height), found.get("nodata_value"), at


#: Characters of a file's beginning that hold its header.
BEGINNING = 4096


def read_ascii(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, b1 (a double, null for nodata) of ASCII grids in any store that Spark reads, a part of a file to a task.

    A first pass counts the words of each part of a file, so that the parts know where
    their values lie in the raster.
    """
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
        """Runs of lines of one part of a file."""
        for b in batches:
            names, starts = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            codes, texts = names.indices.to_numpy(), b.column(2)
            cuts = [0, *(np.flatnonzero((codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])) + 1), b.num_rows]
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    yield (names.dictionary[int(codes[i])].as_py(), int(starts[i])), texts.slice(i, j - i).to_pylist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], list] = {}
        for part, texts in parts(batches):
            one = found.setdefault(part, [0, ""])
            one[0] += sum(len(x.split()) for x in texts)
            for x in texts if part[1] == 0 else ():
                if len(one[1]) >= BEGINNING:
                    break
                one[1] += x[:BEGINNING] + "\n"
        yield pa.RecordBatch.from_pylist([{"path": p, "start": s, "n": n, "head": h} for (p, s), (n, h) in found.items()], schema=pa.schema([("path", pa.string()), ("start", pa.int64()), ("n", pa.int64()), ("head", pa.string())]))

    # a row for each part of a file
    grids: dict[str, tuple[Grid, float | None]] = {}
    places: dict[tuple[str, int], tuple[int, int]] = {}
    ends: dict[str, int] = {}
    for r in sorted(lines.mapInArrow(count, "path string, start long, n long, head string").collect(), key=lambda r: (r["path"], r["start"])):
        name = r["path"]
        if name not in grids:
            g, nodata, at = ascii_header(r["head"])
            grids[name], ends[name] = (g, nodata), -len(r["head"][:at].split())
        places[name, r["start"]] = ends[name], r["n"]
        ends[name] += r["n"]
    for name, (g, _) in grids.items():
        if ends[name] != g.width * g.height:
            raise tiff.NotARaster(f"{name} has {ends[name]} values, not {g.width * g.height}")

    def pieces(texts: list[str]) -> Iterator[list[str]]:
        """The words of lines, of about a megabyte of lines at a time."""
        begin = size = 0
        for i, x in enumerate(texts, 1):
            size += len(x)
            if size > 1 << 20 or i == len(texts):
                yield " ".join(texts[begin:i]).split()
                begin, size = i, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], int] = {}
        for part, texts in parts(batches):
            (g, nodata), (first, n) = grids[part[0]], places[part]
            for words in pieces(texts):
                at = first + seen.get(part, 0)
                seen[part] = seen.get(part, 0) + len(words)
                words, at = words[max(0, -at) :], max(0, at)
                for i in range(0, len(words), 1 << 16):
                    values = np.array(words[i : i + (1 << 16)], "f8")
                    row, col = np.divmod(np.arange(at + i, at + i + len(values)), g.width)
                    name = pa.array([part[0]]).take(pa.array(np.zeros(len(values), "i4")))
                    yield pa.RecordBatch.from_arrays([name, pa.array(row.astype("i4")), pa.array(col.astype("i4")), pa.array(values, mask=values == nodata if nodata is not None else None)], names=["path", "row", "col", "b1"])
        for part, n in seen.items():
            if n != places[part][1]:
                raise tiff.NotARaster(f"{part[0]} changed while it was read")

    return lines.mapInArrow(run, "path string, row int, col int, b1 double")


def write_ascii(pixels: DataFrame, path: str, grid: Grid, band: str, nodata: float) -> None:
    """One ASCII grid; null and missing pixels are nodata.

    The tasks write the values as text, each a run of rows, into the shared folder; the
    driver puts the runs in the file one after the other, at the places that their
    lengths tell.
    """
    spark = pixels.sparkSession
    per = max(1, (1 << 16) // grid.width)
    rows = pixels.select(F.col("row").cast("int"), F.col("col").cast("int"), F.coalesce(F.col(band).cast("double"), F.lit(float(nodata))).alias("v"))
    whole = f"row >= 0 and row < {grid.height} and col >= 0 and col < {grid.width}"

    def encode(key: tuple, cells: pa.Table) -> pa.Table:
        run = key[0].as_py()
        a = np.full((min(per, grid.height - run * per), grid.width), float(nodata))
        cells = cells.filter(cells.column("v").is_valid())
        a[cells.column("row").to_numpy() - run * per, cells.column("col").to_numpy()] = cells.column("v").to_numpy()
        text = "".join(" ".join(map(repr, line)) + "\n" for line in a.tolist()).encode()
        return pa.table({"run": pa.array([run], pa.int32()), "n": pa.array([len(text)], pa.int64()), "text": pa.array([text], pa.binary())})

    runs = -(-grid.height // per)
    # a run without any pixel is written as well
    every = spark.range(runs).select((F.col("id") * per).cast("int").alias("row"), F.lit(0).alias("col"), F.lit(None).cast("double").alias("v"))
    cells = rows.where(whole).unionByName(every).select("*", F.floor(F.col("row") / per).cast("int").alias("run"))
    encoded = cells.groupBy("run").applyInArrow(encode, "run int, n long, text binary")
    partial = f"{path}.partial"
    try:
        with stored(encoded, 8) as table, open(partial, "wb") as file:
            sizes = dict(table.select("run", "n").toLocalIterator())
            file.write(f"ncols {grid.width}\nnrows {grid.height}\nxllcorner {grid.x}\nyllcorner {grid.y + grid.height * grid.dy}\ncellsize {grid.dx}\nNODATA_value {nodata:g}\n".encode())
            begins = np.cumsum([file.tell(), *(sizes[i] for i in range(runs))])
            for r in table.select("run", "text").toLocalIterator():
                file.seek(int(begins[r["run"]]))
                file.write(r["text"])
        os.replace(partial, path)
    finally:
        if os.path.exists(partial):
            os.unlink(partial)


# ---------------------------------------------------------------- virtual mosaics


def vrt_header(text: str, folder: str = "") -> tuple[tiff.Header, list[list[dict]]]:
    """The header, and for each band its sources: file, band, and the windows (col, row, width, height) in it and in the mosaic."""
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError as e:
        raise tiff.NotARaster(f"no virtual raster: {e}") from None
    if root.tag != "VRTDataset":
        raise tiff.NotARaster(f"no virtual raster: {root.tag}")
    bands = []
    kinds = {"Byte": "uint8", "Int8": "int8", "UInt16": "uint16", "Int16": "int16", "UInt32": "uint32", "Int32": "int32", "Float32": "float32", "Float64": "float64"}
    dtype, nodata = "uint8", None
    width, height = int(root.get("rasterXSize")), int(root.get("rasterYSize"))
    for band in root.findall("VRTRasterBand"):
        dtype = kinds[band.get("dataType", "Byte")]
        nodata = float(band.findtext("NoDataValue")) if band.findtext("NoDataValue") else nodata
        sources = []
        for s in band:
            if s.tag not in ("SimpleSource", "ComplexSource"):
                continue
            name = s.find("SourceFilename")
            window = lambda tag: tuple(float(s.find(tag).get(k)) for k in ("xOff", "yOff", "xSize", "ySize")) if s.find(tag) is not None else (0.0, 0.0, float(width), float(height))  # noqa: B023, E731
            if window("SrcRect")[2:] != window("DstRect")[2:]:
                raise tiff.NotARaster("a virtual raster that scales its sources is not supported")
            sources.append({"file": os.path.join(folder, name.text) if name.get("relativeToVRT") == "1" else name.text, "band": int(s.findtext("SourceBand", "1").split(",")[0]), "from": window("SrcRect"), "to": window("DstRect")})
        bands.append(sources)
    t = [float(v) for v in (root.findtext("GeoTransform") or "").split(",") if v.strip()]
    code = re.search(r'(?:EPSG:|AUTHORITY\["EPSG","|ID\["EPSG",)(\d+)"?\]?\]*\s*$', root.findtext("SRS") or "")
    header = tiff.Header(width, height, dtype, len(bands), transform=(t[1], t[2], t[0], t[4], t[5], t[3]) if len(t) == 6 else None, crs=f"EPSG:{code[1]}" if code else None, nodata=nodata)
    return header, bands


def read_vrt(spark: SparkSession, path: str) -> DataFrame:
    """row, col, b1, ... of a mosaic: an equi-join of its bands; of sources that overlap the last one counts. Pixels without a source are nodata or 0."""
    with open(path, encoding="utf-8") as file:
        header, bands = vrt_header(file.read(), os.path.dirname(path))
    out = spark.range(header.width * header.height).select((F.col("id") / header.width).cast("int").alias("row"), (F.col("id") % header.width).cast("int").alias("col"))
    fill = F.lit(header.nodata or 0).cast(geotiff.spark_type(header.dtype))
    for i, sources in enumerate(bands, 1):
        placed = None
        for k, s in enumerate(sources):
            (x, y, w, h), (dx, dy, *_) = s["from"], s["to"]
            cells = geotiff.read_local(spark, s["file"]).where(f"row >= {int(y)} and row < {int(y + h)} and col >= {int(x)} and col < {int(x + w)}")
            one = cells.select((F.col("row") + int(dy - y)).alias("row"), (F.col("col") + int(dx - x)).alias("col"), F.struct(F.lit(k).alias("k"), F.col(f"b{s['band']}").alias("v")).alias("top"))
            placed = one if placed is None else placed.unionByName(one)
        if placed is None:
            out = out.withColumn(f"b{i}", fill)
            continue
        top = placed.groupBy("row", "col").agg(F.max("top").alias("top")).select("row", "col", F.col("top.v").alias(f"b{i}"))
        out = out.join(top, ["row", "col"], "left").withColumn(f"b{i}", F.coalesce(F.col(f"b{i}").cast(geotiff.spark_type(header.dtype)), fill))
    return out
