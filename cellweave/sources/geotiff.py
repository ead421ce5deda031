"""GeoTIFF as a Spark source and sink.

`format("geotiff")` reads files that executors can open, block by block: a partition
is a run of blocks, and filters on row and col skip the blocks they exclude.
`read_files` takes any store that Spark reads, a file to a task. The sink compresses
tiles on the executors, all tasks at once, and streams them into one file.
"""

from __future__ import annotations

import glob
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from cellweave.operators.geometric import Grid
from cellweave.sources import tiff
from cellweave.sources.listing import empty_files
from cellweave.sources.tables import stored

#: Blocks of one partition, and pixels up to which small blocks make it more.
BLOCKS, PIXELS = 16, 1 << 18


def spark_type(dtype: str) -> T.DataType:
    kind, size = np.dtype(dtype).kind, np.dtype(dtype).itemsize
    if kind == "f":
        return T.FloatType() if size == 4 else T.DoubleType()
    return T.LongType() if size > 4 or kind == "u" and size == 4 else T.IntegerType()


def raster_schema(header: tiff.Header) -> T.StructType:
    """path, row, col, b1, b2, ..."""
    bands = [T.StructField(f"b{i + 1}", spark_type(header.dtype)) for i in range(header.count)]
    return T.StructType([T.StructField("path", T.StringType()), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), *bands])


def _paths(path: str) -> list[str]:
    path = re.sub("^file:(//)?", "", path)
    found = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
    return [f for p in found for f in (sorted(glob.glob(os.path.join(p, "*.tif*"))) if os.path.isdir(p) else [p])]


def block_batch(path: str, header: tiff.Header, index: int, bands: np.ndarray) -> pa.RecordBatch:
    """A block's pixels, row by row."""
    r, c = divmod(index, header.blocks[1])
    _, rows, cols = bands.shape
    row = np.repeat(np.arange(rows, dtype="i4") + r * header.block[0], cols)
    col = np.tile(np.arange(cols, dtype="i4") + c * header.block[1], rows)
    kind = {T.FloatType: pa.float32(), T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.IntegerType: pa.int32()}[type(spark_type(header.dtype))]
    arrays = [pa.array([path]).take(pa.array(np.zeros(len(row), "i4"))), pa.array(row), pa.array(col), *(pa.array(b.ravel().astype(kind.to_pandas_dtype())) for b in bands)]
    return pa.RecordBatch.from_arrays(arrays, names=["path", "row", "col", *(f"b{i + 1}" for i in range(len(bands)))])


def whole_block(read: tiff.Reader, header: tiff.Header, index: int) -> np.ndarray:
    """All bands of a block."""
    if header.planar == 1:
        return tiff.read_block(read, header, index)
    down, across = header.blocks
    return np.concatenate([tiff.read_block(read, header, index + b * down * across) for b in range(header.count)])


class Run(InputPartition):
    def __init__(self, path: str, blocks: list[int]):
        self.path, self.blocks = path, blocks


class GeoTiffReader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths
        self.low = {"row": 0, "col": 0}
        self.high = {"row": 1 << 62, "col": 1 << 62}

    def pushFilters(self, filters: list[Filter]):
        """Narrows the blocks; Spark still applies all filters to the rows."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in self.low:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high[name] = min(self.high[name], f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        runs = []
        for path in self.paths:
            h = tiff.read_header(tiff.file_reader(path))
            down, across = h.blocks
            rows = range(max(0, self.low["row"] // h.block[0]), min(down, self.high["row"] // h.block[0] + 1))
            cols = range(max(0, self.low["col"] // h.block[1]), min(across, self.high["col"] // h.block[1] + 1))
            wanted = [r * across + c for r in rows for c in cols]
            n = max(BLOCKS, PIXELS // (h.block[0] * h.block[1]))
            runs += [Run(path, wanted[i : i + n]) for i in range(0, len(wanted), n)]
        return runs or [Run("", [])]

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if partition.blocks:
            read = tiff.file_reader(partition.path)
            header = tiff.read_header(read)
            for index in partition.blocks:
                yield block_batch(partition.path, header, index, whole_block(read, header, index))


class GeoTiffSource(DataSource):
    """Options: path (a file, a folder or a pattern)."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _files(self) -> list[str]:
        found = _paths(self.options["path"])
        if not found or not all(map(os.path.exists, found)):
            raise FileNotFoundError(self.options["path"])
        return found

    def schema(self) -> T.StructType:
        return raster_schema(tiff.read_header(tiff.file_reader(self._files()[0])))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return GeoTiffReader(self._files())


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GeoTiffSource)


def read_local(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, b1, ... of files that executors can open."""
    register(spark)
    return spark.read.format("geotiff").load(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """The same of any store that Spark reads; a file of up to 2 GB is read by one task, in blocks."""
    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").limit(1).collect()
    if not first:
        raise FileNotFoundError(path)
    schema = raster_schema(tiff.read_header(tiff.bytes_reader(bytes(first[0][0]))))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                read = tiff.bytes_reader(content.as_py())
                header = tiff.read_header(read)
                for index in range(header.blocks[0] * header.blocks[1]):
                    yield block_batch(name, header, index, whole_block(read, header, index))

    return files.select("path", "content").mapInArrow(decode, schema)


METADATA = "path string, size_bytes long, driver string, dtype string, count int, crs string, transform array<double>, res array<double>, width int, height int, nodata double, tags map<string,string>, raster_error string"


def ranges(path: str) -> tiff.Reader:
    """Reads parts of a file of any store that Arrow opens: local, S3, HDFS, GCS."""
    from pyarrow import fs

    if path.startswith(("/", "file:")):
        return tiff.file_reader(re.sub("^file:(//)?", "", path))
    store, name = fs.FileSystem.from_uri(path)

    def read(at: int, n: int) -> bytes:
        with store.open_input_file(name) as file:
            return file.read_at(min(n, max(0, file.size() - at)), at)

    return read


def described(name: str, read: tiff.Reader) -> tuple[str, tiff.Header]:
    """The driver's name and the header of a raster file, by its suffix."""
    from cellweave.sources import grids

    suffix = name.rpartition(".")[2].lower()
    if suffix == "asc":
        g, nodata, _ = grids.ascii_header(read(0, 4096).decode("ascii", "replace"))
        return "AAIGrid", tiff.Header(g.width, g.height, "float64", transform=(g.dx, 0.0, g.x, 0.0, g.dy, g.y), nodata=nodata)
    if suffix == "vrt":
        return "VRT", grids.vrt_header(read(0, 1 << 26).decode("utf-8", "replace"))[0]
    return "GTiff", tiff.read_header(read)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: what its header says, or why it can't be read. Spark lists the files; of each only its header is read."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, size in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                row = dict.fromkeys(x.split(" ")[0] for x in METADATA.split(", ")) | {"path": name, "size_bytes": size}
                try:
                    driver, h = described(name, ranges(name))
                    row |= {"driver": driver, "dtype": h.dtype, "count": h.count, "crs": h.crs, "transform": list(h.transform) if h.transform else None, "res": list(h.resolution) if h.resolution else None, "width": h.width, "height": h.height, "nodata": h.nodata, "tags": list(h.tags.items())}
                except Exception as e:  # the reason is the result
                    row["raster_error"] = str(e)
                rows.append(row)
            fields = [("path", pa.string()), ("size_bytes", pa.int64()), ("driver", pa.string()), ("dtype", pa.string()), ("count", pa.int32()), ("crs", pa.string()), ("transform", pa.list_(pa.float64())), ("res", pa.list_(pa.float64())), ("width", pa.int32()), ("height", pa.int32()), ("nodata", pa.float64()), ("tags", pa.map_(pa.string(), pa.string())), ("raster_error", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    # without its content column the source reads no file
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    if empty := empty_files(spark, path):
        files = files.unionByName(spark.createDataFrame([(x, 0) for x, *_ in empty], "path string, length long"))
    return files.mapInArrow(describe, METADATA)


def grid_of(header: tiff.Header) -> Grid:
    dx, _, x, _, dy, y = header.transform or (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    return Grid(x, y, dx, dy, header.width, header.height, header.crs or "")


def write_raster(pixels: DataFrame, path: str, header: tiff.Header, bands: Sequence[str], sparse: float | None = None) -> None:
    """One tiled file. Missing pixels are nodata or 0; tiles of which all values are `sparse` aren't stored."""
    h = header
    th, tw = h.block
    across = h.blocks[1]
    fill = h.nodata or 0

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_tile: list = [None, None]

        def done() -> Iterator[pa.RecordBatch]:
            index, a = open_tile
            if a is not None and not (sparse is not None and (a == sparse).all()):
                yield pa.RecordBatch.from_arrays([pa.array([index], pa.int64()), pa.array([tiff.encode_block(a, h)], pa.binary())], names=["tile", "data"])

        for b in batches:
            if not b.num_rows:
                continue
            tile, row, col = (b.column(i).to_numpy() for i in range(3))
            values = [b.column(3 + i).to_numpy(zero_copy_only=False) for i in range(len(bands))]
            cuts = np.concatenate(([0], np.flatnonzero(tile[1:] != tile[:-1]) + 1, [len(tile)]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if open_tile[0] != tile[i]:
                    yield from done()
                    open_tile[:] = [int(tile[i]), np.full((th, tw, len(bands)), fill, h.dtype)]
                for k, v in enumerate(values):
                    open_tile[1][row[i:j] % th, col[i:j] % tw, k] = np.where(v[i:j] == v[i:j], v[i:j], fill)
        yield from done()

    spark = pixels.sparkSession
    tile = F.expr(f"cast(row div {th} as bigint) * {across} + cast(col div {tw} as bigint)")
    placed = pixels.select(tile.alias("tile"), F.col("row").cast("int"), F.col("col").cast("int"), *bands)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = placed.repartition(n, "tile").sortWithinPartitions("tile").mapInArrow(encode, "tile long, data binary")
    temporary = f"{path}.partial"
    try:
        with stored(encoded) as table, open(temporary, "wb") as file:
            tiff.write(file, h, ((r["tile"], bytes(r["data"])) for r in table.toLocalIterator()))
        os.replace(temporary, path)
    finally:
        if os.path.exists(temporary):
            os.unlink(temporary)


def write_tiles(pixels: DataFrame, folder: str, header: tiff.Header, bands: Sequence[str], blocks: int = 16, sparse: float | None = None) -> None:
    """A folder of GeoTIFF files ROW_COL.tif, each of `blocks` by `blocks` blocks of the raster with its own place.

    Every task writes its own files, where all executors see the folder; a file is
    renamed when it is whole, so that a repeated task replaces it. Files of which all
    values are `sparse` aren't written.
    """
    h = header
    down, across = h.block[0] * blocks, h.block[1] * blocks
    fill = h.nodata or 0
    dx, _, x, _, dy, y = h.transform or (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    os.makedirs(folder, exist_ok=True)

    def save(r: int, c: int, a: np.ndarray) -> str:
        own = replace(h, width=a.shape[1], height=a.shape[0], transform=(dx, 0.0, x + c * across * dx, 0.0, dy, y + r * down * dy), offsets=[], sizes=[])
        path = f"{folder}/{r}_{c}.tif"

        def encoded() -> Iterator[tuple[int, bytes]]:
            for i in range(own.blocks[0] * own.blocks[1]):
                row, col = (k * size for k, size in zip(divmod(i, own.blocks[1]), h.block, strict=True))
                part = a[row : row + h.block[0], col : col + h.block[1]]
                whole = np.full((*h.block, len(bands)), fill, h.dtype)
                whole[: part.shape[0], : part.shape[1]] = part
                yield i, tiff.encode_block(whole, own)

        partial = f"{path}.{uuid.uuid4().hex}"
        with open(partial, "wb") as file:
            tiff.write(file, own, encoded())
        os.replace(partial, path)
        return path

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, a = None, None
        written = []

        def done() -> None:
            if a is not None and not (sparse is not None and (a == sparse).all()):
                written.append(save(*at, a))

        for b in batches:
            if not b.num_rows:
                continue
            r, c, row, col = (b.column(i).to_numpy() for i in range(4))
            values = [b.column(4 + i).to_numpy(zero_copy_only=False) for i in range(len(bands))]
            cuts = np.concatenate(([0], np.flatnonzero((r[1:] != r[:-1]) | (c[1:] != c[:-1])) + 1, [len(r)]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if at != (int(r[i]), int(c[i])):
                    done()
                    at = int(r[i]), int(c[i])
                    a = np.full((min(down, h.height - at[0] * down), min(across, h.width - at[1] * across), len(bands)), fill, h.dtype)
                for k, v in enumerate(values):
                    a[row[i:j] - at[0] * down, col[i:j] - at[1] * across, k] = np.where(v[i:j] == v[i:j], v[i:j], fill)
        done()
        yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], names=["path"])

    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = [F.expr(f"cast(row div {down} as int)").alias("r"), F.expr(f"cast(col div {across} as int)").alias("c")]
    placed = pixels.select(*place, F.col("row").cast("int"), F.col("col").cast("int"), *bands).repartition(n, "r", "c").sortWithinPartitions("r", "c")
    placed.mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()


def read_tiles(spark: SparkSession, folder: str, header: tiff.Header) -> DataFrame:
    """row, col, b1, ... of the raster that `write_tiles` wrote; the files' names tell where each begins."""
    dx, _, x, _, dy, y = header.transform or (1.0, 0.0, 0.0, 0.0, -1.0, 0.0)
    cells = read_local(spark, folder)
    known = {}
    for path in _paths(folder):
        t = tiff.read_header(tiff.file_reader(path)).transform
        known[path] = (round((t[5] - y) / dy), round((t[2] - x) / dx)) if t else (0, 0)
    starts = spark.createDataFrame([(p, *at) for p, at in known.items()], "path string, __r int, __c int")  # a row for each file
    moved = cells.join(F.broadcast(starts), "path").withColumns({"row": F.col("row") + F.col("__r"), "col": F.col("col") + F.col("__c")})
    return moved.drop("path", "__r", "__c")


def retag(path: str, tags: dict[str, str]) -> None:
    """The file with metadata tags set."""
    read = tiff.file_reader(path)
    h = tiff.read_header(read)
    if not h.tiled or h.planar != 1:
        raise tiff.NotARaster("tags can be set in tiled, chunky files only")
    stored = [(i, read(h.offsets[i], h.sizes[i])) for i in range(len(h.sizes)) if h.sizes[i]]
    if h.order != "<":
        raise tiff.NotARaster("tags can be set in little-endian files only")
    h.tags = h.tags | tags
    with open(f"{path}.partial", "wb") as file:
        tiff.write(file, h, stored)
    os.replace(f"{path}.partial", path)
