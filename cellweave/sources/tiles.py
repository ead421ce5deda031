"""MBTiles and PMTiles containers of PNG tiles."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import sqlite3
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cellweave.sources.tables import stored


def png(a: np.ndarray) -> bytes:
    """(rows, columns, bands) of bytes; 1 to 4 bands are grey, grey with alpha, RGB, RGBA."""
    rows, cols, bands = a.shape
    raw = np.concatenate([np.zeros((rows, 1), "u1"), a.reshape(rows, -1)], axis=1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", cols, rows, 8, {1: 0, 2: 4, 3: 2, 4: 6}[bands], 0, 0, 0)) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def unpng(data: bytes) -> np.ndarray:
    """What png() packed: (rows, columns, bands)."""
    cols, rows, depth, kind = struct.unpack(">IIBB", data[16:26])
    bands, at, packed = {0: 1, 4: 2, 2: 3, 6: 4}.get(kind, 0), 8, b""
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    lines = np.frombuffer(zlib.decompress(packed), "u1").reshape(rows, -1) if bands and depth == 8 else np.ones((1, 1), "u1")
    if lines[:, 0].any():
        raise ValueError("only unfiltered tiles of bytes can be read")
    return lines[:, 1:].reshape(rows, cols, bands)


def encode_tiles(pixels: DataFrame, bands: Sequence[str], tile: int = 256) -> DataFrame:
    """zoom, tile_column, tile_row, data of a tile pyramid; pixels that are missing are transparent if the last of 2 or 4 bands is alpha, else black."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, a = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if key is not None:
                yield pa.RecordBatch.from_pylist([{"zoom": key[0], "tile_column": key[1], "tile_row": key[2], "data": png(a)}], schema=pa.schema([("zoom", pa.int32()), ("tile_column", pa.int32()), ("tile_row", pa.int32()), ("data", pa.binary())]))

        for b in batches:
            if not b.num_rows:
                continue
            z, x, y, row, col, *values = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5 + len(bands)))
            cuts = np.concatenate(([0], np.flatnonzero((z[1:] != z[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1, [len(z)]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                here = int(z[i]), int(x[i]), int(y[i])
                if here != key:
                    yield from done()
                    key, a = here, np.zeros((tile, tile, len(bands)), "u1")
                for k, v in enumerate(values):
                    a[row[i:j], col[i:j], k] = v[i:j]
        yield from done()

    place = ["zoom", "tile_column", "tile_row"]
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pixels.select(*place, "row", "col", *bands).repartition(n, *place).sortWithinPartitions(*place).mapInArrow(run, "zoom int, tile_column int, tile_row int, data binary")


def write_mbtiles(tiles: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """A new MBTiles file; rows are counted from the south, as the format wants."""
    temporary = f"{path}.partial"
    if os.path.exists(temporary):
        os.unlink(temporary)
    db = sqlite3.connect(temporary)
    try:
        db.executescript("CREATE TABLE metadata (name TEXT, value TEXT); CREATE TABLE tiles (zoom_level INTEGER, tile_column INTEGER, tile_row INTEGER, tile_data BLOB); CREATE UNIQUE INDEX tile_index ON tiles (zoom_level, tile_column, tile_row);")
        with stored(tiles) as table:
            db.executemany("INSERT INTO tiles VALUES (?, ?, ?, ?)", ((r["zoom"], r["tile_column"], (1 << r["zoom"]) - 1 - r["tile_row"], bytes(r["data"])) for r in table.toLocalIterator()))
        low, high = db.execute("SELECT min(zoom_level), max(zoom_level) FROM tiles").fetchone()
        patch_metadata(db, {"format": "png", "minzoom": str(low or 0), "maxzoom": str(high or 0)} | metadata)
        db.commit()
    finally:
        db.close()
    os.replace(temporary, path)


def read_mbtiles(spark: SparkSession, path: str) -> DataFrame:
    """zoom, tile_column, tile_row (from the north), data. A task reads the tiles of a range of row numbers; executors have to see the file."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    try:
        last = db.execute("SELECT max(rowid) FROM tiles").fetchone()[0] or 0
    finally:
        db.close()
    step = max(1, -(-last // spark.sparkContext.defaultParallelism))
    schema = pa.schema([("zoom", pa.int32()), ("tile_column", pa.int32()), ("tile_row", pa.int32()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in b.column(0).to_pylist():
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as own:
                    found = own.execute("SELECT zoom_level, tile_column, (1 << zoom_level) - 1 - tile_row, tile_data FROM tiles WHERE rowid BETWEEN ? AND ?", (first, first + step - 1))
                    while rows := found.fetchmany(64):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    parts = max(1, -(-last // step))
    return spark.range(1, last + 1, step, parts).mapInArrow(run, "zoom int, tile_column int, tile_row int, data binary")


def decode_tiles(tiles: DataFrame, bands: Sequence[str]) -> DataFrame:
    """zoom, tile_column, tile_row, row, col and bands of tiles that encode_tiles made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z, x, y, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = unpng(data)
                n = a.shape[0] * a.shape[1]
                row, column = np.divmod(np.arange(n, dtype="i4"), a.shape[1])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, v, "i4")) for v in (z, x, y)), pa.array(row.astype("i4")), pa.array(column.astype("i4")), *(pa.array(a[:, :, k].ravel().astype("i4")) for k in range(len(bands)))], names=["zoom", "tile_column", "tile_row", "row", "col", *bands])

    return tiles.select("zoom", "tile_column", "tile_row", "data").mapInArrow(run, "zoom int, tile_column int, tile_row int, row int, col int, " + ", ".join(f"`{b}` int" for b in bands))


def read_metadata(path: str) -> dict[str, str]:
    """The metadata table of an MBTiles file."""
    with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
        return dict(db.execute("SELECT name, value FROM metadata"))


def patch_metadata(db: sqlite3.Connection, values: dict[str, str]) -> None:
    for name, value in values.items():
        db.execute("DELETE FROM metadata WHERE name = ?", (name,))
        db.execute("INSERT INTO metadata VALUES (?, ?)", (name, value))


# ---------------------------------------------------------------- PMTiles


def hilbert_id(zoom: int, x: int, y: int) -> int:
    """A tile's number along the Hilbert curve of its zoom, after all tiles of lower zooms."""
    d, side = 0, 1 << zoom
    step = side >> 1
    while step:
        right, low = int(x & step > 0), int(y & step > 0)
        d += step * step * (3 * right ^ low)
        if not low:
            if right:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        step >>= 1
    return (4**zoom - 1) // 3 + d


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def directory(entries: Sequence[tuple[int, int, int, int]]) -> bytes:
    """Entries (tile id, offset, length, run) in order of their id."""
    parts, last = [_varint(len(entries))], 0
    for tile, *_ in entries:
        parts.append(_varint(tile - last))
        last = tile
    parts += [_varint(run) for *_, run in entries] + [_varint(length) for _, _, length, _ in entries]
    end = None
    for _, offset, length, _ in entries:
        parts.append(_varint(0 if offset == end else offset + 1))
        end = offset + length
    return gzip.compress(b"".join(parts), mtime=0)


def write_pmtiles(tiles: Iterable[tuple[int, int, int, bytes]], path: str, metadata: dict, bounds: tuple[float, float, float, float] = (-180.0, -85.05112878, 180.0, 85.05112878)) -> None:
    """A clustered archive (version 3) of tiles (zoom, column, row from the north, data); equal tiles are stored once.

    Tiles are spooled to a file beside the archive in the order they come and copied
    in the order of their ids; only ids, offsets and digests are held in memory.
    """
    with open(f"{path}.spool", "w+b") as spool:
        os.unlink(f"{path}.spool")
        placed: list[tuple[int, int, int, int]] = []  # id, zoom, place in the spool, length
        known: dict[bytes, int] = {}
        for z, x, y, data in tiles:
            digest = hashlib.sha256(data).digest()
            if digest not in known:
                known[digest] = spool.tell()
                spool.write(data)
            placed.append((hilbert_id(z, x, y), z, known[digest], len(data)))
        placed.sort()
        entries: list[tuple[int, int, int, int]] = []
        moved: dict[int, int] = {}  # place in the spool to offset in the body
        order: list[tuple[int, int]] = []
        size = 0
        for tile, _, at, length in placed:
            if at not in moved:
                moved[at] = size
                order.append((at, length))
                size += length
            offset = moved[at]
            if entries and entries[-1][1:3] == (offset, length) and entries[-1][0] + entries[-1][3] == tile:
                entries[-1] = (*entries[-1][:3], entries[-1][3] + 1)
            else:
                entries.append((tile, offset, length, 1))
        root, leaves = directory(entries), b""
        span = 4096
        while len(root) > 16257:
            parts, top, begin = [], [], 0
            for i in range(0, len(entries), span):
                leaf = directory(entries[i : i + span])
                top.append((entries[i][0], begin, len(leaf), 0))
                parts.append(leaf)
                begin += len(leaf)
            leaves, root, span = b"".join(parts), directory(top), span * 2
        about = gzip.compress(json.dumps(metadata, sort_keys=True).encode(), mtime=0)
        zooms = [z for _, z, *_ in placed] or [0]
        places, at = [], 127
        for length in (len(root), len(about), len(leaves), size):
            places += [at, length]
            at += length
        west, south, east, north = (int(v * 1e7) for v in bounds)
        head = struct.pack("<7sB11Q", b"PMTiles", 3, *places, len(placed), len(entries), len(order))
        head += struct.pack("<BBBBBB4iBii", 1, 2, 1, 2, min(zooms), max(zooms), west, south, east, north, min(zooms), (west + east) // 2, (south + north) // 2)
        with open(f"{path}.partial", "wb") as file:
            for part in (head, root, about, leaves):
                file.write(part)
            for place, length in order:
                spool.seek(place)
                file.write(spool.read(length))
        os.replace(f"{path}.partial", path)


def mbtiles_to_pmtiles(source: str, path: str) -> None:
    db = sqlite3.connect(f"file:{source}?mode=ro", uri=True)
    try:
        about = dict(db.execute("SELECT name, value FROM metadata"))
        rows = ((z, x, (1 << z) - 1 - y, data) for z, x, y, data in db.execute("SELECT zoom_level, tile_column, tile_row, tile_data FROM tiles"))
        bounds = tuple(float(v) for v in about["bounds"].split(",")) if "bounds" in about else (-180.0, -85.05112878, 180.0, 85.05112878)
        write_pmtiles(rows, path, about, bounds)
    finally:
        db.close()
