"""A TIFF codec on NumPy: headers, blocks and georeferencing, no more than the engine needs.

Reads classic and big TIFF of either byte order, strips and tiles, chunky and planar,
uncompressed, LZW, deflate, PackBits and Zstandard, predictors 1 to 3. Writes tiled
little-endian files (big TIFF beyond 4 GB) with the same compressions.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import BinaryIO
from xml.sax.saxutils import escape, unescape

import numpy as np

# The format's own numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR, COLORMAP = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, EXTRA_SAMPLES, SAMPLE_FORMAT = 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIE_POINT, TRANSFORM, GEO_KEYS, GEO_ASCII, METADATA, NODATA = 33550, 33922, 34264, 34735, 34737, 42112, 42113
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
COMPRESSIONS = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773, "zstd": 50000}
PHOTOMETRICS = {"miniswhite": 0, "minisblack": 1, "rgb": 2, "palette": 3}
PROJECTED, GEOGRAPHIC, MODEL, RASTER = 3072, 2048, 1024, 1025


class NotARaster(ValueError):
    pass


@dataclass
class Header:
    width: int
    height: int
    dtype: str
    count: int = 1
    compression: int = 1
    predictor: int = 1
    planar: int = 1
    photometric: int = 1
    block: tuple[int, int] = (256, 256)  # rows, columns
    tiled: bool = True
    transform: tuple[float, ...] | None = None  # dx, skew, x, skew, dy, y
    crs: str | None = None
    nodata: float | None = None
    colormap: dict[int, tuple[int, int, int]] = field(default_factory=dict)
    tags: dict[str, str] = field(default_factory=dict)
    order: str = "<"
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)

    @property
    def blocks(self) -> tuple[int, int]:
        """Rows and columns of blocks."""
        return -(-self.height // self.block[0]), -(-self.width // self.block[1])

    @property
    def resolution(self) -> tuple[float, float] | None:
        return (abs(self.transform[0]), abs(self.transform[4])) if self.transform else None


Reader = Callable[[int, int], bytes]


def bytes_reader(data: bytes) -> Reader:
    return lambda at, n: data[at : at + n]


def file_reader(path: str) -> Reader:
    def read(at: int, n: int) -> bytes:
        with open(path, "rb") as file:
            file.seek(at)
            return file.read(n)

    return read


def read_header(read: Reader) -> Header:
    """The first image's header."""
    start = read(0, 16)
    if start[:4] not in (b"II*\0", b"MM\0*", b"II+\0", b"MM\0+"):
        raise NotARaster("no TIFF")
    o = "<" if start[:2] == b"II" else ">"
    big = start[2:4] in (b"+\0", b"\0+")
    at = struct.unpack(o + ("Q" if big else "I"), start[8:16] if big else start[4:8])[0]
    head, width, word = (8, 20, "Q") if big else (2, 12, "I")
    n = struct.unpack(o + ("Q" if big else "H"), read(at, head))[0]
    table = read(at + head, n * width)
    if len(table) < n * width:
        raise NotARaster("truncated header")
    values: dict[int, tuple] = {}
    for i in range(n):
        entry = table[i * width : (i + 1) * width]
        tag, kind = struct.unpack(o + "HH", entry[:4])
        if kind not in KINDS:
            continue
        count = struct.unpack(o + word, entry[4 : 4 + len(word) * (8 if big else 4)])[0]
        code = KINDS[kind]
        size = count * struct.calcsize("<" + code)
        inline = entry[12:] if big else entry[8:]
        raw = inline[:size] if size <= len(inline) else read(struct.unpack(o + word, inline)[0], size)
        values[tag] = (raw,) if code == "s" else struct.unpack(f"{o}{count * len(code)}{code[0]}", raw)
    if WIDTH not in values or HEIGHT not in values:
        raise NotARaster("no image size")
    w, h = values[WIDTH][0], values[HEIGHT][0]
    samples = values.get(SAMPLES, (1,))[0]
    bits, form = values.get(BITS, (1,))[0], values.get(SAMPLE_FORMAT, (1,))[0]
    name = {1: "uint", 2: "int", 3: "float"}.get(form, "uint") + str(bits)
    if bits not in (8, 16, 32, 64):
        raise NotARaster(f"{bits} bits a sample are not supported")
    tiled = TILE_OFFSETS in values
    block = (values[TILE_HEIGHT][0], values[TILE_WIDTH][0]) if tiled else (min(h, values.get(ROWS_PER_STRIP, (h,))[0]), w)
    out = Header(w, h, name, samples, values.get(COMPRESSION, (1,))[0], values.get(PREDICTOR, (1,))[0], values.get(PLANAR, (1,))[0], values.get(PHOTOMETRIC, (1,))[0], block, tiled, order=o)
    out.offsets = list(values.get(TILE_OFFSETS if tiled else STRIP_OFFSETS, ()))
    out.sizes = list(values.get(TILE_COUNTS if tiled else STRIP_COUNTS, ()))
    if PIXEL_SCALE in values and TIE_POINT in values:
        (sx, sy), (px, py, _, x, y) = values[PIXEL_SCALE][:2], values[TIE_POINT][:5]
        out.transform = (sx, 0.0, x - px * sx, 0.0, -sy, y + py * sy)
    elif TRANSFORM in values:
        m = values[TRANSFORM]
        out.transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    keys = values.get(GEO_KEYS, ())
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = found.get(PROJECTED, found.get(GEOGRAPHIC))
    out.crs = f"EPSG:{code}" if code and code != 32767 else None
    text = lambda tag: values[tag][0].rstrip(b"\0").decode("utf-8", "replace") if tag in values else ""
    out.nodata = float(text(NODATA)) if text(NODATA).strip() else None
    out.tags = {unescape(k): unescape(v) for k, v in re.findall(r'<Item name="([^"]*)"[^>]*>(.*?)</Item>', text(METADATA), re.S)}
    if COLORMAP in values:
        c = np.array(values[COLORMAP]).reshape(3, -1) >> 8
        out.colormap = {i: tuple(int(x) for x in c[:, i]) for i in range(c.shape[1])}
    return out


# ---------------------------------------------------------------- blocks


def _unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def _unpack_lzw(data: bytes) -> bytes:
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    known, out, last = list(first), bytearray(), b""
    bits = held = 0
    size = 9
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < size:
            continue
        bits -= size
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            known, size, last = list(first), 9, b""
            continue
        word = known[code] if code < len(known) else last + last[:1]
        out += word
        if last:
            known.append(last + word[:1])
        last = word
        size = 9 if len(known) < 511 else 10 if len(known) < 1023 else 11 if len(known) < 2047 else 12
    return bytes(out)


def _pack_bits(data: bytes) -> bytes:
    """Runs of two bytes or more as a count and the byte, the rest as literal stretches of up to 128 bytes."""
    a = np.frombuffer(data, "u1")
    out = bytearray()
    if not len(a):
        return b""
    begins = np.flatnonzero(np.append(True, a[1:] != a[:-1])).tolist()
    literal = bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    for begin, end in zip(begins, [*begins[1:], len(a)], strict=True):
        n = end - begin
        if n < 3:
            literal.extend(data[begin:end])
            continue
        flush()
        while n > 1:
            step = min(n, 128)
            out += bytes((257 - step, data[begin]))
            n -= step
        if n:
            literal.append(data[begin])
    flush()
    return bytes(out)


def _pack_lzw(data: bytes) -> bytes:
    """Codes from the highest bit on, a new table before it would overflow."""
    out, held, bits = bytearray(), 0, 0

    def put(code: int, size: int) -> None:
        nonlocal held, bits
        held, bits = held << size | code, bits + size
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    known = {bytes([i]): i for i in range(256)}
    count, word = 258, b""
    width = lambda: 9 if count < 512 else 10 if count < 1024 else 11 if count < 2048 else 12
    put(256, 9)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in known:
            word = longer
            continue
        put(known[word], width())
        known[longer] = count
        count += 1
        if count == 4094:
            put(256, 12)
            known = {bytes([i]): i for i in range(256)}
            count = 258
        word = data[i : i + 1]
    if word:
        put(known[word], width())
        count += 1
    put(257, width())
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _decompress(kind: int, data: bytes, size: int) -> bytes:
    if kind == 1:
        return data
    if kind in (8, 32946):
        return zlib.decompress(data)
    if kind == 5:
        return _unpack_lzw(data)
    if kind == 32773:
        return _unpack_bits(data)
    if kind == 50000:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data, max_output_size=size)
    raise NotARaster(f"compression {kind} is not supported")


def read_block(read: Reader, header: Header, index: int) -> np.ndarray:
    """One block as (bands in it, rows, columns), cut to the image; a sparse block is nodata or 0."""
    h = header
    down, across = h.blocks
    place = index % (down * across)
    r, c = divmod(place, across)
    rows, cols = min(h.block[0], h.height - r * h.block[0]), min(h.block[1], h.width - c * h.block[1])
    bands = h.count if h.planar == 1 else 1
    if not h.sizes[index]:
        return np.full((bands, rows, cols), h.nodata or 0, h.dtype)
    dtype = np.dtype(h.dtype).newbyteorder(h.order)
    stored = h.block[0] if h.tiled else rows
    shape = (stored, h.block[1], bands)
    size = int(np.prod(shape)) * dtype.itemsize
    raw = _decompress(h.compression, read(h.offsets[index], h.sizes[index]), size)
    if h.predictor == 3:
        bytewise = np.frombuffer(raw, "u1", size).reshape(stored, -1)
        summed = np.cumsum(bytewise.reshape(stored, -1, bands), axis=1, dtype="u1").reshape(stored, dtype.itemsize, -1)
        a = np.ascontiguousarray(summed.transpose(0, 2, 1)).view(np.dtype(h.dtype).newbyteorder(">")).reshape(shape)
    else:
        a = np.frombuffer(raw, dtype, int(np.prod(shape))).reshape(shape)
        if h.predictor == 2:
            a = np.cumsum(a.astype(np.dtype(h.dtype)), axis=1, dtype=h.dtype)
    return a[:rows, :cols].transpose(2, 0, 1).astype(h.dtype)


def encode_block(a: np.ndarray, header: Header) -> bytes:
    """One whole block, (rows, columns, bands in it)."""
    data = np.ascontiguousarray(a, np.dtype(header.dtype).newbyteorder("<"))
    if header.predictor == 2:
        data = data.copy()
        data[:, 1:] -= data[:, :-1].copy()
    elif header.predictor == 3:
        rows, _, bands = data.shape
        planes = np.ascontiguousarray(data.astype(data.dtype.newbyteorder(">"))).view("u1").reshape(rows, -1, data.dtype.itemsize).transpose(0, 2, 1).reshape(rows, -1, bands).copy()
        planes[:, 1:] -= planes[:, :-1].copy()
        data = planes
    raw = data.tobytes()
    if header.compression == 1:
        return raw
    if header.compression == 8:
        return zlib.compress(raw, 6)
    if header.compression == 5:
        return _pack_lzw(raw)
    if header.compression == 32773:
        return b"".join(_pack_bits(raw[i : i + len(raw) // len(data)]) for i in range(0, len(raw), len(raw) // len(data)))
    if header.compression == 50000:
        import zstandard

        return zstandard.ZstdCompressor().compress(raw)
    raise ValueError(f"can't write compression {header.compression}")


def _packed(tag: int, values: object) -> tuple[int, int, int, bytes]:
    if isinstance(values, bytes):
        return tag, 2, len(values) + 1, values + b"\0"
    kind, items = values  # type: ignore[misc]
    return tag, kind, len(items), struct.pack(f"<{len(items)}{KINDS[kind]}", *items)


def write(out: BinaryIO, header: Header, blocks: Iterable[tuple[int, bytes]]) -> None:
    """A tiled file of compressed blocks (index, data) in any order; blocks that don't come are sparse."""
    h = header
    down, across = h.blocks
    n = down * across
    most = h.width * h.height * h.count * np.dtype(h.dtype).itemsize
    big = most > 3_500_000_000
    out.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 0) if big else struct.pack("<2sHI", b"II", 42, 0))
    offsets, sizes = [0] * n, [0] * n
    at = 16 if big else 8
    for index, data in blocks:
        out.write(data)
        offsets[index], sizes[index] = at, len(data)
        at += len(data)
    bits, form = np.dtype(h.dtype).itemsize * 8, {"u": 1, "i": 2, "f": 3}[np.dtype(h.dtype).kind]
    place = (16, "Q") if big else (4, "I")
    values: dict[int, object] = {
        WIDTH: (4, [h.width]), HEIGHT: (4, [h.height]), BITS: (3, [bits] * h.count), COMPRESSION: (3, [h.compression]), PHOTOMETRIC: (3, [h.photometric]), SAMPLES: (3, [h.count]), PLANAR: (3, [1]),
        PREDICTOR: (3, [h.predictor]), TILE_WIDTH: (4, [h.block[1]]), TILE_HEIGHT: (4, [h.block[0]]), TILE_OFFSETS: (place[0], offsets), TILE_COUNTS: (4, sizes), SAMPLE_FORMAT: (3, [form] * h.count),
    }
    extra = h.count - (3 if h.photometric == 2 else 1)
    if extra > 0:
        values[EXTRA_SAMPLES] = (3, [2] * extra)
    if h.transform:
        dx, _, x, _, dy, y = h.transform
        values |= {PIXEL_SCALE: (12, [dx, -dy, 0.0]), TIE_POINT: (12, [0.0, 0.0, 0.0, x, y, 0.0])}
    if h.crs and (m := re.fullmatch(r"EPSG:(\d+)", h.crs)):
        code = int(m[1])
        geographic = 4000 <= code < 5000
        keys = [(MODEL, 2 if geographic else 1), (RASTER, 1), (GEOGRAPHIC if geographic else PROJECTED, code)]
        values[GEO_KEYS] = (3, [1, 1, 0, len(keys), *(x for k, v in keys for x in (k, 0, 1, v))])
    if h.nodata is not None:
        values[NODATA] = f"{h.nodata:g}".encode()
    if h.tags:
        quoted = {'"': "&quot;"}
        values[METADATA] = ("<GDALMetadata>\n" + "".join(f'  <Item name="{escape(k, quoted)}">{escape(v)}</Item>\n' for k, v in sorted(h.tags.items())) + "</GDALMetadata>\n").encode()
    if h.colormap:
        c = np.zeros((3, 256), int)
        for k, v in h.colormap.items():
            c[:, k] = [x * 257 for x in v]
        values[COLORMAP] = (3, c.ravel().tolist())
    entries = [_packed(tag, values[tag]) for tag in sorted(values)]
    if at % 2:
        out.write(b"\0")
        at += 1
    head, width, word, room = (8, 20, "Q", 8) if big else (2, 12, "I", 4)
    tail = at + head + len(entries) * width + room
    table, rest = struct.pack("<Q" if big else "<H", len(entries)), b""
    for tag, kind, count, raw in entries:
        if len(raw) <= room:
            value = raw.ljust(room, b"\0")
        else:
            value = struct.pack("<" + word, tail + len(rest))
            rest += raw + b"\0" * (len(raw) % 2)
        table += struct.pack("<HH" + word, tag, kind, count) + value
    out.write(table + b"\0" * room + rest)
    out.seek(8 if big else 4)
    out.write(struct.pack("<" + word, at))
