"""Neighbourhood operators: exact distances, proximity, edge feather, vignette, Gaussian blur, inpainting and filling.

The distance transform is separable: the distance to the next feature above and below in
a pixel's column, then, over the columns of its row, the least of squared column offset
plus that distance squared. Both passes run in NumPy over a band of rows. A band gets,
besides its pixels, the last feature above it and the first below it in each of its
columns; these come from window functions over one row for each band and column. So the
pixels are shuffled once, by band, and a task's share doesn't grow with the raster's
height. Over whole rows the second pass is by divide and conquer on the least column,
which is monotone: O(W log W) for a row of W pixels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.functions.expr import clip, col, smoothstep, wrap_byte

#: Stands for no feature in a column.
FAR = 1 << 30
#: Radius up to which the row pass goes over the offsets of columns.
WINDOW_RADIUS = 16
#: Rows of a band.
BAND = 64
#: Pixels that a task holds at least before it solves them.
HELD = 1 << 17


def _least_by_row(cols: np.ndarray, g2: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Of rows of pixels (rising columns; row i from begins[i] to begins[i+1]) the least (c - c')^2 + g2(c') of each pixel.

    The least column doesn't fall as c rises, so a solved pixel bounds those on both
    sides; each level solves the middles of all open stretches of all rows at once.
    """
    n = len(cols)
    best = np.zeros(n, "i8")
    out = np.zeros(n, "i8")
    low, high = begins[:-1].copy(), begins[1:] - 1  # open stretches, and the bounds of their least columns
    left, right = low.copy(), high.copy()
    keep = high >= low
    low, high, left, right = low[keep], high[keep], left[keep], right[keep]
    while len(low):
        mid = (low + high) // 2
        sizes = right - left + 1
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        source = np.arange(int(sizes.sum())) - np.repeat(starts - left, sizes)
        cost = (np.repeat(cols[mid], sizes) - cols[source]) ** 2 + g2[source]
        least = np.minimum.reduceat(cost, starts)
        first = np.flatnonzero(cost == np.repeat(least, sizes))
        owner = np.repeat(np.arange(len(mid)), sizes)[first]
        _, at = np.unique(owner, return_index=True)
        best[mid], out[mid] = source[first[at]], least
        low, high, left, right = (np.concatenate(x) for x in ((low, mid + 1), (mid - 1, high), (left, best[mid]), (best[mid], right)))
        keep = high >= low
        low, high, left, right = low[keep], high[keep], left[keep], right[keep]
    return out


def _least_around(g2: np.ndarray, radius: int) -> np.ndarray:
    """The same of a matrix g2 with a row for each row and a column for each column, where the least counts within the radius only."""
    out = g2.copy()
    for k in range(1, min(radius, g2.shape[1] - 1) + 1):
        np.minimum(out[:, k:], g2[:, :-k] + k * k, out=out[:, k:])
        np.minimum(out[:, :-k], g2[:, k:] + k * k, out=out[:, :-k])
    return out


def _solve(row: np.ndarray, col: np.ndarray, on: np.ndarray, own: np.ndarray, radius: int | None) -> np.ndarray:
    """The squared distance of own pixels of a band to the nearest feature; the other pixels are features above and below it."""
    top, bottom = int(row[own].min()), int(row[own].max())
    cols, at = np.unique(col, return_inverse=True)
    shape = bottom - top + 1, len(cols)
    line = np.clip(row, top, bottom) - top
    above, below = np.full(shape, -FAR, "i8"), np.full(shape, 2 * FAR, "i8")
    up, down = on & (row <= bottom), on & (row >= top)
    np.maximum.at(above, (line[up], at[up]), row[up])
    np.minimum.at(below, (line[down], at[down]), row[down])
    np.maximum.accumulate(above, axis=0, out=above)
    below = np.minimum.accumulate(below[::-1], axis=0)[::-1]
    rows = np.arange(top, bottom + 1)[:, None]
    g = np.minimum(np.minimum(rows - above, below - rows), FAR)
    # the columns of a row are those of its pixels
    there = np.zeros(shape, bool)
    there[line[own], at[own]] = True
    g2 = np.where(there, g * g, FAR * FAR)
    if radius is not None and radius <= WINDOW_RADIUS and cols[-1] - cols[0] == len(cols) - 1:
        d2 = _least_around(g2, radius)
    else:
        d2 = _least_by_row(np.tile(cols, shape[0]), g2.ravel(), np.arange(shape[0] + 1) * shape[1]).reshape(shape)
    return d2[line, at]


def _band_pass(units: Sequence[str], kept: Sequence[str], radius: int | None, field: Noise | None = None):
    """Tables sorted by the units (a key as text or whole numbers) to their own rows, with the kept columns, d2 and a field's values."""
    most = FAR * FAR if radius is None else radius * radius + 1

    def changes(t: pa.Table) -> np.ndarray:
        new = np.zeros(max(t.num_rows - 1, 0), bool)
        for u in units:
            c = t.column(u).combine_chunks()
            codes = c.dictionary_encode().indices.to_numpy() if pa.types.is_string(c.type) else c.cast(pa.int64()).fill_null(-(1 << 62)).to_numpy()
            new |= codes[1:] != codes[:-1]
        return np.flatnonzero(new) + 1

    def solve(t: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        own = t.column("__own").to_numpy()
        row, col = (t.column(x).to_numpy() for x in ("__row", "__col"))
        placed = ~(np.isnan(row) | np.isnan(col)) if t.column("__row").null_count or t.column("__col").null_count else None
        on, d2 = t.column("__on").to_numpy(), np.full(t.num_rows, most, "i8")
        n = np.full(t.num_rows if field is not None else 0, np.nan)
        for i, j in zip([0, *cuts], [*cuts, t.num_rows], strict=True):
            part = slice(i, j) if placed is None else i + np.flatnonzero(placed[i:j])
            r, c, mine = row[part].astype("i8"), col[part].astype("i8"), own[part]
            if mine.any():
                d2[part] = _solve(r, c, on[part], mine, radius)
            if field is not None:
                n[np.arange(i, j)[mine] if placed is None else part[mine]] = field.at(r[mine], c[mine])
        found = t.select(kept).append_column("__d2", pa.array(d2, mask=d2 >= most))
        if field is not None:
            found = found.append_column("__n", pa.array(n, mask=np.isnan(n)))
        yield from found.filter(pa.array(own)).combine_chunks().to_batches(max_chunksize=1 << 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < HELD:
                continue
            whole = pa.Table.from_batches(held)
            cuts = changes(whole)
            if len(cuts):  # the last unit may go on in the next batch
                yield from solve(whole.slice(0, int(cuts[-1])), cuts[:-1])
                held = whole.slice(int(cuts[-1])).combine_chunks().to_batches()
                n = sum(x.num_rows for x in held)
        if held:
            whole = pa.Table.from_batches(held)
            yield from solve(whole, changes(whole))

    return run


def _with_distance(pixels: DataFrame, feature: Column, keys: Sequence[str], radius: int | None, tile: Sequence[str] = (), field: Noise | None = None) -> DataFrame:
    """pixels with __d2, the squared distance to the nearest feature, null if there is none (within the radius).

    With columns that number tiles, each tile is solved by itself. A field adds __n, its
    value there, null outside of its raster.
    """
    keys, kept = list(keys), pixels.columns
    places = [F.col(x).cast("double" if pixels.schema[x].nullable else "long").alias(f"__{x}") for x in ("row", "col")]
    units = [*(["__key"] if keys else []), *(tile or ["__band"])]
    key = [F.to_json(F.struct(*keys)).alias("__key")] if keys else []
    band = [] if tile else [F.floor(F.col("row") / BAND).alias("__band")]
    cells = pixels.select("*", *key, *band, *places, F.coalesce(feature, F.lit(False)).alias("__on"), F.lit(True).alias("__own"))
    if not tile:
        here = F.when(F.col("__on"), F.col("__row"))
        ends = cells.groupBy(*units, "__col").agg(F.min(here).alias("first"), F.max(here).alias("last"))
        line = Window.partitionBy(*units[:-1], "__col")
        # the rows after a band are those before it in the falling order: a frame that only grows, in one go
        before = lambda order: line.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        near = ends.select(*units, "__col", F.max("last").over(before(F.col("__band").asc())).alias("above"), F.min("first").over(before(F.col("__band").desc())).alias("below"))
        edges = near.select(*units, "__col", F.explode(F.array("above", "below")).alias("__row")).where("__row is not null")
        if radius is not None:
            edges = edges.where((F.col("__row") >= F.col("__band") * BAND - radius) & (F.col("__row") < (F.col("__band") + 1) * BAND + radius))
        cells = cells.unionByName(edges.withColumns({"__on": F.lit(True), "__own": F.lit(False)}), allowMissingColumns=True)
    n = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in pixels.schema] + [T.StructField("__d2", T.LongType())] + [T.StructField("__n", T.DoubleType())] * (field is not None))
    return cells.repartition(n, *units).sortWithinPartitions(*units).mapInArrow(_band_pass(units, kept, radius, field), schema)


def squared_distance(pixels: DataFrame, feature: Column, keys: Iterable[str] = (), radius: int | None = None) -> DataFrame:
    """Key columns, row, col and d2: the squared distance in pixels to the nearest feature, null if there is none (within the radius).

    A raster without any feature has no distances: all are null.
    """
    keys = list(keys)
    narrow = pixels.select(*keys, "row", "col", feature.alias("__f"))
    return _with_distance(narrow, F.col("__f"), keys, radius).select(*keys, "row", "col", F.col("__d2").alias("d2"))


def proximity(pixels: DataFrame, targets: Sequence[int], code: str = "code", maxdist: float | None = None, keys: Iterable[str] = ()) -> DataFrame:
    """Key columns, row, col, distance to the nearest pixel with a target code; targets have 0, and maxdist is the most.

    Without any target in a raster the distance is maxdist, or null if that isn't given.
    """
    feature = F.coalesce(F.col(code).isin(list(targets)), F.lit(False))
    radius = None if maxdist is None else math.ceil(maxdist)
    d = F.sqrt(F.col("d2").cast("double"))
    if maxdist is not None:
        d = F.coalesce(F.least(d, F.lit(float(maxdist))), F.lit(float(maxdist)))
    return squared_distance(pixels, feature, keys, radius).select(*keys, "row", "col", d.alias("distance"))


def feather_radius(sigma: float) -> int:
    """Pixels beyond which 255 * exp(-d^2 / 2 sigma^2) is below 1."""
    return math.ceil(sigma * math.sqrt(2 * math.log(255)))


def halo(sigma: float, truncate: float) -> int:
    if sigma <= 0 or truncate <= 0:
        raise ValueError("sigma and truncate must be above 0")
    return math.ceil(sigma * truncate)


def edge_feather(pixels: DataFrame, mask: str = "m", sigma: float = 1.0, truncate: float = 2.5, tile_size: int | None = None, keys: Iterable[str] = ()) -> DataFrame:
    """Key columns, row, col, alpha: 255 on features (mask not 0), falling off as a Gaussian of the distance to them.

    With a tile size, a tile sees features in itself and `ceil(sigma * truncate)` pixels
    around only, so the result depends on the tiles; without, it doesn't.
    """
    keys = list(keys)
    pad = halo(sigma, truncate)
    radius = feather_radius(sigma)
    feature = F.coalesce(wrap_byte(F.col(mask)) != 0, F.lit(False))
    rows = pixels.select(*keys, "row", "col", feature.alias("__f"))
    owned, tile = F.lit(True), []
    if tile_size is not None:
        if tile_size <= 0:
            raise ValueError("tile_size must be above 0")
        # each pixel goes to the tiles that see it: its own and those within the halo
        for axis in ("row", "col"):
            low = F.greatest(F.lit(0), F.floor((F.col(axis) - pad) / tile_size)).cast("int")
            high = F.floor((F.col(axis) + pad) / tile_size).cast("int")
            rows = rows.withColumn(f"tile_{axis}", F.explode(F.sequence(low, high)))
        owned = (F.floor(F.col("row") / tile_size) == F.col("tile_row")) & (F.floor(F.col("col") / tile_size) == F.col("tile_col"))
        tile = ["tile_row", "tile_col"]
    found = _with_distance(rows, F.col("__f"), keys, radius, tile)
    alpha = F.coalesce(F.floor(255.0 * F.exp(-(F.col("__d2").cast("double") / (2.0 * sigma * sigma)))).cast("int"), F.lit(0))
    return found.where(owned).select(*keys, "row", "col", alpha.alias("alpha"))


# ---------------------------------------------------------------- vignette


def vignette_pixels(height: int, width: int, border: float = 5.0, noise: float = 20.0, warp: float = 60.0) -> tuple[int, int, int]:
    """Fade, noise and warp in pixels, of percentages."""
    fade = max(1, int(min(height, width) * (border / 100.0)))
    return fade, int(fade * (noise / 100.0)), int(fade * (warp / 100.0))


def vignette(pixels: DataFrame, height: int, width: int, alpha: str | None = None, border: float = 5.0, noise: float = 0.0, warp: float = 0.0, replace_alpha: bool = False, seed: int | None = None, out: str = "alpha", keys: Iterable[str] = ()) -> DataFrame:
    """pixels with an alpha that fades towards the edges (or towards where alpha is 0).

    With noise or warp, the fields are those that NumPy's generator draws whole, in the
    order warp then grain; each band of rows draws its part of them.
    """
    keys = list(keys)
    if border <= 0:
        return pixels if alpha == out else pixels.withColumn(out, F.col(alpha) if alpha else F.lit(255))
    fade, grain, pull = vignette_pixels(height, width, border, noise, warp)
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == height - 1) | (F.col("col") == width - 1)
    outside = edge | (F.col(alpha) <= 0) if alpha else edge
    field = Noise(height, width, fade, grain, pull, seed) if grain or pull else None
    at = [*keys, "row", "col"]
    placed = pixels.select(*at, *(c for c in pixels.columns if c not in at)).dropna(subset=at)
    found = _with_distance(placed, outside, keys, None if pull else fade + grain, field=field)
    # beyond the radius a pixel is clear of the fade, whatever the grain
    d = F.coalesce(F.sqrt(F.col("__d2").cast("double")), F.lit(float(fade + grain)))
    if field is not None:
        found, d = found.where("__n is not null"), d + F.col("__n")
    level = F.rint(clip(d, 0.0, float(fade)) / float(fade) * 255.0)
    smooth = F.rint(smoothstep(0.0, 1.0, level / 255.0) * 255.0)
    value = smooth if alpha is None or replace_alpha else F.rint(F.col(alpha) * smooth / 255.0)
    return found.withColumn(out, value.cast("int")).drop("__d2", "__n")


#: Values beyond those used that a part of a spline is solved with; each takes a cut's influence down to 0.27 of itself.
SPLINE_REACH = 40


def _spline(values: np.ndarray, begins: bool, ends: bool) -> np.ndarray:
    """Coefficients of a cubic spline along the first axis, mirrored where the values begin or end."""
    n = len(values)
    lower, diagonal, upper = np.full(n, 1 / 6), np.full(n, 4 / 6), np.full(n, 1 / 6)
    upper[0], lower[-1] = (2 if begins else 1) / 6, (2 if ends else 1) / 6
    c = values.astype("f8")
    for i in range(1, n):
        m = lower[i] / diagonal[i - 1]
        diagonal[i] -= m * upper[i - 1]
        c[i] -= m * c[i - 1]
    c[-1] /= diagonal[-1]
    for i in range(n - 2, -1, -1):
        c[i] = (c[i] - upper[i] * c[i + 1]) / diagonal[i]
    return c


def _zoom_rows(values: Callable[[int, int], np.ndarray], n: int, size: int, low: int, high: int) -> np.ndarray:
    """Rows low to high of the `size` to which n rows are enlarged; values(a, b) gives rows a to b of the n."""
    if n == 1:
        return np.repeat(values(0, 1), high - low, axis=0)
    x = np.arange(low, high) * ((n - 1) / (size - 1) if size > 1 else 0.0)
    if size > 1 and high == size:
        x[-1] = n - 1
    i = np.minimum(x.astype(int), n - 2)
    begin, end = max(0, int(i[0]) - 1 - SPLINE_REACH), min(n, int(i[-1]) + 3 + SPLINE_REACH)
    c = _spline(values(begin, end), begin == 0, end == n)
    t = (x - i)[:, None]
    mirrored = lambda k: np.where(k < 0, -k, np.where(k >= n, 2 * (n - 1) - k, k))
    basis = ((1 - t) ** 3 / 6, (3 * t**3 - 6 * t**2 + 4) / 6, (-3 * t**3 + 3 * t**2 + 3 * t + 1) / 6, t**3 / 6)
    return sum(b * c[mirrored(i + k - 1) - begin] for k, b in enumerate(basis))


def cubic_zoom(field: np.ndarray, height: int, width: int) -> np.ndarray:
    """A field enlarged by cubic splines through its values, corner to corner."""
    axis = lambda values, size: _zoom_rows(lambda a, b: values[a:b], len(values), size, 0, size)
    return axis(axis(field, height).T, width).T


class Noise:
    """What is added to the distance: octaves of uniform noise, each with half the scale and amplitude of the one before, and grain.

    Any rows of it can be had by themselves: the generator is moved on to their draws.
    """

    def __init__(self, height: int, width: int, fade: int, grain: int, pull: int, seed: int | None, octaves: int = 3):
        self.height, self.width, self.grain, self.pull = height, width, grain, pull
        self.seed = np.random.SeedSequence(seed).entropy  # without a seed all tasks share the one drawn here
        scales = [max(50.0, fade * 1.5) / 2**k for k in range(octaves if pull else 0)]
        self.sizes = [(max(1, int(height / s)), max(1, int(width / s))) for s in scales]

    def _draw(self, skip: int, shape: tuple[int, int], low: float, high: float) -> np.ndarray:
        return np.random.Generator(np.random.PCG64(self.seed).advance(skip)).uniform(low, high, shape).astype("f4")

    def rows(self, low: int, high: int) -> np.ndarray:
        shape = high - low, self.width
        field, total, weight, skip = np.zeros(shape, "f4"), np.zeros(shape, "f4"), 0.0, 0
        for k, (h, w) in enumerate(self.sizes):
            small = _zoom_rows(lambda a, b, w=w, skip=skip: self._draw(skip + a * w, (b - a, w), -1.0, 1.0).astype("f8"), h, self.height, low, high)
            total += (_zoom_rows(lambda a, b, s=small: s.T[a:b], w, self.width, 0, self.width).T * 0.5**k).astype("f4")
            weight += 0.5**k
            skip += h * w
        if self.pull:
            field += total / np.float32(weight) * np.float32(self.pull) - np.float32(self.pull)
        if self.grain:
            field -= self._draw(skip + low * self.width, shape, 0.0, float(self.grain))
        return field.astype("f8")

    def at(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """The noise of pixels of a band, NaN outside of the raster."""
        inside = (row >= 0) & (row < self.height) & (col >= 0) & (col < self.width)
        out = np.full(len(row), np.nan)
        if inside.any():
            low = int(row[inside].min())
            out[inside] = self.rows(low, int(row[inside].max()) + 1)[row[inside] - low, col[inside]]
        return out


# ---------------------------------------------------------------- convolution, inpainting, filling


def gaussian_kernel(sigma: float, truncate: float = 3.0) -> list[float]:
    """Weights of a Gaussian from -r to r, r = floor(sigma * truncate + 1/2), that sum to 1."""
    r = int(sigma * truncate + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(raw) for x in raw]


def gaussian_blur(pixels: DataFrame, bands: Sequence[str] = ("v",), sigma: float = 1.0, truncate: float = 3.0, keys: Iterable[str] = ()) -> DataFrame:
    """Key columns, row, col and blurred bands; outside of the raster is 0.

    Two passes of window functions, one along columns and one along rows; a lag or lead
    for each weight.
    """
    keys, weights = list(keys), gaussian_kernel(sigma, truncate)
    r = len(weights) // 2

    def along(df: DataFrame, across: str, on: str) -> DataFrame:
        line = Window.partitionBy(*keys, across).orderBy(on)

        def one(band: str) -> Column:
            total = F.lit(0.0)
            for k in range(-r, r + 1):
                place, value = F.lag(on, -k).over(line), F.lag(F.col(band).cast("double"), -k).over(line)
                # pixels may be missing from a sparse raster
                total = total + F.when(place == F.col(on) + k, value * weights[k + r]).otherwise(0.0)
            return total

        return df.select(*keys, "row", "col", *(one(b).alias(b) for b in bands))

    return along(along(pixels, "col", "row"), "row", "col")


def _around(pixels: DataFrame, hole: Column, value: Column, keys: Sequence[str], radius: int) -> DataFrame:
    """Key columns, row, col of each hole with v and d2 of the valid values around it, within the radius along both axes.

    Holes look for their neighbours, not pixels for holes: the explosion grows with the
    holes, and the pixels are shuffled once as they are.
    """
    offsets = F.array(*(F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if dr or dc))
    holes = pixels.where(hole).select(*keys, F.col("row").alias("__r"), F.col("col").alias("__c"), F.explode(offsets).alias("o"))
    wanted = holes.select(*keys, "__r", "__c", (F.col("__r") + F.col("o.dr")).alias("row"), (F.col("__c") + F.col("o.dc")).alias("col"), (F.col("o.dr") * F.col("o.dr") + F.col("o.dc") * F.col("o.dc")).alias("d2"))
    values = pixels.where(~hole).select(*keys, "row", "col", value.alias("v")).where("v is not null")
    return wanted.join(values, [*keys, "row", "col"]).select(*keys, F.col("__r").alias("row"), F.col("__c").alias("col"), "v", "d2")


def inpaint_mode(pixels: DataFrame, codes: Sequence[int], code: str = "code", radius: int = 1, keys: Iterable[str] = ()) -> DataFrame:
    """pixels in which those codes are replaced by the most frequent other code around them (of equals the least); without one they stay."""
    keys = list(keys)
    at = [*keys, "row", "col"]
    is_hole = F.coalesce(F.col(code).isin(list(codes)), F.lit(False))
    votes = _around(pixels, is_hole, F.col(code), keys, radius).groupBy(*at, "v").agg(F.count("*").alias("n"))
    best = votes.groupBy(*at).agg(F.max_by("v", F.struct(F.col("n"), -F.col("v"))).alias("__best"))
    return pixels.join(best, at, "left").withColumn(code, F.when(is_hole, F.coalesce("__best", code)).otherwise(F.col(code))).drop("__best")


def fill_nodata(pixels: DataFrame, nodata: float, band: str = "v", radius: int = 8, keys: Iterable[str] = ()) -> DataFrame:
    """pixels in which nodata is replaced by the mean of valid values within the radius, weighted by inverse distance; without any it stays."""
    keys = list(keys)
    at = [*keys, "row", "col"]
    hole = F.coalesce(F.col(band) == nodata, F.lit(False))
    near = _around(pixels, hole, F.col(band).cast("double"), keys, radius).where(F.col("d2") <= radius * radius)
    weight = 1.0 / F.sqrt(F.col("d2").cast("double"))
    filled = near.groupBy(*at).agg((F.sum(F.col("v") * weight) / F.sum(weight)).alias("__fill"))
    return pixels.join(filled, at, "left").withColumn(band, F.when(hole, F.coalesce(F.col("__fill"), F.col(band))).otherwise(F.col(band))).drop("__fill")
