"""Geometric operators: georeferencing, crops, alignment to another grid, overviews and tiles."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.crs import MERCATOR, transform, ways
from cellweave.functions.expr import to_byte


@dataclass(frozen=True)
class Grid:
    """A north-up raster's place: upper left corner (x, y), pixel size (dy is normally negative), size and CRS."""

    x: float
    y: float
    dx: float
    dy: float
    width: int
    height: int
    crs: str = ""

    @property
    def extent(self) -> tuple[float, float, float, float]:
        """xmin, ymin, xmax, ymax."""
        xs, ys = (self.x, self.x + self.dx * self.width), (self.y, self.y + self.dy * self.height)
        return min(xs), min(ys), max(xs), max(ys)

    def centre(self, row: Column | str = "row", col: Column | str = "col") -> tuple[Column, Column]:
        row, col = (F.col(x) if isinstance(x, str) else x for x in (row, col))
        return (col + 0.5) * self.dx + self.x, (row + 0.5) * self.dy + self.y


# ---------------------------------------------------------------- crop


def subset_window(width: int, height: int, size: int = 4000, x_anchor: float = 0.5, y_anchor: float = 0.5) -> tuple[int, int, int, int]:
    """col offset, row offset, width and height of a square crop; the whole raster if the crop is larger than a side."""
    if not (0 <= x_anchor <= 1 and 0 <= y_anchor <= 1):
        raise ValueError("anchors must be in 0..1")
    if size > min(width, height):
        return 0, 0, width, height
    return int((width - size) * x_anchor), int((height - size) * y_anchor), size, size


def create_subset(pixels: DataFrame, width: int, height: int, size: int = 4000, x_anchor: float = 0.5, y_anchor: float = 0.5) -> DataFrame:
    """The crop's pixels with rows and columns from its own corner. The range filter reaches the scan."""
    x, y, w, h = subset_window(width, height, size, x_anchor, y_anchor)
    inside = F.col("row").between(y, y + h - 1) & F.col("col").between(x, x + w - 1)
    return pixels.where(inside).withColumns({"row": F.col("row") - y, "col": F.col("col") - x})


# ---------------------------------------------------------------- alignment


def _cubic(t: Column) -> list[Column]:
    """Weights of the cells at -1, 0, 1 and 2 around a fraction (convolution cubic, a = -1/2)."""
    t2, t3 = t * t, t * t * t
    return [-0.5 * t + t2 - 0.5 * t3, 1.0 - 2.5 * t2 + 1.5 * t3, 0.5 * t + 2.0 * t2 - 1.5 * t3, -0.5 * t2 + 0.5 * t3]


def _spline(t: Column) -> list[Column]:
    """Weights of the same cells by the cubic B-spline."""
    t2, t3 = t * t, t * t * t
    return [(1.0 - 3.0 * t + 3.0 * t2 - t3) / 6.0, (4.0 - 6.0 * t2 + 3.0 * t3) / 6.0, (1.0 + 3.0 * t + 3.0 * t2 - 3.0 * t3) / 6.0, t3 / 6.0]


def _lanczos(t: Column) -> list[Column]:
    """Weights of the cells at -2 to 3 by the sinc function in a window of three cells."""

    def weight(i: int) -> Column:
        d = (t - float(i)) * math.pi
        return F.when(d == 0, F.lit(1.0)).otherwise(3.0 * F.sin(d) * F.sin(d / 3.0) / (d * d))

    return [weight(i) for i in range(-2, 4)]


#: First cell and weights of the kernel methods.
KERNELS = {"bilinear": (0, lambda t: [1.0 - t, t]), "cubic": (-1, _cubic), "cubicspline": (-1, _spline), "lanczos": (-2, _lanczos)}
#: Methods that sum up the source cells of a target pixel.
SUMMARIES = {
    "average": F.avg,
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "rms": lambda v: F.sqrt(F.avg(v * v)),
    "q1": lambda v: F.percentile(v, F.lit(0.25)),
    "med": lambda v: F.percentile(v, F.lit(0.5)),
    "q3": lambda v: F.percentile(v, F.lit(0.75)),
}
METHODS = ("near", "nearest", *KERNELS, *SUMMARIES, "mode")


def align(pixels: DataFrame, source: Grid, template: Grid, bands: Sequence[str] = ("v",), method: str = "bilinear", nodata: float | None = None) -> DataFrame:
    """row, col and bands on the template's grid, by one of METHODS; coordinates are converted if the CRS differ.

    Kernel methods list, for each template pixel whose centre is inside the source, the
    source cells of its kernel with their weights, and equi-join them; weights of cells
    that are absent or nodata are left out and the rest rescaled. Summaries and mode
    assign each source cell to the template pixel that holds its centre. nodata is null
    in the result, band by band.
    """
    if method not in METHODS:
        raise ValueError(f"unknown resampling method {method!r}")
    if source.crs != template.crs:
        ways(source.crs), ways(template.crs)
    spark = pixels.sparkSession
    values = pixels.select("row", "col", *bands)
    if nodata is not None:
        values = values.withColumns({b: F.when(F.col(b) != nodata, F.col(b)) for b in bands})
    if method in SUMMARIES or method == "mode":
        x, y = transform(*source.centre(), source.crs, template.crs)
        placed = values.withColumns({"__x": x, "__y": y})
        to_col, to_row = (F.floor((F.col(a) - origin) / step).cast("int") for a, origin, step in (("__x", template.x, template.dx), ("__y", template.y, template.dy)))
        placed = placed.select(to_row.alias("row"), to_col.alias("col"), *bands).where(F.col("row").between(0, template.height - 1) & F.col("col").between(0, template.width - 1))
        if method in SUMMARIES:
            return placed.groupBy("row", "col").agg(*(SUMMARIES[method](F.col(b).cast("double")).alias(b) for b in bands))
        # counts of each value first, so that the winner is a pre-aggregated maximum
        out = None
        for b in bands:
            votes = placed.groupBy("row", "col", F.col(b).alias("v")).agg(F.count("*").alias("n")).where("v is not null")
            won = votes.groupBy("row", "col").agg(F.max_by("v", F.struct(F.col("n"), -F.col("v"))).alias(b))
            out = won if out is None else out.join(won, ["row", "col"], "full")
        return out  # type: ignore[return-value]
    target = spark.range(template.height * template.width).select((F.col("id") / template.width).cast("int").alias("row"), (F.col("id") % template.width).cast("int").alias("col"))
    x, y = transform(*template.centre(), template.crs, source.crs)
    fc, fr = (x - source.x) / source.dx, (y - source.y) / source.dy  # in source cells from the corner
    target = target.withColumns({"fc": fc, "fr": fr}).where((F.col("fc") >= 0) & (F.col("fc") < source.width) & (F.col("fr") >= 0) & (F.col("fr") < source.height))
    if method in ("near", "nearest"):
        cells = target.select("row", "col", F.floor("fr").cast("int").alias("__r"), F.floor("fc").cast("int").alias("__c"))
        return cells.join(values.withColumnsRenamed({"row": "__r", "col": "__c"}), ["__r", "__c"]).select("row", "col", *bands)
    begin, weights = KERNELS[method]
    cell = target.withColumns({"__r0": F.floor(F.col("fr") - 0.5), "__c0": F.floor(F.col("fc") - 0.5)})
    cell = cell.withColumns({"__tr": F.col("fr") - 0.5 - F.col("__r0"), "__tc": F.col("fc") - 0.5 - F.col("__c0")})
    # rows of the kernel first, then columns: no weight is written out for each pair
    down = F.array(*(F.struct((F.col("__r0") + (begin + i)).cast("int").alias("r"), w.alias("w")) for i, w in enumerate(weights(F.col("__tr")))))
    across = F.array(*(F.struct((F.col("__c0") + (begin + j)).cast("int").alias("c"), w.alias("w")) for j, w in enumerate(weights(F.col("__tc")))))
    cells = cell.select("row", "col", "__c0", "__tc", F.explode(down).alias("__d")).select("row", "col", "__d", F.explode(across).alias("__a"))
    cells = cells.select("row", "col", F.col("__d.r").alias("__r"), F.col("__a.c").alias("__c"), (F.col("__d.w") * F.col("__a.w")).alias("__w")).where("__w <> 0")
    joined = cells.join(values.withColumnsRenamed({"row": "__r", "col": "__c"}), ["__r", "__c"])
    aggregates = []
    for b in bands:
        w = F.when(F.col(b).isNotNull(), F.col("__w"))
        aggregates.append((F.sum(w * F.col(b)) / F.when(F.sum(w) != 0, F.sum(w))).alias(b))
    return joined.groupBy("row", "col").agg(*aggregates)


# ---------------------------------------------------------------- pyramid and tiles


def overview(pixels: DataFrame, factor: int, bands: Sequence[str] = ("v",), keys: Iterable[str] = ()) -> DataFrame:
    """Key columns, row, col and means of blocks of factor by factor pixels; partial sums are combined before the shuffle."""
    cell = [F.expr(f"cast({a} div {factor} as int)").alias(a) for a in ("row", "col")]
    return pixels.groupBy(*keys, *cell).agg(*(F.avg(F.col(b).cast("double")).alias(b) for b in bands))


def pyramid(pixels: DataFrame, levels: Sequence[int] = (2, 4, 8, 16, 32, 64, 128), bands: Sequence[str] = ("v",), keys: Iterable[str] = ()) -> DataFrame:
    """level, key columns, row, col and means, of all levels: each made of the sums and counts of the one before where it divides it."""
    keys = list(keys)
    sums = pixels.select(*keys, "row", "col", *(x for b in bands for x in (F.col(b).cast("double").alias(f"s_{b}"), F.when(F.col(b).isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias(f"n_{b}"))))
    made: dict[int, DataFrame] = {1: sums}
    out = None
    for level in sorted(levels):
        base = max(k for k in made if level % k == 0)
        step = level // base
        cell = [F.expr(f"cast({a} div {step} as int)").alias(a) for a in ("row", "col")]
        made[level] = made[base].groupBy(*keys, *cell).agg(*(F.sum(f"{p}_{b}").alias(f"{p}_{b}") for b in bands for p in "sn"))
        one = made[level].select(F.lit(level).alias("level"), *keys, "row", "col", *((F.col(f"s_{b}") / F.when(F.col(f"n_{b}") > 0, F.col(f"n_{b}"))).alias(b) for b in bands))
        out = one if out is None else out.unionByName(one)
    return out  # type: ignore[return-value]


def to_tiles(pixels: DataFrame, size: int = 256, bands: Sequence[str] = ("v",), keys: Iterable[str] = (), sparse: float | None = 0) -> DataFrame:
    """Key columns, tile_row, tile_col, h, w and one array per band, row by row; tiles of which all values are `sparse` are left out.

    A tile has size * size pixels at most, so collecting one has a bound. Missing pixels are null.
    """
    keys = list(keys)
    local = [F.expr(f"cast({a} % {size} as int)").alias(f"__{a}") for a in ("row", "col")]
    tile = [F.expr(f"cast({a} div {size} as int)").alias(f"tile_{a}") for a in ("row", "col")]
    placed = pixels.select(*keys, *tile, *local, *bands)
    group = placed.groupBy(*keys, "tile_row", "tile_col")
    packed = group.agg((F.max("__row") + 1).alias("h"), (F.max("__col") + 1).alias("w"), F.map_from_entries(F.collect_list(F.struct((F.col("__row") * size + F.col("__col")).alias("at"), F.struct(*bands).alias("p")))).alias("m"))
    arrays = [F.expr(f"transform(sequence(0, h * w - 1), i -> m[cast(i div w as int) * {size} + i % w].`{b}`)").alias(b) for b in bands]
    tiles = packed.select(*keys, "tile_row", "tile_col", "h", "w", *arrays)
    if sparse is None:
        return tiles
    some = F.lit(False)
    for b in bands:
        some = some | F.exists(b, lambda v: v.isNotNull() & (v != sparse))
    return tiles.where(some)


def from_tiles(tiles: DataFrame, size: int = 256, bands: Sequence[str] = ("v",), keys: Iterable[str] = ()) -> DataFrame:
    """The pixel form of tiles."""
    keys = list(keys)
    zipped = F.arrays_zip(*bands)
    flat = tiles.select(*keys, "tile_row", "tile_col", "w", F.posexplode(zipped).alias("i", "p"))
    row, column = F.expr(f"cast(tile_row * {size} + i div w as int)").alias("row"), F.expr(f"cast(tile_col * {size} + i % w as int)").alias("col")
    return flat.select(*keys, row, column, *(F.col(f"p.{b}").alias(b) for b in bands))


def mercator_zoom(grid: Grid, tile: int = 256) -> int:
    """The least zoom whose resolution is at least the grid's."""
    return max(0, math.ceil(math.log2(2 * MERCATOR / (tile * abs(grid.dx))) - 1e-9))


def mercator_extent(grid: Grid) -> tuple[float, float, float, float]:
    """xmin, ymin, xmax, ymax in web Mercator of points along the border of a grid, a 65th of a side apart."""
    if grid.crs == "EPSG:3857":
        return grid.extent
    from pyspark.sql import SparkSession

    spark, n = SparkSession.active(), 64
    xmin, ymin, xmax, ymax = grid.extent
    steps = [(xmin + (xmax - xmin) * i / n, ymin + (ymax - ymin) * i / n) for i in range(n + 1)]
    points = [p for x, y in steps for p in ((x, ymin), (x, ymax), (xmin, y), (xmax, y))]
    x, y = transform(F.col("x"), F.col("y"), grid.crs, "EPSG:3857")
    placed = spark.createDataFrame(points, "x double, y double").select(x.alias("x"), y.alias("y"))
    return tuple(placed.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first())  # type: ignore[return-value]


def mercator_grid(grid: Grid, zoom: int, tile: int = 256) -> tuple[Grid, int, int]:
    """The part of a zoom's pixel grid that covers a raster, and its first column and row on that grid."""
    res = 2 * MERCATOR / (tile << zoom)
    xmin, ymin, xmax, ymax = mercator_extent(grid)
    last = (tile << zoom) - 1
    gx0, gx1 = (min(max(math.floor((v + MERCATOR) / res), 0), last) for v in (xmin, xmax))
    gy0, gy1 = (min(max(math.floor((MERCATOR - v) / res), 0), last) for v in (ymax, ymin))
    return Grid(gx0 * res - MERCATOR, MERCATOR - gy0 * res, res, -res, gx1 - gx0 + 1, gy1 - gy0 + 1, "EPSG:3857"), gx0, gy0


def native_zoom(grid: Grid, tile: int = 256) -> int:
    """The least zoom that is no coarser than the raster, in any known CRS."""
    if grid.crs == "EPSG:3857":
        return mercator_zoom(grid, tile)
    xmin, _, xmax, _ = mercator_extent(grid)
    return max(0, math.ceil(math.log2(2 * MERCATOR * grid.width / (tile * (xmax - xmin))) - 1e-9))


def tile_pyramid(pixels: DataFrame, grid: Grid, bands: Sequence[str], min_zoom: int, max_zoom: int, tile: int = 256, method: str = "nearest", nodata: float | None = None) -> DataFrame:
    """zoom, tile_column, tile_row (from the north), row, col (in the tile) and byte bands of web-map tiles.

    Zooms that are coarser than the raster are means of its pixels by their centres;
    zooms that are finer, and the finest one of a raster in another CRS, are resampled
    to the zoom's grid, so that no pixel within the raster is missing. Means of a zoom
    are made of the sums and counts of the zoom below it, not of rounded values: the
    raster is read once for them and once for each finer zoom.
    """
    native = native_zoom(grid, tile)
    values = pixels.select("row", "col", *(F.col(b).cast("double").alias(b) for b in bands))
    same = grid.crs == "EPSG:3857"
    exact = same and mercator_grid(grid, native, tile)[0].dx == abs(grid.dx)
    resampled = [z for z in range(max_zoom, min_zoom - 1, -1) if z > native or z == native and not exact]
    averaged = [z for z in range(max_zoom, min_zoom - 1, -1) if z not in resampled]
    parts = []
    for zoom in resampled:
        window, gx0, gy0 = mercator_grid(grid, zoom, tile)
        placed = align(values, grid, window, bands, method, nodata)
        parts.append(placed.select(F.lit(zoom).alias("zoom"), (F.col("col") + F.lit(gx0).cast("long")).alias("gx"), (F.col("row") + F.lit(gy0).cast("long")).alias("gy"), *bands))
    if averaged:
        valid = lambda b: F.col(b) if nodata is None else F.when(F.col(b) != nodata, F.col(b))
        x, y = transform(*grid.centre(), grid.crs, "EPSG:3857")
        res = 2 * MERCATOR / (tile << averaged[0])
        staged = values.withColumns({"__x": x, "__y": y})
        sums = staged.select(F.floor((F.col("__x") + MERCATOR) / res).cast("long").alias("gx"), F.floor((MERCATOR - F.col("__y")) / res).cast("long").alias("gy"), *(c for b in bands for c in (valid(b).alias(f"s_{b}"), F.when(valid(b).isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("long").alias(f"n_{b}"))))
        for zoom in averaged:
            by = ["gx", "gy"] if zoom == averaged[0] else [F.expr("gx div 2").alias("gx"), F.expr("gy div 2").alias("gy")]
            sums = sums.groupBy(*by).agg(*(F.sum(f"{p}_{b}").alias(f"{p}_{b}") for b in bands for p in "sn"))
            parts.append(sums.select(F.lit(zoom).alias("zoom"), "gx", "gy", *((F.col(f"s_{b}") / F.when(F.col(f"n_{b}") > 0, F.col(f"n_{b}"))).alias(b) for b in bands)))
    split = {"tile_column": f"cast(gx div {tile} as int)", "tile_row": f"cast(gy div {tile} as int)", "row": f"cast(gy % {tile} as int)", "col": f"cast(gx % {tile} as int)"}
    out = None
    for part in parts:
        one = part.select("zoom", *(F.expr(e).alias(k) for k, e in split.items()), *(to_byte(F.col(b)).alias(b) for b in bands))
        out = one if out is None else out.unionByName(one)
    return out  # type: ignore[return-value]
