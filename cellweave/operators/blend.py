"""Pointwise operators on aligned rasters: masked blend, hillshade blend and the layer pipeline.

Aligned rasters meet by an equi-join on their keys, row and column. Layers that are
already columns of one table need no join: the column functions work on them directly.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.expr import clip, col, lerp, num, smoothstep, to_byte

CELL = ("row", "col")


def dimensions(pixels: DataFrame) -> tuple[int, int]:
    """Width and height: one past the largest column and row."""
    found = pixels.agg(F.max("col"), F.max("row")).first()
    return ((found[0] if found[0] is not None else -1) + 1, (found[1] if found[1] is not None else -1) + 1)


def check_aligned(rasters: Mapping[str, DataFrame]) -> None:
    """Raises ValueError unless all rasters have the same width and height."""
    sizes = {name: dimensions(r) for name, r in rasters.items()}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"dimensions differ: {sizes}")


def blend_value(a: Column | str, b: Column | str, mask: Column | str) -> Column:
    """A where the mask is 255, B where it is 0, the rounded mixture between."""
    m = col(mask) / 255.0
    return to_byte(col(a) * m + col(b) * (1.0 - m))


def masked_blend(a: DataFrame, b: DataFrame, mask: DataFrame, bands: Sequence[str] = ("b1", "b2", "b3"), mask_band: str = "m", keys: Iterable[str] = CELL, check: bool = False) -> DataFrame:
    """Key columns and bands of the blend. With `check`, the sizes of A and B are compared first, which reads them."""
    if check:
        check_aligned({"a": a, "b": b})
    keys = list(keys)
    left = a.select(*keys, *(F.col(x).alias(f"a_{x}") for x in bands))
    right = b.select(*keys, *(F.col(x).alias(f"b_{x}") for x in bands))
    joined = left.join(right, keys).join(mask.select(*keys, F.col(mask_band).alias("__m")), keys)
    return joined.select(*keys, *(blend_value(f"a_{x}", f"b_{x}", "__m").alias(x) for x in bands))


@dataclass(frozen=True)
class Shading:
    """Options of the hillshade blend; ranges are on 0..255."""

    protect_shadows: float = 0.2
    protect_highlights: float = 0.10
    shadow_range: tuple[float, float] = (0, 60)
    highlight_range: tuple[float, float] = (220, 255)
    hill_floor: float = 0.0
    hill_gamma: float = 1.0
    hill_ceil: float = 1.0
    shade_strength: float = 0.8

    def __post_init__(self) -> None:
        for name in ("protect_shadows", "protect_highlights", "hill_floor", "hill_ceil", "shade_strength"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must be in 0..1")
        if self.hill_gamma <= 0:
            raise ValueError("hill_gamma must be above 0")
        if self.hill_floor > self.hill_ceil:
            raise ValueError("hill_floor must not be above hill_ceil")
        for name in ("shadow_range", "highlight_range"):
            low, high = getattr(self, name)
            if not 0 <= low <= high <= 255:
                raise ValueError(f"{name} must be two rising numbers in 0..255")


#: Largest values of integer types.
LARGEST = {"uint8": 255.0, "int8": 127.0, "uint16": 65535.0, "int16": 32767.0, "uint32": 4294967295.0, "int32": 2147483647.0}


def hill_denominator(hill: DataFrame, band: str = "hill", dtype: str = "float32") -> float:
    """What scales a hillshade to 0..1: an integer type's largest value; of floats 1 if none is above 1.5, else 255."""
    if dtype in LARGEST:
        return LARGEST[dtype]
    h = F.col(band).cast("double")
    finite = ~F.isnan(h) & (F.abs(h) != float("inf"))
    top = hill.agg(F.max(F.when(finite, h))).first()[0]
    return 1.0 if top is None or top <= 1.5 else 255.0


def tone_of(x: Column, options: Shading) -> Column:
    """A hillshade on 0..1 after floor, gamma and ceiling."""
    h = clip(x, 0.0, 1.0)
    if options.hill_floor > 0 or options.hill_gamma != 1 or options.hill_ceil < 1:
        lifted = h if options.hill_gamma == 1 else F.pow(h, F.lit(float(options.hill_gamma)))
        h = options.hill_floor + (1.0 - options.hill_floor) * lifted
        if options.hill_ceil < 1:
            h = F.when(h.isNotNull(), F.least(h, F.lit(float(options.hill_ceil))))
        h = clip(h, 0.0, 1.0)
    return h


def tone(hill: Column | str, options: Shading, denominator: Column | float = 255.0) -> Column:
    """The hillshade on 0..1 after scaling, floor, gamma and ceiling."""
    return tone_of(col(hill).cast("double") / num(denominator), options)


def shade_factor(hill: Column | str, options: Shading = Shading(), denominator: Column | float = 255.0) -> Column:
    """What colors are multiplied with; shadows and highlights are protected by a weight that lifts it to 1."""
    h = tone(hill, options, denominator)
    (s0, s1), (h0, h1) = ((x / 255.0, y / 255.0) for x, y in (options.shadow_range, options.highlight_range))
    weight = F.greatest((1.0 - smoothstep(s0, s1, h)) * options.protect_shadows, smoothstep(h0, h1, h) * options.protect_highlights)
    m = clip(h + weight * (1.0 - h), 0.0, 1.0)
    return clip((1.0 - options.shade_strength) + options.shade_strength * m, 0.0, 1.0)


def shade(pixels: DataFrame, hill: str = "hill", bands: Sequence[str] = ("r", "g", "b"), options: Shading = Shading(), denominator: Column | float = 255.0, nodata: float | None = None) -> DataFrame:
    """Bands of one table shaded by its hillshade column; where that is null or nodata, nothing is shaded. Other columns stay.

    What shade_factor gives, in steps that are each used several times and so stay
    projections of their own: written as one expression, the generated method is
    too large for the JVM to compile.
    """
    unknown = F.col(hill).isNull() if nodata is None else F.col(hill).isNull() | (F.col(hill) == nodata)
    o = options
    (s0, s1), (h0, h1) = ((x / 255.0, y / 255.0) for x, y in (o.shadow_range, o.highlight_range))
    step = lambda low, high: F.lit(0.0) if low == high else clip((F.col("__h") - low) / (high - low), 0.0, 1.0)
    smooth = lambda t: F.col(t) * F.col(t) * (3.0 - F.col(t) * 2.0)
    staged = pixels.withColumn("__x", F.col(hill).cast("double") / num(denominator)).withColumn("__h", tone_of(F.col("__x"), o))
    staged = staged.withColumns({"__s": step(s0, s1), "__t": step(h0, h1)})
    staged = staged.withColumn("__w", F.greatest((1.0 - smooth("__s")) * o.protect_shadows, smooth("__t") * o.protect_highlights))
    staged = staged.withColumn("__l", F.col("__h") + F.col("__w") * (1.0 - F.col("__h")))
    staged = staged.withColumn("__f", (1.0 - o.shade_strength) + o.shade_strength * clip(F.col("__l"), 0.0, 1.0))
    staged = staged.withColumn("__m", F.when(unknown, F.lit(1.0)).otherwise(clip(F.col("__f"), 0.0, 1.0)))
    for x in bands:
        staged = staged.withColumn(f"__b_{x}", F.col("__m") * F.col(x))
    return staged.withColumns({x: to_byte(F.col(f"__b_{x}")) for x in bands}).drop("__x", "__h", "__s", "__t", "__w", "__l", "__f", "__m", *(f"__b_{x}" for x in bands))


def hillshade_blend(hill: DataFrame, color: DataFrame, band: str = "hill", bands: Sequence[str] = ("r", "g", "b"), alpha: str | None = None, options: Shading = Shading(), dtype: str = "uint8", nodata: float | None = None, fill: bool = False, keys: Iterable[str] = CELL, check: bool = False) -> DataFrame:
    """Key columns and bands of color, shaded; alpha passes through. With `fill`, nodata cells of the hillshade are filled from their surroundings first."""
    if check:
        check_aligned({"hill": hill, "color": color})
    keys = list(keys)
    shadow = hill.select(*keys, F.col(band).alias("__hill"))
    if nodata is not None and fill:
        from cellweave.operators.focal import fill_nodata

        shadow = fill_nodata(shadow.withColumnRenamed("__hill", "v"), nodata, keys=[k for k in keys if k not in CELL]).withColumnRenamed("v", "__hill")
    joined = color.select(*keys, *bands, *([alpha] if alpha else [])).join(shadow, keys)
    denominator = hill_denominator(hill if nodata is None else hill.where(F.col(band) != nodata), band, dtype)
    return shade(joined, "__hill", bands, options, denominator, nodata).drop("__hill")


# ---------------------------------------------------------------- layer pipeline


@dataclass(frozen=True)
class Step:
    """kind: mix_palettes, init, lerp or multiply."""

    kind: str
    factor: str
    palette_a: str | None = None
    palette_b: str | None = None
    target: str | None = None
    output: str | None = None


Layer = Sequence[Column]


def _mixed(a: Layer, b: Layer, f: Column) -> list[Column]:
    return [lerp(x, y, f) for x, y in zip(a, b, strict=True)]


def run_pipeline(palettes: Mapping[str, Layer], factors: Mapping[str, Column | None], steps: Sequence[Step], required: str | None = "HUMID_VEGETATION") -> list[Column]:
    """The composed image as one expression per band, in 0..255.

    Palettes and factors are columns of one table. A step whose factor key is absent is
    skipped; so is one whose factor is None, but mix_palettes then passes its first
    palette on. Factor 0 takes the first layer, 1 the second.
    """
    if not steps:
        raise ValueError("the pipeline is empty")
    if required is not None and required not in palettes:
        raise ValueError(f"palette {required} is missing")
    known, image = {k: list(v) for k, v in palettes.items()}, None

    def layer(name: str | None) -> list[Column] | None:
        return known.get(name) if name else None

    for step in steps:
        if step.kind not in ("mix_palettes", "init", "lerp", "multiply"):
            raise ValueError(f"unknown step {step.kind!r}")
        if step.factor not in factors:
            continue
        f = factors[step.factor]
        if step.kind == "mix_palettes":
            a, b = layer(step.palette_a), layer(step.palette_b)
            if a is None or step.output is None or f is not None and b is None:
                raise ValueError(f"mix_palettes needs palettes and an output key: {step}")
            known[step.output] = list(a) if f is None else _mixed(a, b, f)  # type: ignore[arg-type]
        elif f is None:
            continue
        elif step.kind == "init":
            if image is not None:
                raise ValueError("the image is started twice")
            a, b = layer(step.palette_a), layer(step.target)
            if a is None or b is None or len(a) != len(b):
                raise ValueError(f"init needs two palettes of the same shape: {step}")
            image = _mixed(a, b, f)
        elif step.kind == "lerp":
            b = layer(step.target)
            if image is not None and b is not None and len(b) == len(image):
                image = _mixed(image, b, f)
        elif image is None:
            raise ValueError("multiply comes before init")
        else:
            image = [x * f for x in image[:3]] + image[3:]
    if image is None:
        raise ValueError("no step started the image")
    return [to_byte(x) for x in image]


def tree_line(elevation: Column | str, begins: float, ramp: float) -> Column:
    """0 up to an elevation, 1 from `ramp` above it on, straight between."""
    return clip((col(elevation) - begins) / ramp, 0.0, 1.0)


def biome_layer(pixels: DataFrame, humid: Sequence[str], arid: Sequence[str], steep: Sequence[str], precip: str | None = "precip", slope: str | None = "slope", tpi: str | None = None, precip_range: tuple[float, float] = (300.0, 900.0), slope_range: tuple[float, float] = (25.0, 45.0), tpi_bias: float = 0.0) -> DataFrame:
    """pixels with r, g, b: the humid ramp's color, mixed towards the arid one as precipitation falls and towards the steep one as slope rises.

    Both mixtures are smoothsteps over their ranges; TPI shifts precipitation by tpi_bias per unit.
    A parameter of None leaves its layer out.
    """
    image: list[Column] = [F.col(x) for x in humid]
    if precip is not None:
        wet = F.col(precip) + (F.col(tpi) * tpi_bias if tpi is not None else 0.0)
        image = _mixed(image, [F.col(x) for x in arid], 1.0 - smoothstep(*precip_range, wet))
    if slope is not None:
        image = _mixed(image, [F.col(x) for x in steep], smoothstep(*slope_range, F.col(slope)))
    return pixels.withColumns({name: to_byte(x) for name, x in zip("rgb", image, strict=True)})


def render_table(values: DataFrame, overrides: DataFrame, groups: DataFrame, palette: DataFrame, precip: Column | float, fallback: str = "Other") -> DataFrame:
    """VALUE, ColorGroup, r, g, b: a value's group by override, else by macrogroup, else the fallback; lush at full precipitation, arid at none.

    The three tables are dictionaries of land-cover classes; Spark broadcasts them as far as its own limit allows.
    """
    over = overrides.select(F.col("VALUE").alias("__v"), F.col("ColorGroup").alias("__by_value"))
    macro = groups.select(F.col("MACROGROUP").alias("__m"), F.col("ColorGroup").alias("__by_macro"))
    joined = values.join(over, F.col("VALUE") == F.col("__v"), "left").join(macro, F.col("MACROGROUP") == F.col("__m"), "left")
    named = joined.withColumn("__group", F.coalesce("__by_value", "__by_macro", F.lit(fallback))).drop("ColorGroup")
    p = num(precip)
    rgb = [to_byte(lerp(F.col(f"{c}_arid"), F.col(f"{c}_lush"), p)).alias(c.lower()) for c in "RGB"]
    return named.join(palette, F.col("__group") == F.col("ColorGroup"), "left").select("VALUE", F.col("__group").alias("ColorGroup"), *rgb)
