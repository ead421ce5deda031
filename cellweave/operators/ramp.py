"""Color ramps: lines of `elevation r g b [alpha]` with comments and nv lines, as a table in line order."""

from __future__ import annotations

import os
from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.expr import adjust_hsv, clip, col, hex_channel, hsv_to_rgb, is_hex_color, lerp, num, rgb_to_hsv

SCHEMA = "line_no int, is_data boolean, elev double, elev_is_int boolean, r int, g int, b int, a int, raw string"
#: Elevations of the two stops of a ramp of one color.
STOPS = (-100, 10000)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, raw of a ramp file, read whole so that line numbers hold."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "raw")).select((F.col("line_no") + 1).cast("int").alias("line_no"), "raw")


def lines_frame(spark: SparkSession, text: str) -> DataFrame:
    rows = [(i, line) for i, line in enumerate(text.split("\n"), 1)]
    return spark.createDataFrame(rows, "line_no int, raw string")


def parse_ramp(lines: DataFrame, strict: bool = False) -> DataFrame:
    """The ramp's table. Blank lines are left out; comments and nv lines stay as they are.

    strict: a trailing comment is cut off, comments and nv lines are left out, and
    rows come in rising order of elevation by sort_ramp. A data line without 4 or 5
    fields, with a broken elevation or a color outside 0..255 fails the query.
    """
    text = F.trim(F.regexp_replace("raw", "[\t\r]", " "))
    if strict:
        text = F.trim(F.substring_index(text, "#", 1))
    kept = lines.select("line_no", "raw", text.alias("t")).where("t <> ''")
    is_data = ~(F.col("t").startswith("#") | F.lower("t").startswith("nv"))
    f = F.split("t", r"[,\s]+")
    fields = kept.select("line_no", "raw", is_data.alias("is_data"), F.when(is_data, f).alias("f"))

    def failing(what: str, kind: str) -> Column:
        return F.raise_error(F.concat(F.lit(f"line "), F.col("line_no").cast("string"), F.lit(f": {what}: "), F.col("raw"))).cast(kind)

    n = F.size("f")
    elev = F.when(F.col("is_data"), F.when(~n.isin(4, 5), failing("4 or 5 fields are needed", "double")).when(~F.element_at("f", 1).rlike(r"^[+-]?(\d+|\d+\.\d*|\.\d+)([eE][+-]?\d+)?$"), failing("bad elevation", "double")).otherwise(F.element_at("f", 1).cast("double")))

    def channel(i: int, optional: bool = False) -> Column:
        token = F.get("f", F.lit(i))
        value = F.when(~token.rlike(r"^\d{1,3}$"), failing("colors are integers in 0..255", "int")).when(token.cast("int") > 255, failing("colors are in 0..255", "int")).otherwise(token.cast("int"))
        return F.when(F.col("is_data") & (n > i if optional else F.lit(True)), value)

    table = fields.select("line_no", "is_data", elev.alias("elev"), F.when(F.col("is_data"), ~F.element_at("f", 1).contains(".")).alias("elev_is_int"), *(channel(i).alias(c) for i, c in ((1, "r"), (2, "g"), (3, "b"))), channel(4, True).alias("a"), F.when(~F.col("is_data"), F.col("raw")).alias("raw"))
    return table.where("is_data") if strict else table


def sort_ramp(ramp: DataFrame, descending: bool = False) -> DataFrame:
    """Data rows by elevation; of equal ones the earlier line comes first."""
    e = F.col("elev")
    return ramp.where("is_data").orderBy(e.desc() if descending else e.asc(), "line_no")


def shift_colors(ramp: DataFrame, **factors: Any) -> DataFrame:
    """The ramp with adjust_hsv applied to its colors; other lines and alpha stay."""
    h, s, v = rgb_to_hsv(*(F.col(c) / 255.0 for c in "rgb"))
    staged = ramp.withColumns({"__h": h, "__s": s, "__v": v})
    h, s, v = adjust_hsv(F.col("__h"), F.col("__s"), F.col("__v"), **factors)
    staged = staged.withColumns({"__h": h, "__s": s, "__v": v})
    new = [clip(F.rint(c * 255.0), 0.0, 255.0).cast("int") for c in hsv_to_rgb(F.col("__h"), F.col("__s"), F.col("__v"))]
    return staged.withColumns({c: F.when(F.col("is_data"), x) for c, x in zip("rgb", new, strict=True)}).drop("__h", "__s", "__v")


def scale_elevation(ramp: DataFrame, factor: float = 1.0) -> DataFrame:
    """Elevations times a factor; with 1 they stay as they are, integers included."""
    if factor == 1.0:
        return ramp
    return ramp.withColumns({"elev": F.col("elev") * float(factor), "elev_is_int": F.when(F.col("is_data"), F.lit(False))})


def adjust_color_file(ramp: DataFrame, saturation: float = 1.0, shadow_adjust: float = 0.0, mid_adjust: float = 0.0, highlight_adjust: float = 0.0, min_hue: float = 0.0, max_hue: float = 0.0, target_hue: float = 0.0, elev_adjust: float = 1.0) -> DataFrame:
    shifted = shift_colors(ramp, saturation=saturation, shadows=shadow_adjust, mids=mid_adjust, highlights=highlight_adjust, min_hue=min_hue, max_hue=max_hue, target_hue=target_hue)
    return scale_elevation(shifted, elev_adjust)


def line_text(ramp: DataFrame) -> DataFrame:
    """line_no, text: what the file's line reads. An alpha is written only where there is one."""
    elev = F.when(F.col("elev_is_int"), F.col("elev").cast("long").cast("string")).otherwise(F.col("elev").cast("string"))
    text = F.concat_ws(" ", elev, "r", "g", "b", "a")
    return ramp.select("line_no", F.when(F.col("is_data"), text).otherwise(F.col("raw")).alias("text"))


def write_ramp(ramp: DataFrame, path: str) -> None:
    """One text file, lines in order; a ramp is a small table by nature."""
    rows = line_text(ramp).orderBy("line_no").collect()
    with open(path, "w") as file:
        file.write("\n".join(r["text"] for r in rows))


def rgb_ramp(spark: SparkSession, color: str) -> DataFrame:
    """Two stops of one color RRGGBB."""
    given = spark.createDataFrame([(i, float(e), color) for i, e in enumerate(STOPS, 1)], "line_no int, elev double, hex string")
    bad = F.raise_error(F.concat(F.lit("not RRGGBB: "), F.col("hex"))).cast("int")
    channels = [F.when(is_hex_color(F.col("hex")), hex_channel(F.col("hex"), i)).otherwise(bad).alias(c) for i, c in enumerate("rgb")]
    return given.select("line_no", F.lit(True).alias("is_data"), "elev", F.lit(True).alias("elev_is_int"), *channels, F.lit(None).cast("int").alias("a"), F.lit(None).cast("string").alias("raw"))


def interpolate(ramp: DataFrame, row_ix: int) -> DataFrame:
    """A new stop before place row_ix of the ramp in falling order: the midpoint with the stop before, at place 0 the extension by the step to the next, and the same stop again if it is the only one."""
    line = Window.orderBy(F.col("elev").desc(), "line_no")  # a ramp is a small table by nature
    ranked = ramp.where("is_data").withColumn("ix", F.row_number().over(line) - 1)
    fields = ["elev", "r", "g", "b", "a"]
    pairs = ranked.select("ix", *fields, *(F.lag(c).over(line).alias(f"p_{c}") for c in fields), *(F.lead(c).over(line).alias(f"n_{c}") for c in fields))

    def value(name: str) -> Column:
        here, before, after = (F.col(x).cast("double") for x in (name, f"p_{name}", f"n_{name}"))
        made = F.when(before.isNotNull(), F.rint((here + before) / 2.0)).when(after.isNotNull(), F.rint(2.0 * here - after)).otherwise(here)
        return made if name == "elev" else clip(made, 0.0, 255.0).cast("int")

    return pairs.where(F.col("ix") == row_ix).select("ix", *(value(c).alias(c) for c in fields))


def update_line(ramp: DataFrame, row_ix: int, elev: float, colors: Iterable[int]) -> DataFrame:
    """The ramp with the stop at place row_ix (in falling order) replaced; rows elev, r, g, b, a in falling order by ix."""
    line = Window.orderBy(F.col("elev").desc(), "line_no")
    new = dict(zip(["r", "g", "b", "a"], colors, strict=False))
    here = F.col("ix") == row_ix
    ranked = ramp.where("is_data").withColumn("ix", F.row_number().over(line) - 1)
    return ranked.select("ix", F.when(here, F.lit(float(elev))).otherwise(F.col("elev")).alias("elev"), *(F.when(here, F.lit(new[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in "rgba"))


def color_relief(pixels: DataFrame, ramp: DataFrame, elevation: str = "elev", prefix: str = "", rounded: bool = True) -> DataFrame:
    """pixels with r, g, b: linear between the stops around the elevation, the end stops' colors outside, null without one.

    The stops become literal arrays. Their place is found by halving, a projection for
    each halving, so that the generated code grows with the logarithm of the stops: no
    join, no shuffle.
    """
    stops = [r.asDict() for r in ramp.where("is_data").select("elev", "r", "g", "b", "line_no").collect()]  # a ramp is a small table by nature
    stops.sort(key=lambda s: (s["elev"], s["line_no"]))
    if not stops:
        raise ValueError("the ramp has no stop")
    size = 1 << len(stops).bit_length()
    heights = F.array(*(F.lit(float(s["elev"])) for s in stops), *(F.lit(float("inf")) for _ in range(size - len(stops))))
    staged = pixels.withColumns({"__e": col(elevation).cast("double"), "__i": F.lit(0)})
    half = size >> 1
    while half:  # __i: how many stops are at most as high
        staged = staged.withColumn("__i", F.col("__i") + F.when((F.col("__e") >= F.element_at(heights, F.col("__i") + half)) & (F.col("__i") + half <= len(stops)), F.lit(half)).otherwise(F.lit(0)))
        half >>= 1
    at = lambda name, i: F.element_at(F.array(*(F.lit(float(s[name])) for s in stops)), i)
    low, high = F.greatest(F.col("__i"), F.lit(1)), F.least(F.col("__i") + 1, F.lit(len(stops)))
    staged = staged.withColumns({"__a": F.when(F.col("__e") <= stops[0]["elev"], F.lit(1)).otherwise(low), "__z": F.when(F.col("__e") <= stops[0]["elev"], F.lit(1)).otherwise(high)})
    staged = staged.withColumns({"__l": at("elev", F.col("__a")), "__h": at("elev", F.col("__z"))})
    staged = staged.withColumn("__t", F.when(F.col("__h") > F.col("__l"), (F.col("__e") - F.col("__l")) / (F.col("__h") - F.col("__l"))).when(F.col("__e").isNotNull(), F.lit(0.0)))
    for c in "rgb":
        staged = staged.withColumns({f"__a{c}": at(c, F.col("__a")), f"__z{c}": at(c, F.col("__z"))})
    value = {c: F.col(f"__a{c}") + (F.col(f"__z{c}") - F.col(f"__a{c}")) * F.col("__t") for c in "rgb"}
    out = staged.withColumns({f"{prefix}{c}": F.rint(v).cast("int") if rounded else v for c, v in value.items()})
    return out.drop("__e", "__i", "__a", "__z", "__l", "__h", "__t", *(f"__{x}{c}" for x in "az" for c in "rgb"))


def ramp_settings(config: dict, name: str) -> tuple[str, dict | None]:
    """Mode and settings of a ramp in a config with a RAMPS mapping."""
    ramps = (config or {}).get("RAMPS")
    if not isinstance(ramps, dict):
        raise ValueError("the config needs a mapping RAMPS")
    if name not in ramps:
        raise ValueError(f"no ramp {name!r}; there are {', '.join(map(str, ramps))}")
    one = ramps[name] or {}
    if not isinstance(one, dict):
        raise ValueError(f"ramp {name!r} must be a mapping")
    mode = one.get("mode")
    if mode == "dynamic":
        return mode, None
    if mode == "color":
        if not one.get("color"):
            raise ValueError(f"ramp {name!r} has no color")
        return mode, dict(one)
    if mode == "file":
        if not one.get("file"):
            raise ValueError(f"ramp {name!r} has no file")
        return mode, dict(one)
    if mode == "hsv":
        neutral = {"saturation": 1.0, "shadow-adjust": 0.0, "mid-adjust": 0.0, "highlight-adjust": 0.0, "min-hue": 0.0, "max-hue": 0.0, "target-hue": 0.0, "elev-adjust": 1.0}
        return mode, neutral | one
    raise ValueError(f"unknown ramp mode {mode!r}")


def ramp_from_config(spark: SparkSession, config: dict, name: str, base: DataFrame | None = None, folder: str = ".") -> tuple[str, DataFrame | None]:
    """Mode and table of a configured ramp; a dynamic one has no table."""
    mode, settings = ramp_settings(config, name)
    if mode == "dynamic" or settings is None:
        return mode, None
    if mode == "color":
        return mode, rgb_ramp(spark, str(settings["color"]))
    if mode == "file":
        return mode, parse_ramp(read_lines(spark, os.path.join(folder, settings["file"])))
    if base is None:
        raise FileNotFoundError("an hsv ramp needs a base ramp")
    return mode, adjust_color_file(base, **{k.replace("-", "_"): float(settings[k]) for k in ("saturation", "shadow-adjust", "mid-adjust", "highlight-adjust", "min-hue", "max-hue", "target-hue", "elev-adjust")})


def qml_lut(spark: SparkSession, xml: str, size: int = 256) -> DataFrame:
    """value, r, g, b, a for values 0..size-1 of a style's palette entries; others are black with alpha 0."""
    doc = spark.createDataFrame([(xml,)], "x string")
    path = "//paletteEntry/@"
    entries = doc.select(F.explode(F.arrays_zip(*(F.xpath("x", F.lit(f"{path}{a}")).alias(a) for a in ("value", "color", "alpha")))).alias("e")).select(F.col("e.value").cast("int").alias("value"), F.col("e.color").alias("hex"), F.col("e.alpha").cast("int").alias("a"))
    colored = entries.select("value", *(hex_channel(F.col("hex"), i).alias(c) for i, c in enumerate("rgb")), "a")
    values = spark.range(size).select(F.col("id").cast("int").alias("value"))
    return values.join(F.broadcast(colored), "value", "left").fillna(0, ["r", "g", "b", "a"])


def precip_mix(wet: Column | str, dry: Column | str, amount: Column | float) -> Column:
    """A color between its dry and wet form."""
    return lerp(col(dry), col(wet), num(amount))
