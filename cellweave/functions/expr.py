"""Column expressions that the raster operators are built from.

All of them stay inside whole-stage code generation. Rounding is half to even.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float | int


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def num(x: Number | str) -> Column:
    """A column as it is, a name as a column, a number as a literal."""
    if isinstance(x, str):
        return F.col(x)
    return x if isinstance(x, Column) else F.lit(x)


def clip(x: Column, low: Number, high: Number) -> Column:
    """Null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, num(low)), num(high)))


def to_byte(x: Column) -> Column:
    """Rounded half to even into 0..255, as an int."""
    return clip(F.rint(x), 0.0, 255.0).cast("int")


def wrap_byte(x: Column) -> Column:
    """What an unchecked conversion to an unsigned byte gives: the value modulo 256."""
    return F.pmod(x.cast("long"), F.lit(256)).cast("int")


def lerp(a: Number, b: Number, t: Column) -> Column:
    a, b = num(a), num(b)
    return a + (b - a) * t


def smoothstep(low: float, high: float, x: Column) -> Column:
    """0 below low, 1 above high, t*t*(3-2t) between; 0 everywhere if they are equal."""
    if low == high:
        return F.lit(0.0)
    t = clip((x - low) / (high - low), 0.0, 1.0)
    return t * t * (3.0 - t * 2.0)


def hex_channel(text: Column, channel: int) -> Column:
    """Channel 0..2 of RRGGBB with or without a leading #."""
    bare = F.regexp_replace(text, "^#+", "")
    return F.conv(F.substring(bare, 1 + 2 * channel, 2), 16, 10).cast("int")


def is_hex_color(text: Column) -> Column:
    return F.regexp_replace(text, "^#+", "").rlike("^[0-9A-Fa-f]{6}$")


def rgb_to_hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation and value of channels in 0..1, all in 0..1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = top - low
    sector = F.when(r == top, (g - b) / span).when(g == top, 2.0 + (b - r) / span).otherwise(4.0 + (r - g) / span)
    grey = span == 0
    return F.when(grey, 0.0).otherwise(F.pmod(sector / 6.0, F.lit(1.0))), F.when(grey, 0.0).otherwise(span / top), top


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Each channel is v less s times a trapezoid of the hue, shifted by a third of the wheel."""

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h * 6.0, F.lit(6.0))
        return v - v * s * F.greatest(F.lit(0.0), F.least(k, 4.0 - k, F.lit(1.0)))

    return channel(5), channel(3), channel(1)


def adjust_hsv(h: Column, s: Column, v: Column, saturation: Number = 1.0, shadows: Number = 0.0, mids: Number = 0.0, highlights: Number = 0.0, min_hue: Number = 0.0, max_hue: Number = 0.0, target_hue: Number = 0.0) -> tuple[Column, Column, Column]:
    """Weighted brightness shift, hue pull towards a target with cosine falloff over a hue range in degrees, saturation factor."""
    shadows, mids, highlights, saturation = map(num, (shadows, mids, highlights, saturation))
    low, high, target = (num(x) / 360.0 for x in (min_hue, max_hue, target_hue))
    dark, light = F.greatest(F.lit(0.0), 1.0 - v * 2.0), F.greatest(F.lit(0.0), (v - 0.5) * 2.0)
    value = clip(v + (dark * shadows + (1.0 - dark - light) * mids + light * highlights), 0.0, 1.0)
    neutral = (1.0 - F.abs((v - 0.5) * 2.0)) * F.least(F.lit(1.0), s * 4.0)
    plain = low <= high
    inside = F.when(plain, (h >= low) & (h <= high)).otherwise((h >= low) | (h <= high)) & (low != high)
    width = F.when(plain, high - low).otherwise((1.0 - low) + high)
    centre = F.when(plain, low + width / 2.0).otherwise(F.pmod(low + width / 2.0, F.lit(1.0)))
    away = F.abs(h - centre)
    away = F.when(away > 0.5, 1.0 - away).otherwise(away)
    weight = F.when(width > 0, F.cos(away / (width / 2.0) * (math.pi / 2))).otherwise(1.0)
    turn = target - h
    turn = F.when(turn > 0.5, turn - 1.0).when(turn < -0.5, turn + 1.0).otherwise(turn)
    hue = F.when(inside, F.pmod(h + turn * neutral * weight, F.lit(1.0))).otherwise(h)
    return hue, clip(s * saturation, 0.0, 1.0), value


def shorten(text: Column, limit: int = 400) -> Column:
    """Long text with its middle cut out: the first and last two fifths of the limit stay."""
    keep = int(limit * 0.4)
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(keep)), F.lit(" ... "), F.right(text, F.lit(keep))))
