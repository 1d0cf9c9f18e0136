"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    """part / whole as double; null, never 0, where whole is 0 or null."""
    return F.when(whole != 0, part.cast("double") / whole.cast("double"))


def half_even(x: Column, places: int = 2, precision: int = 38) -> Column:
    """Exact decimal rounding, halves to the even digit."""
    return F.bround(x.cast(f"decimal({precision},10)"), places).cast(f"decimal(18,{places})")


def finite(x: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    y = x.cast("double")
    return F.coalesce(~F.isnan(y) & (F.abs(y) != float("inf")), F.lit(False))


def positive(x: Column) -> Column:
    """x where it is a finite number over zero, else null."""
    return F.when(finite(x) & (x > 0), x)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two equally long arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Rec. 709 luminance of components from 0 to 1."""
    return 0.2126 * r + 0.7152 * g + 0.0722 * b


def clamp_luminance(r: Column, g: Column, b: Column, target: float) -> Column:
    """Components scaled down so that their luminance is at most target."""
    lum = luminance(r, g, b)
    k = F.when(lum > target, F.lit(target) / lum).otherwise(1.0)
    return F.struct((r * k).alias("r"), (g * k).alias("g"), (b * k).alias("b"))


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of components from 0 to 1."""
    part = lambda x: F.lower(F.lpad(F.hex(F.bround(x * 255, 0).cast("int")), 2, "0"))
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def foreground(r: Column, g: Column, b: Column, cut: float = 0.5) -> Column:
    """Black on bright, white on dark."""
    return F.when(luminance(r, g, b) > cut, "#000000").otherwise("#ffffff")
