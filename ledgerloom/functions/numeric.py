"""Small column functions with the numeric conventions that all operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(n: Column, d: Column, default: float | None = 0.0) -> Column:
    """``n / d`` where ``d`` is above zero, else ``default``."""
    return F.when(d > 0, n / d).otherwise(F.lit(default))


def tidy(c: Column | str, places: int) -> Column:
    """A column rounded, with a nudge far below the last place, so that exact halves don't depend on the order of summing."""
    value = F.col(c) if isinstance(c, str) else c
    return F.round(value + F.lit(10.0 ** -(places + 3)), places) + 0.0


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def logistic(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def seconds(c: Column) -> Column:
    """A timestamp of either kind as seconds since 1970 (double, exact to the microsecond)."""
    return F.unix_micros(c.cast("timestamp")) / F.lit(1_000_000.0)


def time_similarity(gap_s: Column, most_s: float) -> Column:
    """``exp(-gap / (most / 2.3))``, 0 beyond ``most_s``: 1 for the same moment, 0.1 at the limit."""
    return F.when(gap_s > most_s, 0.0).otherwise(F.exp(-gap_s / F.lit(most_s / 2.3)))


def amount_similarity(a: Column, b: Column) -> Column:
    """``1 / (1 + log10(larger / smaller))``, 0 where either isn't positive."""
    return F.when((a > 0) & (b > 0), 1 / (1 + F.log10(F.greatest(a, b) / F.least(a, b)))).otherwise(0.0)


def half_life(age_hours: Column, hours: float = 24.0) -> Column:
    """Weight of evidence of the given age: one half per ``hours``."""
    return F.pow(F.lit(0.5), age_hours / F.lit(hours))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of the same length; null if either has no direction or a hole."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms)


def wilson(successes: Column, n: Column, z: float = 1.959964) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; null where n is 0."""
    p = successes / F.nullif(n, F.lit(0))
    centre, spread = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    scale = 1 + z * z / n
    return F.when(n > 0, F.greatest((centre - spread) / scale, F.lit(0.0))), F.when(n > 0, F.least((centre + spread) / scale, F.lit(1.0)))


def cyclic(value: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a recurring quantity such as the hour of a day."""
    angle = value * F.lit(2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def is_base58(c: Column, low: int = 32, high: int = 44) -> Column:
    """Whether a string is base58 of an address's length; false for null."""
    return F.coalesce(c.rlike(f"^[1-9A-HJ-NP-Za-km-z]{{{low},{high}}}\\z"), F.lit(False))


def brief(c: Column) -> Column:
    """1234 as 1.2K, 5600000 as 5.6M, and so on."""
    size = F.abs(c)
    forms = [(1e9, "B"), (1e6, "M"), (1e3, "K")]
    out = F.format_string("%.1f", c)
    for unit, letter in reversed(forms):
        out = F.when(size >= unit, F.format_string(f"%.1f{letter}", c / unit)).otherwise(out)
    return out


def hash31(text: Column) -> Column:
    """A number below 2 ** 31 from the MD5 of a text, which any engine can repeat."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % (1 << 31)
