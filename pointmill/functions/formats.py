"""Column functions that put figures in words, and the same for single figures."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import js_round


def format_count(n: Column) -> Column:
    """123, 12K, 1.2M (12M where it is a whole number of millions)."""
    whole = n % 1_000_000 == 0
    millions = F.when(whole, (n / 1_000_000).cast("bigint").cast("string")).otherwise(F.format_string("%.1f", n / 1e6))
    thousands = F.concat(js_round(n / 1e3).cast("bigint").cast("string"), F.lit("K"))
    return F.when(n >= 1_000_000, F.concat(millions, F.lit("M"))).when(n >= 1_000, thousands).otherwise(n.cast("bigint").cast("string"))


def format_share(n: Column, total: Column) -> Column:
    """A share in per cent: whole from ten on, to a tenth from one on."""
    p = n * 100.0 / total
    whole = F.concat(js_round(p).cast("bigint").cast("string"), F.lit("%"))
    return F.when(p >= 10, whole).when(p >= 1, F.format_string("%.1f%%", p)).when(p > 0, "<1%").otherwise("0%")


def _grouped(v: Column, unit: str) -> Column:
    return F.concat(F.when(v < 100, F.format_string("%.1f", v.cast("double"))).otherwise(F.format_number(js_round(v.cast("double")), 0)), F.lit(f" {unit}"))


def format_area(v: Column) -> Column:
    """Square metres: to a tenth under a hundred, else whole with thousands grouped."""
    return _grouped(v, "m²")


def format_volume(v: Column) -> Column:
    return _grouped(v, "m³")


def format_length(v: Column) -> Column:
    return F.concat(F.format_number(v.cast("double"), 2), F.lit(" m"))


def format_height(v: Column) -> Column:
    """To a tenth below ten metres, else whole."""
    return F.concat(F.when(v < 10, F.format_string("%.1f", v.cast("double"))).otherwise(js_round(v.cast("double")).cast("bigint").cast("string")), F.lit(" m"))


def ordinal_suffix(n: Column) -> Column:
    last = n % 10
    suffix = F.when(last == 1, "st").when(last == 2, "nd").when(last == 3, "rd").otherwise("th")
    return F.when((n % 100).between(11, 13), "th").otherwise(suffix)


def _half_up(v: float) -> int:
    return math.floor(v + 0.5)


def count_text(n: int) -> str:
    """One figure as :func:`format_count` puts it."""
    if n >= 1_000_000:
        return f"{n // 1_000_000 if n % 1_000_000 == 0 else f'{n / 1e6:.1f}'}M"
    return f"{_half_up(n / 1e3)}K" if n >= 1_000 else str(n)


def share_text(n: float, total: float) -> str:
    p = 100 * n / total if total else 0.0
    return f"{_half_up(p)}%" if p >= 10 else f"{p:.1f}%" if p >= 1 else "<1%" if p > 0 else "0%"


def height_text(v: float) -> str:
    return f"{v:.1f} m" if v < 10 else f"{_half_up(v)} m"


def area_text(v: float) -> str:
    return f"{v:.1f} m²" if v < 100 else f"{_half_up(v):,} m²"
