"""Exact integer arithmetic for displayed percentages and averages (ties go to the even digit)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_half_even(num: Column, den: Column, scale: int) -> Column:
    """round_half_even(num * scale / den) as BIGINT; 0 for an empty denominator."""
    n = num.cast("bigint") * F.lit(scale)
    d = F.nullif(den.cast("bigint"), F.lit(0).cast("bigint"))
    rest = F.pmod(n, d)
    q = ((n - rest) / d).cast("bigint")
    up = (rest * 2 > d) | ((rest * 2 == d) & (F.pmod(q, F.lit(2)) == 1))
    return F.coalesce(q + up.cast("bigint"), F.lit(0).cast("bigint"))


def percent_tenths(num: Column, den: Column) -> Column:
    """``66.7%``"""
    t = ratio_half_even(num, den, 1000)
    whole = F.floor(t / 10).cast("string")
    return F.concat(whole, F.lit("."), F.pmod(t, F.lit(10)).cast("string"), F.lit("%"))


def percent_whole(num: Column, den: Column) -> Column:
    """``67%``"""
    return F.concat(ratio_half_even(num, den, 100).cast("string"), F.lit("%"))


def percent_floor(num: Column, den: Column) -> Column:
    """Truncated whole percent as BIGINT; 0 for an empty denominator."""
    d = F.nullif(den.cast("bigint"), F.lit(0).cast("bigint"))
    return F.coalesce(F.floor(num.cast("bigint") * 100 / d).cast("bigint"), F.lit(0).cast("bigint"))


def mean_tenths(num: Column, den: Column) -> Column:
    """Average rounded to one decimal, as DOUBLE."""
    return ratio_half_even(num, den, 10) / F.lit(10.0)
