"""Null-safe arithmetic: every division states what a zero denominator gives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """num / den; null for a zero or null denominator."""
    return num / F.nullif(den, F.lit(0))


def ratio_or(num: Column, den: Column, otherwise: float = 0.0) -> Column:
    """num / den where den > 0, else a constant."""
    return F.when(den > 0, ratio(num, den)).otherwise(F.lit(otherwise))


def clip(x: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """x held within [low, high]; null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def half_even(x: Column, digits: int = 0) -> Column:
    return F.bround(x, digits)


def band(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the right-closed interval (edges[i], edges[i+1]] holding x; null outside."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label for each interval")
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(edges[:-1], edges[1:], labels, strict=True))):
        out = F.when((x > low) & (x <= high), label).otherwise(out)
    return out


def floor_bin(x: Column, width: float) -> Column:
    return F.floor(x / width) * width


def finite(x: Column) -> Column:
    """NaN and infinities become null, as for missing values at ingest."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def leading_int(x: Column) -> Column:
    """"23-328" -> 23; null where no digit leads."""
    return F.nullif(F.regexp_extract(x.cast("string"), r"^\s*(\d+)", 1), F.lit("")).try_cast("int")


def first_int(x: Column) -> Column:
    """"24 days" -> 24; null where there is no digit."""
    return F.nullif(F.regexp_extract(x.cast("string"), r"(\d+)", 1), F.lit("")).try_cast("int")
