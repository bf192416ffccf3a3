"""Row splits and filters with bounds learned on training rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.columns import c
from kestrel.operators.ranks import quantiles

# Seasons of the temporal split.
SEASON_SPLIT = {"train": (2020, 2021, 2022), "validation": (2023,), "test": (2024,), "in_progress": (2025,)}


def temporal(df: DataFrame, period: str, parts: Mapping[str, Sequence[int]] = SEASON_SPLIT, out: str = "split") -> DataFrame:
    """``split`` names the part that a row's period belongs to; null if none."""
    name = F.lit(None).cast("string")
    for part, periods in parts.items():
        name = F.when(c(period).isin(*periods), part).otherwise(name)
    return df.withColumn(out, name)


def hashed(df: DataFrame, key: Sequence[str], shares: Mapping[str, float], seed: int = 1308, out: str = "split") -> DataFrame:
    """A random split that depends on a row's key alone, not on partitions or order: the MD5 of "seed|key|..." as a share of its range."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(c(k).cast("string"), F.lit("\x00")) for k in key))
    u = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
    names, total = list(shares), 0.0
    name = F.lit(names[-1])
    edges = []
    for part in names[:-1]:
        total += shares[part]
        edges.append((part, total))
    for part, edge in reversed(edges):
        name = F.when(u < edge, part).otherwise(name)
    return df.withColumn(out, name)


def iqr_limit(train: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    """One row: Q3 + factor * IQR."""
    q = F.col("__q")
    return quantiles(train, [], value, [0.25, 0.75]).select((q[1] + factor * (q[1] - q[0])).alias("__limit"))


def below_limit(df: DataFrame, train: DataFrame, value: str, factor: float = 1.5) -> DataFrame:
    """Rows at most at the limit learned on ``train``."""
    return df.join(F.broadcast(iqr_limit(train, value, factor)), c(value) <= F.col("__limit")).drop("__limit")  # one row


def clip_quantiles(df: DataFrame, train: DataFrame, value: str, low: float, high: float, out: str) -> DataFrame:
    """Values held within two exact quantiles of ``train``."""
    q = quantiles(train, [], value, [low, high])
    clipped = F.when(c(value).isNotNull(), F.least(F.greatest(c(value), F.col("__q")[0]), F.col("__q")[1]))
    return df.join(F.broadcast(q)).withColumn(out, clipped).drop("__q")  # one row


def sample(df: DataFrame, key: Sequence[str], n: int, seed: int = 1308) -> DataFrame:
    """``n`` rows chosen by a hash of their key: the same rows however the data lie."""
    return df.orderBy(F.xxhash64(F.lit(seed), *(c(k) for k in key)), *(c(k) for k in key)).limit(n)


def elite(df: DataFrame, value: str, threshold: Column | float, out: str = "group") -> DataFrame:
    return df.withColumn(out, F.when(c(value) >= threshold, "elite").otherwise("rest"))


def by_position(df: DataFrame, position: str, keeper: str = "GK") -> tuple[DataFrame, DataFrame]:
    """(goalkeepers, outfield); an unknown position is outfield."""
    gk = F.coalesce(F.contains(c(position), F.lit(keeper)), F.lit(False))
    return df.where(gk), df.where(~gk)
