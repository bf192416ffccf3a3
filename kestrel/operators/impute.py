"""Imputation learned on training rows only.

What is learned is a table of medians per key, joined by its keys: Spark broadcasts
it when it is small by its own size check, and shuffles it otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.columns import c
from kestrel.operators.ranks import quantiles
from kestrel.storage import materialize


def learn_medians(train: DataFrame, keys: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """Median of ``value`` per key (known keys and at least ``least`` known values)."""
    known = train.where(c(value).isNotNull())
    for k in keys:
        known = known.where(c(k).isNotNull())
    medians = quantiles(known, keys, value, [0.5]).select(*(c(k) for k in keys), F.col("__q")[0].alias("__m"))
    if least <= 1 or not keys:
        return medians
    enough = known.groupBy(*(c(k) for k in keys)).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    return medians.join(enough, list(keys))


def _look_up(df: DataFrame, table: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    t = table.select(*(c(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col("__m").alias(out))
    if not keys:
        return df.join(F.broadcast(t))  # one row: a global median
    on = [c(k) == F.col(f"__k{i}") for i, k in enumerate(keys)]
    return df.join(t, on, "left").drop(*(f"__k{i}" for i in range(len(keys))))


def hierarchical(
    df: DataFrame, train: DataFrame, value: str, levels: Sequence[Sequence[str]], default: float = 0.0,
    out: str | None = None, where: Column | None = None,
) -> DataFrame:
    """Nulls (and rows where ``where`` holds) take the median of the first level that knows one, else ``default``.

    Levels run from the finest key to the coarsest; ``()`` is the global median.
    """
    known = c(value) if where is None else F.when(~F.coalesce(where, F.lit(False)), c(value))
    work, names = df.withColumn("__known", known), []
    clean = train if where is None else train.where(~F.coalesce(where, F.lit(False)))
    if len(levels) > 1:  # each level reads the few columns it needs, not what they are made of
        narrow = list(dict.fromkeys((*(k for keys in levels for k in keys), value)))
        clean, _ = materialize(clean.where(c(value).isNotNull()).select(*(c(n) for n in narrow)), "train")

    def learn(keys: Sequence[str]) -> DataFrame:
        # Written, so that both sides of the look-up are read tables and a hot key can be split.
        return materialize(learn_medians(clean, keys, value), "medians")[0]

    # The levels do not depend on each other: their small jobs run side by side.
    with ThreadPoolExecutor(max(len(levels), 1)) as pool:
        tables = list(pool.map(inheritable_thread_target(df.sparkSession)(learn), levels))
    for i, (keys, table) in enumerate(zip(levels, tables, strict=True)):
        work = _look_up(work, table, keys, f"__l{i}")
        names.append(f"__l{i}")
    filled = F.coalesce(F.col("__known"), *(F.col(n) for n in names), F.lit(default))
    return work.withColumn(out or value, filled).drop("__known", *names)


def replace_outliers(
    df: DataFrame, train: DataFrame, value: str, low: float, high: float, keys: Sequence[str], out: str | None = None
) -> DataFrame:
    """Values outside [low, high] take the median of their key's plausible values in ``train``."""
    return hierarchical(
        df, train, value, [keys, ()], default=0.0, out=out, where=(c(value) < low) | (c(value) > high)
    )


def zero_fill(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.fillna(0, [n for n in names if n in df.columns])
