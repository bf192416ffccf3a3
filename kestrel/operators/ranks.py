"""Exact ranks and quantiles of columns of any size.

``percentile`` and unpartitioned windows hold all distinct values of a key in one task.
Here equal values are counted first (partial sums before the shuffle).  Up to ``ONE_TASK`` counts
are placed by a window per key; more are range-partitioned by key and value, and running sums
within each partition plus offsets (one row per partition) place every value in its key's order.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators.columns import c
from kestrel.storage import materialize


#: Distinct (key, value) pairs that may meet in one task.
ONE_TASK = 1 << 18


def counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """__k0.., __v, __n (rows), __lo (rows of the key below), __all (rows of the key) for every known value."""
    spark = df.sparkSession
    names = [f"__k{i}" for i in range(len(keys))]
    counts = (
        df.where(c(value).isNotNull())
        .groupBy(*(c(k).alias(n) for k, n in zip(keys, names, strict=True)), c(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    order = [*names, "__v"]
    counts, _ = materialize(counts, "counts")
    if counts.count() <= ONE_TASK:
        whole = Window.partitionBy(*names)
        below = F.sum("__n").over(whole.orderBy("__v")) - F.col("__n")
        return counts.select(*order, "__n", below.alias("__lo"), F.sum("__n").over(whole).alias("__all"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed, _ = materialize(counts.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "placed")
    # One row per partition reaches the driver and goes back as a constant array.
    sizes = dict(placed.groupBy("__p").agg(F.sum("__n")).collect())
    before = accumulate((sizes.get(p, 0) for p in range(parts)), initial=0)
    offsets = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    running = F.sum("__n").over(Window.partitionBy("__p").orderBy(*order)) - F.col("__n")
    ranked = placed.withColumn("__at", running).select(*order, "__n", (F.col("__at") + F.get(offsets, F.col("__p"))).alias("__at"))
    if not names:
        first = ranked.agg(F.min("__at").alias("__first"), F.sum("__n").alias("__all"))
        return ranked.join(F.broadcast(first)).select("__v", "__n", (F.col("__at") - F.col("__first")).alias("__lo"), "__all")  # one row
    # Written, so that the join reads no aggregate on this side and a hot key of the other can be split.
    first, _ = materialize(
        ranked.groupBy(*(F.col(x).alias(f"{x}_") for x in names)).agg(F.min("__at").alias("__first"), F.sum("__n").alias("__all")), "first"
    )
    same = [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in names]
    return ranked.join(first, same).select(*order, "__n", (F.col("__at") - F.col("__first")).alias("__lo"), "__all")


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], out: str = "__q") -> DataFrame:
    """``keys`` and an array of the exact quantiles ``at`` of ``value``, linear between neighbours; null without values.

    Of a key's values only those that hold one of the two places beside a quantile are grouped: two a quantile.
    A value finds its places among the ordered quantiles by halving.
    """
    ranked, ordered = counted(df, keys, value), sorted(map(float, at))
    shares, halves = F.lit(ordered), F.lit([1 << i for i in reversed(range(len(at).bit_length()))])
    exact = lambda i: F.get(shares, i) * (F.col("__all") - 1)

    def before(row: Column, near: Callable[[Column], Column]) -> Column:
        """How many of the places come before a row."""
        return F.aggregate(halves, F.lit(0), lambda n, h: F.when(near(exact(n + h - 1)) < row, n + h).otherwise(n))

    names = [f"__k{i}" for i in range(len(keys))]
    end = F.col("__lo") + F.col("__n")
    spans = {f"__{e}{k}": before(row, near) for k, near in enumerate((F.floor, F.ceil)) for e, row in (("a", F.col("__lo")), ("b", end))}
    held = ranked.withColumns(spans).where("__b0 > __a0 OR __b1 > __a1")
    points = F.concat(*(F.slice(F.lit([2 * i + k for i in range(len(at))]), F.col(f"__a{k}") + 1, F.col(f"__b{k}") - F.col(f"__a{k}")) for k in (0, 1)))
    beside = held.select(*names, "__all", F.col("__v").cast("double").alias("__x"), F.explode(points).alias("__j"))
    wide = beside.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("__j", "__x"))).alias("__beside"), F.max("__all").alias("__all"))

    def found(i: Column) -> Column:
        low, high = F.get("__beside", 2 * i)["__x"], F.get("__beside", 2 * i + 1)["__x"]
        part = exact(i) - F.floor(exact(i))
        return F.when(part == 0, low).otherwise((1 - part) * low + part * high)

    values = F.transform(F.lit([ordered.index(float(q)) for q in at]), found)
    return wide.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), values.alias(out))


def percent_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(rows of the key below) / (rows of the key - 1), as SQL's percent_rank; 0 in a key of one row.

    Null values come first, as one value; they are ranked within their key like any other.
    """
    work = df.withColumn("__none", c(value).isNull())
    nulls = work.groupBy(*(c(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.count_if(F.col("__none")).alias("__nulls"))
    ranked, _ = materialize(counted(df, keys, value), "ranks")
    nulls, _ = materialize(nulls, "nulls")
    k = [f"__k{i}" for i in range(len(keys))]
    ranked = ranked.withColumnsRenamed({n: f"{n}r" for n in k})
    on = [c(own).eqNullSafe(F.col(f"{n}r")) for own, n in zip(keys, k, strict=True)]
    joined = work.join(ranked, [*on, c(value) == F.col("__v")], "left")
    joined = joined.join(nulls, [c(own).eqNullSafe(F.col(n)) for own, n in zip(keys, k, strict=True)], "left")
    below = F.coalesce(F.col("__lo") + F.col("__nulls"), F.lit(0))
    rows = F.coalesce(F.col("__all"), F.lit(0)) + F.col("__nulls")
    share = F.coalesce(below / F.nullif(rows - 1, F.lit(0)), F.lit(0.0))
    return joined.withColumn(out, share).select(*(c(n) for n in df.columns), out)
