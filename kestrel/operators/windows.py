"""Ordered operators within groups.  Every order is total, so results do not depend on partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.operators import runs
from kestrel.operators.columns import c


def _order(order: Sequence[str | Column]) -> list[Column]:
    return [c(o) if isinstance(o, str) else o for o in order]


def _keys(keys: Sequence[str]) -> list[Column]:
    return [c(k) for k in keys]


def last_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per group and column the last non-null value in ``order``: an aggregation, with no sort."""
    at = F.struct(*_order(order))
    return df.groupBy(*_keys(keys)).agg(
        *(F.max_by(c(v), F.when(c(v).isNotNull(), at)).alias(v) for v in values)
    )


def first_known(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per group and column the first non-null value in ``order``."""
    at = F.struct(*_order(order))
    return df.groupBy(*_keys(keys)).agg(
        *(F.min_by(c(v), F.when(c(v).isNotNull(), at)).alias(v) for v in values)
    )


def keep_extreme(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The whole row that comes first in ``order`` of each group."""
    w = Window.partitionBy(*_keys(keys)).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def keep_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row that comes last in ``order`` of each group: max of a struct, so groups are pre-aggregated."""
    rest = [n for n in df.columns if n not in keys and n not in order]
    top = df.groupBy(*_keys(keys)).agg(
        F.max(F.struct(*_order(order), *(c(n) for n in rest))).alias("__top")
    )
    return top.select(*_keys(keys), "__top.*").select(*(c(n) for n in df.columns))


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*_keys(keys)).orderBy(*order)))


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    return ranked(df, keys, order, out).where(c(out) <= n)


def lagged(df: DataFrame, keys: Sequence[str], period: str, value: str, out: str, consecutive: bool, spread: bool = False) -> DataFrame:
    """Value of the group's row before; null if ``consecutive`` and a period lies between.

    ``spread`` is for groups of any size: each lies over as many tasks as it needs, at the cost of two written tables.
    """
    if spread:
        told = runs.lagged(df, keys, [period], {out: value, "__period": period})
        near = c(period) - F.col("__period") == 1
        return told.withColumn(out, F.when(near, c(out)) if consecutive else c(out)).drop("__period")
    w = Window.partitionBy(*_keys(keys)).orderBy(c(period))
    before = F.lag(c(value)).over(w)
    if consecutive:
        before = F.when(c(period) - F.lag(c(period)).over(w) == 1, before)
    return df.withColumn(out, before)


def delta(
    df: DataFrame, keys: Sequence[str], period: str, value: str, out: str, otherwise: float | None = 0.0, spread: bool = False
) -> DataFrame:
    """Change against the period just before; ``otherwise`` where there is none."""
    step = lagged(df, keys, period, value, "__before", True, spread)
    fallback = F.lit(otherwise).cast("double")
    return step.withColumn(out, F.coalesce(c(value) - F.col("__before"), fallback)).drop("__before")


def relative_delta(df: DataFrame, keys: Sequence[str], period: str, value: str, out: str) -> DataFrame:
    """Change in per cent of the value one period before; null where periods are not consecutive."""
    step = lagged(df, keys, period, value, "__before", True)
    share = (c(value) - F.col("__before")) / F.nullif(F.col("__before"), F.lit(0)) * 100
    return step.withColumn(out, share).drop("__before")


def chronic(df: DataFrame, keys: Sequence[str], period: str, value: str, above: float, out: str) -> DataFrame:
    """1 where this row and the group's row before both exceed ``above``."""
    w = Window.partitionBy(*_keys(keys)).orderBy(c(period))
    before = F.coalesce(F.lag(c(value)).over(w), F.lit(0))
    return df.withColumn(out, F.coalesce((c(value) > above) & (before > above), F.lit(False)).cast("int"))


def fill_in_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Nulls take the last known value before them in their group, else the first one after; a group may hold any share of the rows."""
    return runs.filled(df, keys, order, values)


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """value / sum of the group's values; 0 for a group that sums to nothing.

    The sums are aggregated before the shuffle and joined back, so that a group with a
    third of all rows is never gathered in one task.
    """
    sums = df.groupBy(*(c(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.sum(c(value)).alias("__sum"))
    on = [c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    joined = df.join(sums, on, "left")
    ratio = F.when(F.col("__sum") > 0, c(value) / F.nullif(F.col("__sum"), F.lit(0))).otherwise(F.lit(0.0))
    return joined.withColumn(out, ratio).drop("__sum", *(f"__k{i}" for i in range(len(keys))))


def base_100(df: DataFrame, keys: Sequence[str], period: str, value: str, out: str) -> DataFrame:
    """Value in per cent of the group's first value, and the period's rank in the group."""
    w = Window.partitionBy(*_keys(keys)).orderBy(c(period))
    first = F.first(c(value)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns(
        {out: c(value) / F.nullif(first, F.lit(0)) * 100, f"{period}_rank": F.row_number().over(w)}
    )


def in_large_groups(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows; counts are pre-aggregated, then joined."""
    sizes = df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    renamed = sizes.select(*(c(k).alias(f"__k{i}") for i, k in enumerate(keys)))
    on = [c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, on, "left_semi")


def duplicate_members(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once."""
    return in_large_groups(df, keys, 2)


def standings(
    results: DataFrame, league: Sequence[str], team: str, points: str, goal_diff: str, goals_for: str, out: str = "position"
) -> DataFrame:
    """Table position: points, goal difference, goals, then team name."""
    order = [c(points).desc(), c(goal_diff).desc(), c(goals_for).desc(), c(team).asc()]
    return ranked(results, league, order, out)


def match_points(matches: DataFrame, keys: Sequence[str], home: str, away: str, home_goals: str, away_goals: str) -> DataFrame:
    """Points, goals for and against per (keys, team): each match unpivoted into its two sides."""
    h, a = c(home_goals), c(away_goals)
    sides = F.array(
        F.struct(c(home).alias("team"), h.alias("scored"), a.alias("conceded")),
        F.struct(c(away).alias("team"), a.alias("scored"), h.alias("conceded")),
    )
    one = matches.select(*_keys(keys), F.explode(sides).alias("s")).select(*_keys(keys), "s.*")
    won = F.when(F.col("scored") > F.col("conceded"), 3).when(F.col("scored") == F.col("conceded"), 1).otherwise(0)
    return one.groupBy(*_keys(keys), "team").agg(
        F.sum(won).alias("points"),
        F.sum("scored").alias("goals_for"),
        F.sum("conceded").alias("goals_against"),
        (F.sum("scored") - F.sum("conceded")).alias("goal_diff"),
    )
