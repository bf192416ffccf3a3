"""Data-quality audits.  Each returns a DataFrame, one pass over its input."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.columns import c


def null_profile(df: DataFrame, names: Iterable[str] | None = None, digits: int = 4) -> DataFrame:
    """(column, nulls, pct) of every column, from one aggregation."""
    names = list(names or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("__rows"), *(F.count_if(c(n).isNull()).alias(f"__{i}") for i, n in enumerate(names)))
    rows = F.array(*(F.struct(F.lit(n).alias("column"), F.col(f"__{i}").alias("nulls")) for i, n in enumerate(names)))
    pct = F.round(F.col("nulls") * 100.0 / F.nullif(F.col("__rows"), F.lit(0)), digits)
    return one.select("__rows", F.inline(rows)).select("column", "nulls", pct.alias("pct"))


def completeness(df: DataFrame, most_null_pct: float = 20.0, digits: int = 4) -> DataFrame:
    """Share of known cells, over all columns and over those at most ``most_null_pct`` null."""
    p = null_profile(df, digits=10)
    kept = F.col("pct") <= most_null_pct
    return p.agg(
        F.round(100 - F.avg("pct"), digits).alias("before_pct"),
        F.round(100 - F.avg(F.when(kept, F.col("pct"))), digits).alias("after_pct"),
        F.count_if(~kept).alias("dropped_columns"),
    )


def null_share_by(df: DataFrame, keys: Sequence[str], names: Sequence[str], digits: int = 4) -> DataFrame:
    return df.groupBy(*(c(k) for k in keys)).agg(
        *(F.round(F.avg(c(n).isNull().cast("int")) * 100, digits).alias(f"{n}_null_pct") for n in names)
    )


def key_columns(df: DataFrame, wanted: Sequence[str], digits: int = 4) -> DataFrame:
    """(column, present, pct): whether key columns exist, and how much of them is missing."""
    have = [n for n in wanted if n in df.columns]
    rows = F.array(*(F.struct(F.lit(n).alias("column"), F.lit(n in have).alias("present")) for n in wanted))
    one = df.agg(*(F.round(F.avg(c(n).isNull().cast("int")) * 100, digits).alias(f"__{n}") for n in have), F.lit(1).alias("__one"))
    pct = F.lit(None).cast("double")
    for n in have:
        pct = F.when(F.col("column") == n, c(f"__{n}")).otherwise(pct)
    return one.select("*", F.inline(rows)).select("column", "present", pct.alias("pct"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys (nulls being one value) and surplus rows."""
    g = df.groupBy(*(c(k) for k in keys)).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus"),
    )


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Distinct non-null keys of ``child`` that ``parent`` lacks."""
    keys = child.select(c(child_key).alias("key")).where("key IS NOT NULL").distinct()
    return keys.join(parent.select(c(parent_key).alias("key")), "key", "left_anti")


def integrity(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Counts of keys on both sides, of those in both and of each side's rest."""
    a = child.select(c(child_key).alias("key"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    b = parent.select(c(parent_key).alias("key"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    seen = a.unionByName(b).where("key IS NOT NULL").groupBy("key").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return seen.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("child_keys"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("parent_keys"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("shared"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("orphans"),
        F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("unused"),
    )


def coherence(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, broken): rows for which a rule's condition of being wrong holds."""
    one = df.agg(*(F.count_if(F.coalesce(bad, F.lit(False))).alias(f"__{i}") for i, bad in enumerate(rules.values())))
    rows = F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"__{i}").alias("broken")) for i, n in enumerate(rules)))
    return one.select(F.inline(rows))


# How a match table may contradict itself.
def match_rules() -> dict[str, Column]:
    home, away, result = F.col("FTHG"), F.col("FTAG"), F.col("FTR")
    told = F.when(home > away, "H").when(home < away, "A").otherwise("D")
    return {
        "negative_score": (home < 0) | (away < 0),
        "result_against_goals": result != told,
        "odds_below_one": (F.col("B365H") < 1) | (F.col("B365D") < 1) | (F.col("B365A") < 1),
    }


def coverage(df: DataFrame, at: str) -> DataFrame:
    day = F.to_date(c(at))
    return df.agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.datediff(F.max(day), F.min(day)).alias("days"), F.count_distinct(day).alias("active_days"),
    )


def update_frequency(df: DataFrame, keys: Sequence[str], digits: int = 4) -> DataFrame:
    """How often a key is updated: median, mean, max, and shares with 1, 2 and 3 or more."""
    n = F.col("n")
    g = df.groupBy(*(c(k) for k in keys)).agg(F.count(F.lit(1)).alias("n"))
    share = lambda cond: F.round(F.avg(cond.cast("int")) * 100, digits)
    return g.agg(
        F.median("n").alias("median_n"), F.round(F.avg("n"), digits).alias("mean_n"), F.max("n").alias("max_n"),
        share(n == 1).alias("once_pct"), share(n == 2).alias("twice_pct"), share(n >= 3).alias("more_pct"),
    )
