"""Column selection that tolerates schemas varying from source to source."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType


def c(name: str) -> Column:
    """A column by its literal name (names hold dots, slashes and blanks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def select_existing(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Those of ``names`` that exist, in the order given."""
    return df.select(*(c(n) for n in names if n in df.columns))


def with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [n for n in df.columns if n.startswith(prefix)]


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def textual(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def fill_by_type(df: DataFrame, number: float = 0, text: str = "Unknown") -> DataFrame:
    """Nulls of numeric columns become ``number``, of text columns ``text``."""
    return df.fillna(number, numeric(df)).fillna(text, textual(df))


def flags_to_int(df: DataFrame) -> DataFrame:
    flags = [f.name for f in df.schema if isinstance(f.dataType, BooleanType)]
    return df.withColumns({n: c(n).cast("int") for n in flags}) if flags else df


def join_levels(levels: Iterable[str | None], sep: str = "_") -> str:
    """One name out of several header levels; empty levels are left out."""
    return sep.join(x.strip() for x in levels if x and x.strip() and not x.startswith("Unnamed"))


def without_constant(df: DataFrame) -> DataFrame:
    """Numeric columns whose standard deviation is zero or undefined are dropped (one pass)."""
    names = numeric(df)
    if not names:
        return df
    row = df.agg(*(F.stddev_samp(c(n)).alias(f"s{i}") for i, n in enumerate(names))).first()
    return df.drop(*(n for i, n in enumerate(names) if not row[i]))


def null_counts(df: DataFrame, names: Iterable[str] | None = None) -> dict[str, int]:
    names = list(names or df.columns)
    row = df.agg(*(F.count_if(c(n).isNull()).alias(f"n{i}") for i, n in enumerate(names))).first()
    return {n: row[i] for i, n in enumerate(names)}


def complete_in(train: DataFrame, df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Columns of ``df`` without a null in ``train``."""
    nulls = null_counts(train)
    keep = set(keep)
    return df.select(*(c(n) for n in df.columns if n in keep or nulls.get(n, 1) == 0))


def prune_sparse(df: DataFrame, most_null: float, protect: Iterable[str] = ()) -> DataFrame:
    """Columns with a larger share of nulls than ``most_null`` go."""
    total, nulls, protect = df.count(), null_counts(df), set(protect)
    return df.select(*(c(n) for n in df.columns if n in protect or nulls[n] <= most_null * total))


def align(df: DataFrame, signature: Iterable[str], fill: float = 0.0) -> DataFrame:
    """Exactly the columns of a model's signature, in order; those missing hold ``fill``."""
    have = set(df.columns)
    return df.select(*(c(n) if n in have else F.lit(fill).alias(n) for n in signature))


def at_least_known(df: DataFrame, names: Iterable[str], least: int) -> DataFrame:
    """Rows with at least ``least`` non-null values among ``names``."""
    known = sum((c(n).isNotNull().cast("int") for n in names), F.lit(0))
    return df.where(known >= least)
