"""Aggregations: rule-driven merging, families, profiles, cross-tabs, descriptions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.numbers import ratio
from kestrel.functions.text import contains_any
from kestrel.operators.columns import c, numeric
from kestrel.operators.ranks import quantiles

# Parts of column names that decide how duplicates are merged.
LAST_PARTS = (
    "born", "market_value", "value_in_eur", "season_year", "dob_key", "tm_id", "player_id",
    "valuation_season_year", "tm_dob_key",
)
MEAN_PARTS = (
    "pct", "%", "rate", "accuracy", "/90", "per 90", "playing time_mn/mp", "starts_mn/starts", "/starts", "subs_mn/subs",
)

# Injury families and the words that tell them.
INJURY_FAMILIES = {
    "musculaire": [
        "muscular", "hamstring", "ischio", "thigh", "cuisse", "tear", "strain", "adductor", "groin", "fibre",
    ],
    "genou": ["knee", "genou", "cruciate", "ligament", "croisé", "meniscus", "ménisque", "patella"],
    "cheville_pied": ["ankle", "cheville", "foot", "pied", "sprain", "entorse", "malleolus", "achilles"],
    "mollet_tibia": ["calf", "mollet", "shin", "tibia", "fibula"],
    "dos_bassin": ["back", "dos", "lumbar", "lombaire", "vertebra", "pubalgie", "pelvis", "spine"],
    "trauma_severe": ["fracture", "broken", "surgery", "opération", "concussion", "trauma"],
    "medical_repos": [
        "corona", "illness", "maladie", "cold", "grippe", "influenza", "infection", "appendicitis", "rest", "repos",
    ],
}

# Ratios recomputed after a merge, as (numerator, denominator, factor).
MERGED_RATIOS = {
    "Per 90 Minutes_Gls": ("Performance_Gls", "Playing Time_90s", 1.0),
    "Per 90 Minutes_Ast": ("Performance_Ast", "Playing Time_90s", 1.0),
    "Per 90 Minutes_G+A": ("Performance_G+A", "Playing Time_90s", 1.0),
    "Standard_G/Sh": ("Standard_Gls", "Standard_Sh", 1.0),
    "Standard_G/SoT": ("Standard_Gls", "Standard_SoT", 1.0),
    "Standard_SoT%": ("Standard_SoT", "Standard_Sh", 100.0),
    "Standard_Sh/90": ("Standard_Sh", "Playing Time_90s", 1.0),
    "Standard_SoT/90": ("Standard_SoT", "Playing Time_90s", 1.0),
    "Playing Time_Mn/MP": ("Playing Time_Min", "Playing Time_MP", 1.0),
    "Playing Time_Min%": ("Playing Time_Min", "Playing Time_MP", 100.0 / 90.0),
}


def merge_rule(name: str, is_numeric: bool, overrides: Mapping[str, str] | None = None) -> str:
    """last, mean or sum - from the column's name and type unless overridden."""
    if overrides and name in overrides:
        return overrides[name]
    low = name.lower().strip()
    if any(part in low for part in LAST_PARTS):
        return "last"
    if any(part in low for part in MEAN_PARTS):
        return "mean"
    return "sum" if is_numeric else "last"


def merge_duplicates(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], overrides: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per key: sums, means and last known values, by column name.

    ``overrides`` names columns for which the rule would be wrong (a height is not
    additive).  A sum of nothing but nulls is null.
    """
    numbers, at = set(numeric(df)), F.struct(*(c(o) for o in order))
    aggs = []
    for name in df.columns:
        if name in keys:
            continue
        rule = merge_rule(name, name in numbers, overrides)
        if rule == "last":
            out = F.max_by(c(name), F.when(c(name).isNotNull(), at))
        elif rule == "mean":
            out = F.avg(c(name))
        else:
            out = F.sum(c(name))
        aggs.append(out.alias(name))
    return df.groupBy(*(c(k) for k in keys)).agg(*aggs)


def recompute_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str, float]] = MERGED_RATIOS) -> DataFrame:
    """Ratios from their merged parts, where all of them exist."""
    have = set(df.columns)
    new = {
        out: F.round(ratio(c(num), c(den)) * factor, 4)
        for out, (num, den, factor) in ratios.items()
        if {out, num, den} <= have
    }
    return df.withColumns(new) if new else df


def families(
    df: DataFrame, keys: Sequence[str], text: str, amount: Column, peak: Column, table: Mapping[str, list[str]],
    rest: str = "minor_unknown", exclusive: bool = False,
) -> DataFrame:
    """Per key: rows, total amount, largest peak - overall and per keyword family, with a flag each.

    A row may belong to several families; with ``exclusive`` it belongs to the first.
    Rows of no family count under ``rest``.
    """
    masks: dict[str, Column] = {}
    taken = F.lit(False)
    for name, words in table.items():
        hit = contains_any(c(text), words)
        masks[name] = hit & ~taken if exclusive else hit
        taken = taken | hit
    masks[rest] = ~taken
    aggs = [F.count(c(text)).alias("nb_total"), F.sum(amount).alias("amount_total"), F.max(peak).alias("peak_max")]
    for name, mask in masks.items():
        aggs += [
            F.count_if(mask).alias(f"{name}_nb"),
            F.sum(F.when(mask, amount).otherwise(0)).alias(f"{name}_amount"),
            F.max(F.when(mask, peak).otherwise(0)).alias(f"{name}_peak"),
            F.max(mask.cast("int")).alias(name),
        ]
    return df.groupBy(*(c(k) for k in keys)).agg(*aggs)


def value_counts(df: DataFrame, name: str, digits: int = 4) -> DataFrame:
    """(value, n, share in per cent).  Shares divide by a total, computed as one more aggregation of the counts."""
    counts = df.groupBy(c(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    return counts.join(F.broadcast(total)).select(  # one row
        "value", "n", F.round(F.col("n") * 100.0 / F.col("__total"), digits).alias("pct")
    )


def describe(df: DataFrame, names: Iterable[str], digits: int = 4) -> DataFrame:
    """One row per column: count, mean, std, min, exact quartiles, max."""
    long = stacked(df, names)
    r = lambda x: F.round(x, digits)
    plain = long.groupBy("column").agg(
        F.count("value").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    q = quantiles(long, ["column"], "value", [0.25, 0.5, 0.75])
    q = q.select("column", *(r(F.col("__q")[i]).alias(n) for i, n in enumerate(("q1", "median", "q3"))))
    return plain.join(q, "column", "left").select("column", "n", "mean", "std", "min", "q1", "median", "q3", "max")


def stacked(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """(column, value): the named columns of every row, one below the other, as doubles."""
    pairs = F.array(*(F.struct(F.lit(n).alias("column"), c(n).cast("double").alias("value")) for n in names))
    return df.select(F.inline(pairs))


def crosstab(df: DataFrame, row: str, column: str, values: Sequence, agg: Column | None = None, fill: float | None = 0) -> DataFrame:
    """Counts (or ``agg``) of ``row`` by the listed values of ``column``; listing them saves a pass over the data."""
    g = df.groupBy(c(row)).pivot(column, list(values))
    out = g.agg(F.count(F.lit(1)) if agg is None else agg)
    return out if fill is None else out.fillna(fill)


def rows_by_median(cells: DataFrame, keys: Sequence[str], values: Sequence[str], out: str) -> DataFrame:
    """Rows of a heatmap numbered by the median of their cells, highest first, ties by key.

    A heatmap has a row for each category, so one task may order them.
    """
    ordered, n = F.array_sort(F.array(*(c(v) for v in values))), len(values)
    middle = (F.element_at(ordered, (n + 1) // 2) + F.element_at(ordered, n // 2 + 1)) / 2
    return cells.withColumn(out, F.row_number().over(Window.orderBy(middle.desc(), *(c(k) for k in keys))))


def median_by(df: DataFrame, keys: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per key, null for a key without values; no task holds a key's values."""
    found = quantiles(df, keys, value, [0.5]).select(*(c(k) for k in keys), F.col("__q")[0].alias(out))
    every = df.select(*(c(k) for k in keys), F.lit(None).cast("double").alias(out)).distinct()
    return found.unionByName(every).groupBy(*(c(k) for k in keys)).agg(F.max(c(out)).alias(out))


def median_pivot(df: DataFrame, row: str, column: str, values: Sequence, value: str, fill: float | None = 0) -> DataFrame:
    """Cross-tab of exact medians."""
    return crosstab(median_by(df, [row, column], value, "__median"), row, column, values, F.max("__median"), fill)


def min_max(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(x - min) / (max - min + 1e-9) for each column, over all rows (an aggregate of two scalars a column)."""
    bounds = df.agg(
        *(F.min(c(n)).alias(f"__lo{i}") for i, n in enumerate(names)),
        *(F.max(c(n)).alias(f"__hi{i}") for i, n in enumerate(names)),
    )
    wide = df.join(F.broadcast(bounds))  # one row
    scaled = {
        f"{n}_nor": (c(n) - F.col(f"__lo{i}")) / (F.col(f"__hi{i}") - F.col(f"__lo{i}") + F.lit(1e-9))
        for i, n in enumerate(names)
    }
    return wide.withColumns(scaled).drop(*(f"__{e}{i}" for i in range(len(names)) for e in ("lo", "hi")))


def target_correlations(df: DataFrame, names: Sequence[str], target: str, n: int | None = None, digits: int = 6) -> DataFrame:
    """(feature, r): Pearson of each column with the target, strongest first by absolute value; the first ``n``."""
    one = df.agg(*(F.corr(c(x).cast("double"), c(target).cast("double")).alias(f"__{i}") for i, x in enumerate(names)))
    rows = F.array(*(F.struct(F.lit(x).alias("feature"), F.round(F.col(f"__{i}"), digits).alias("r")) for i, x in enumerate(names)))
    # One row a column of the table.
    ranked = one.select(F.inline(rows)).where("r IS NOT NULL").orderBy(F.abs("r").desc(), "feature")
    return ranked if n is None else ranked.limit(n)


def noise_reduction(df: DataFrame, by: str, value: str, threshold: float, width: float = 100, digits: int = 4) -> DataFrame:
    """One row: deviation of ``value`` below and from ``threshold`` of ``by``, and the reduction in per cent."""
    low, high = F.stddev_samp(F.when(c(by) < threshold, c(value))), F.stddev_samp(F.when(c(by) >= threshold, c(value)))
    return df.agg(
        F.round(low, digits).alias("std_below"), F.round(high, digits).alias("std_from"),
        F.round((1 - high / F.nullif(low, F.lit(0))) * 100, digits).alias("reduction_pct"),
    )


def correlations(df: DataFrame, names: Sequence[str], digits: int = 6) -> DataFrame:
    """(a, b, r): Pearson over rows where both are known, every pair in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    one = df.agg(*(F.corr(c(a).cast("double"), c(b).cast("double")).alias(f"__{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(
        *(
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"__{i}"), digits).alias("r"))
            for i, (a, b) in enumerate(pairs)
        )
    )
    return one.select(F.inline(rows))


def modes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row: the most frequent known value of every column, the smallest of ties; null for a column without values.

    Values are counted first, all columns in one pass over one row per column and value, and only then
    compared, so no task holds a column's values.
    """
    kinds = {n: df.select(c(n)).schema[0].dataType for n in names}
    fields = [f"__v{j}" for j in range(len(names))]
    own = lambda i: [(c(n) if j == i else F.lit(None).cast(kinds[n])).alias(f) for j, (n, f) in enumerate(zip(names, fields, strict=True))]
    rows = df.select(F.inline(F.array(*(F.struct(F.lit(i).alias("__at"), *own(i)) for i in range(len(names))))))
    counts = rows.groupBy("__at", *fields).agg(F.count(F.lit(1)).alias("__n"))
    known = reduce(Column.__or__, (F.col(f).isNotNull() for f in fields))
    best = counts.where(known).groupBy("__at").agg(F.min(F.struct((-F.col("__n")).alias("n"), *fields)).alias("__m"))
    return best.agg(*(F.max(F.when(F.col("__at") == i, F.col("__m").getField(f))).alias(n) for i, (n, f) in enumerate(zip(names, fields, strict=True))))


def profile(df: DataFrame, medians: Sequence[str], frequent: Sequence[str]) -> DataFrame:
    """One row: medians of the first columns, most frequent values (smallest of ties) of the second; 0 if unknown."""
    out = df.sparkSession.range(1).select(F.lit(1).alias("__one"))
    if frequent:
        found = modes(df, frequent)
        out = out.join(F.broadcast(found.select(*(F.coalesce(c(n), F.lit(0)).alias(n) for n in frequent))))  # one row each
    if medians:
        q = quantiles(stacked(df, medians), ["column"], "value", [0.5])
        one = q.agg(*(F.coalesce(F.max(F.when(F.col("column") == n, F.col("__q")[0])), F.lit(0.0)).alias(n) for n in medians))
        out = out.join(F.broadcast(one))  # one row each
    return out.select(*(c(n) for n in (*medians, *frequent)))


def sample_skewness(x: Column) -> Column:
    n = F.count(x)
    return F.skewness(x) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0))


def sample_kurtosis(x: Column) -> Column:
    n = F.count(x).cast("double")
    return (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0)) * ((n + 1) * F.kurtosis(x) + 6)
