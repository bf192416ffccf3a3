"""Error metrics, banded error reports, sample weights and target transforms - aggregates only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.numbers import band
from kestrel.operators.columns import c
from kestrel.operators.ranks import quantiles
from kestrel.storage import materialize

# Bands of the error reports.
VALUE_EDGES = (0, 1e6, 5e6, 20e6, 50e6, float("inf"))
VALUE_LABELS = ("<1M", "1-5M", "5-20M", "20-50M", ">50M")
AGE_EDGES = (0, 20, 24, 28, 32, 100)
AGE_LABELS = ("<21", "21-24", "25-28", "29-32", ">32")


def metric_aggs(y: Column, p: Column, features: int = 0, digits: int = 6) -> list[Column]:
    """n, MAE, RMSE, MAPE, R2, adjusted R2 and RMSE of log1p, over rows where both are known."""
    both = y.isNotNull() & p.isNotNull()
    y, p = F.when(both, y), F.when(both, p)
    n = F.count(y)
    r2 = 1 - F.sum((y - p) * (y - p)) / F.nullif(F.var_pop(y) * n, F.lit(0))
    logs = F.log1p(y) - F.log1p(F.greatest(p, F.lit(0.0)))
    r = lambda x, name: F.round(x, digits).alias(name)
    return [
        n.alias("n"),
        r(F.avg(F.abs(y - p)), "mae"),
        r(F.sqrt(F.avg((y - p) * (y - p))), "rmse"),
        r(F.avg(F.abs(y - p) / F.nullif(F.abs(y), F.lit(0))), "mape"),
        r(r2, "r2"),
        r(1 - (1 - r2) * (n - 1) / F.nullif(n - features - 1, F.lit(0)), "adj_r2"),
        r(F.sqrt(F.avg(logs * logs)), "rmse_log"),
    ]


def errors(df: DataFrame, y: str, p: str, keys: Sequence[str] = (), features: int = 0) -> DataFrame:
    aggs = metric_aggs(c(y).cast("double"), c(p).cast("double"), features)
    return df.groupBy(*(c(k) for k in keys)).agg(*aggs) if keys else df.agg(*aggs)


def banded_errors(
    df: DataFrame, y: str, p: str, by: str, edges: Sequence[float], labels: Sequence[str], digits: int = 4
) -> DataFrame:
    """Per band of ``by``: rows, mean value, MAE, MAPE, share of rows and of all absolute error."""
    error = F.abs(c(y) - c(p))
    g = (
        df.withColumn("band", band(c(by), edges, labels))
        .where("band IS NOT NULL")
        .groupBy("band")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(c(y)), digits).alias("mean_y"),
            F.round(F.avg(error), digits).alias("mae"),
            F.round(F.avg(error / F.nullif(F.abs(c(y)), F.lit(0))) * 100, digits).alias("mape_pct"),
            F.sum(error).alias("__e"),
        )
    )
    whole = g.agg(F.sum("n").alias("__n"), F.sum("__e").alias("__all"))
    return g.join(F.broadcast(whole)).select(  # one row
        "band", "n", "mean_y", "mae", "mape_pct",
        F.round(F.col("n") * 100.0 / F.col("__n"), digits).alias("rows_pct"),
        F.round(F.col("__e") * 100.0 / F.nullif(F.col("__all"), F.lit(0)), digits).alias("error_pct"),
    )


def weights(df: DataFrame, y: str, out: str = "weight") -> DataFrame:
    """1 / log1p(y), scaled to a mean of 1."""
    raw = 1 / F.nullif(F.log1p(c(y)), F.lit(0))
    mean = df.agg(F.avg(raw).alias("__mean"))
    return df.join(F.broadcast(mean)).withColumn(out, raw / F.col("__mean")).drop("__mean")  # one row


#: name -> (transform, inverse) of targets.
TRANSFORMS = {
    "raw": (lambda y: y, lambda z: z),
    "log1p": (F.log1p, F.expm1),
    "log10": (lambda y: F.log10(y + 1), lambda z: F.pow(F.lit(10.0), z) - 1),
    "sqrt": (F.sqrt, lambda z: z * z),
}


def yeo_johnson(y: Column, lam: float) -> Column:
    """The Yeo-Johnson power transform."""
    up = F.log1p(y) if abs(lam) < 1e-12 else (F.pow(y + 1, lam) - 1) / lam
    down = -F.log1p(-y) if abs(lam - 2) < 1e-12 else -(F.pow(1 - y, 2 - lam) - 1) / (2 - lam)
    return F.when(y >= 0, up).otherwise(down)


def from_yeo_johnson(z: Column, lam: float) -> Column:
    """Inverse of :func:`yeo_johnson`."""
    up = F.expm1(z) if abs(lam) < 1e-12 else F.pow(z * lam + 1, 1 / lam) - 1
    down = -F.expm1(-z) if abs(lam - 2) < 1e-12 else 1 - F.pow(1 - z * (2 - lam), 1 / (2 - lam))
    return F.when(z >= 0, up).otherwise(down)


def fit_yeo_johnson(df: DataFrame, y: str, grid: Sequence[float] | None = None) -> float:
    """The lambda of greatest log-likelihood on a grid, all candidates in one pass."""
    grid = list(grid or [x / 10 for x in range(-20, 41)])
    x = c(y).cast("double")
    log_jacobian = F.sum(F.signum(x) * F.log1p(F.abs(x)))
    row = df.agg(
        F.count(x), log_jacobian, *(F.var_pop(yeo_johnson(x, lam)) for lam in grid)
    ).first()
    import math

    score = lambda i: -row[0] / 2 * math.log(row[i + 2]) + (grid[i] - 1) * row[1] if row[i + 2] else -math.inf
    return grid[max(range(len(grid)), key=score)]


def quantile_grid(df: DataFrame, y: str, steps: int = 100) -> DataFrame:
    """One row with the exact quantiles of y, written once for those who map to and from it."""
    return materialize(quantiles(df, [], y, [i / steps for i in range(steps + 1)]), "grid")[0]


def quantile_uniform(df: DataFrame, y: str, out: str, steps: int = 100, grid: DataFrame | None = None) -> DataFrame:
    """Position of y on a grid of exact quantiles (``grid``, or that of ``df``), linear between them: a map to [0, 1] of fixed size."""
    grid = quantile_grid(df, y, steps) if grid is None else grid
    # Grid values up to y, by halving: a long grid takes few steps a row.
    halves = F.array(*(F.lit(1 << i) for i in reversed(range((steps + 1).bit_length()))))
    upto = F.aggregate(halves, F.lit(0), lambda n, h: F.when(F.get("__q", n + h - 1) <= c(y), n + h).otherwise(n))
    k = F.greatest(F.least(upto, F.lit(steps)), F.lit(1))
    low, high = F.element_at("__q", k), F.element_at("__q", k + 1)
    part = F.coalesce((c(y) - low) / F.nullif(high - low, F.lit(0.0)), F.lit(0.0))
    position = F.when(c(y).isNotNull(), F.greatest(F.least((k - 1 + part) / steps, F.lit(1.0)), F.lit(0.0)))
    return df.join(F.broadcast(grid)).withColumn(out, position).drop("__q")  # one row


def from_quantile_uniform(df: DataFrame, train: DataFrame, y: str, u: str, out: str, steps: int = 100, grid: DataFrame | None = None) -> DataFrame:
    """Inverse of :func:`quantile_uniform` learned on ``train``: the value at position ``u`` of the grid of quantiles (``grid``, if it is known)."""
    grid = quantile_grid(train, y, steps) if grid is None else grid
    at = F.least(F.greatest(c(u), F.lit(0.0)), F.lit(1.0)) * steps
    k = F.least(F.floor(at), F.lit(steps - 1)).cast("int")
    low, high = F.element_at("__q", k + 1), F.element_at("__q", k + 2)
    return df.join(F.broadcast(grid)).withColumn(out, low + (high - low) * (at - k)).drop("__q")  # one row


def min_max_target(df: DataFrame, train: DataFrame, y: str, out: str) -> DataFrame:
    """(y - min) / (max - min) with the bounds of ``train``; 0 where they are equal."""
    span = train.agg(F.min(c(y)).alias("__lo"), F.max(c(y)).alias("__hi"))
    scaled = F.coalesce((c(y) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0)), F.when(c(y).isNotNull(), 0.0))
    return df.join(F.broadcast(span)).withColumn(out, scaled).drop("__lo", "__hi")  # one row


def from_min_max(df: DataFrame, train: DataFrame, y: str, z: str, out: str) -> DataFrame:
    span = train.agg(F.min(c(y)).alias("__lo"), F.max(c(y)).alias("__hi"))
    return df.join(F.broadcast(span)).withColumn(out, F.col("__lo") + c(z) * (F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")  # one row
