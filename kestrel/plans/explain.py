"""Model-agnostic explanation: sampled SHAP, its grouping, and local surrogates.

``score`` is any function that adds a column ``predicted`` to a table, so a whole
explanation is one scoring pass over one table and one aggregation.  The driver holds
only the background rows (a parameter) and the surrogate's coefficients.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.operators.aggregates import stacked
from kestrel.operators.columns import c
from kestrel.operators.ranks import quantiles
from kestrel.operators.splits import sample

Score = Callable[[DataFrame], DataFrame]
SEED = 1308


def sampled_shap(
    score: Score, df: DataFrame, background: DataFrame, key: str, features: Sequence[str], order: Sequence[str],
    walks: int = 16, seed: int = SEED,
) -> DataFrame:
    """(key, feature, shap): mean contribution of each input over ``walks`` random orders.

    A walk starts at a background row (one of ``walks``, chosen by a hash of ``order``) and takes
    over the row's values one input at a time.  The steps of a walk add up to the row's score less
    the background row's, so a row's values add up to its score less the mean background score,
    exactly.  Missing inputs count as 0; walks in opposite orders come in pairs.
    """
    spark = df.sparkSession
    n = len(features)
    start = [tuple(float(v or 0.0) for v in r) for r in sample(background.fillna(0, list(features)), order, walks, seed).select(*(c(f) for f in features)).collect()]
    if not start:
        raise ValueError("the background has no rows")
    rng = np.random.default_rng(seed)
    rows = []
    for w in range(walks):
        path = rng.permutation(n) if w % 2 == 0 else path[::-1]
        place = np.empty(n, dtype=int)
        place[path] = np.arange(1, n + 1)
        rows.append((w, path.tolist(), place.tolist(), list(start[w % len(start)])))
    table = spark.createDataFrame(rows, "__w int, __path array<int>, __place array<int>, __from array<double>")  # ``walks`` rows
    own = F.array(*(F.coalesce(c(f).cast("double"), F.lit(0.0)) for f in features))
    states = (
        df.select(c(key), own.alias("__own"), F.explode(F.sequence(F.lit(0), F.lit(walks - 1))).alias("__w"))
        .join(F.broadcast(table), "__w")
        .withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(n))))
    )
    mixed = [F.when(F.col("__place")[i] <= F.col("__k"), F.col("__own")[i]).otherwise(F.col("__from")[i]).alias(f) for i, f in enumerate(features)]
    done = score(states.select(c(key), "__k", "__path", *mixed))
    # A state's score ends one input's step and begins the next one's; a row has one group with a sum for each input.
    ends, begins = F.get("__path", F.col("__k") - 1), F.get("__path", F.col("__k"))
    step = lambda i: F.when(ends == i, F.col("predicted")).when(begins == i, -F.col("predicted"))
    sums = done.groupBy(c(key)).agg(*((F.sum(step(i)) / walks).alias(f"__shap{i}") for i in range(n)))
    told = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f"__shap{i}").alias("shap")) for i, f in enumerate(features)))
    return sums.select(c(key), F.inline(told))


def grouped(values: DataFrame, key: str, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """SHAP values added up within named groups of inputs; other inputs stay as they are."""
    group_of = [x for name, members in groups.items() for f in members for x in (F.lit(f), F.lit(name))]
    name = F.coalesce(F.create_map(*group_of)[F.col("feature")], F.col("feature")) if group_of else F.col("feature")
    return values.groupBy(c(key), name.alias("feature")).agg(F.sum("shap").alias("shap"))


def importance(values: DataFrame) -> DataFrame:
    """Mean absolute SHAP value of every input."""
    return values.groupBy("feature").agg(F.avg(F.abs("shap")).alias("mean_abs_shap"))


def _uniform(row: Column, stream: int, seed: int) -> Column:
    """A number in [0, 1) that depends on the row's number alone, so that a lost task repeats it."""
    return F.pmod(F.xxhash64(row, F.lit(stream), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def _condition(name: str, bounds: Sequence[float], at: int) -> str:
    low = f"{bounds[at - 1]:.2f} < " if at > 0 else ""
    if at == len(bounds):
        return f"{name} > {bounds[-1]:.2f}"
    return f"{low}{name} <= {bounds[at]:.2f}"


def surrogate(
    score: Score, row: Mapping[str, float], train: DataFrame, features: Sequence[str],
    samples: int = 5_000, most: int = 10, seed: int = SEED,
) -> list[tuple[str, float]]:
    """Local explanation of one row: (condition, impact), the ``most`` largest impacts, best first.

    Inputs are cut at their quartiles in ``train``.  Neighbours draw each input's band by its share
    of the training rows and a value inside the band; a weighted ridge regression of their scores
    on "is in the row's own band" gives the impacts.  Weights fall with the number of bands changed.
    """
    spark = train.sparkSession
    known = {f: float(row.get(f) or 0.0) for f in features}
    # One row for each input.
    wide = {r[0]: r[1] for r in quantiles(stacked(train, features), ["column"], "value", [0, 0.25, 0.5, 0.75, 1]).collect()}
    cuts, ends = [], []
    for f in features:
        q = wide.get(f) or [0.0] * 5
        cuts.append(sorted(set(q[1:4])))
        ends.append((q[0], q[4]))

    def band(x: Column, bounds: Sequence[float]) -> Column:
        return sum((F.when(x > b, 1).otherwise(0) for b in bounds), F.lit(0))

    bands = [band(F.coalesce(c(f).cast("double"), F.lit(0.0)), b) for f, b in zip(features, cuts, strict=True)]
    shares = train.agg(
        F.count(F.lit(1)), *(F.count(F.when(x == k, 1)) for x, b in zip(bands, cuts, strict=True) for k in range(len(b) + 1))
    ).first()
    total, at = max(1, shares[0]), 1
    out = spark.range(samples)
    values, same, held = [], [], []
    for i, f in enumerate(features):
        upto = np.cumsum([shares[at + k] / total for k in range(len(cuts[i]) + 1)])
        at += len(cuts[i]) + 1
        edges = [min(ends[i][0], cuts[i][0]), *cuts[i], max(ends[i][1], cuts[i][-1])]
        mine = sum(known[f] > b for b in cuts[i])
        u, inside = _uniform(F.col("id"), 2 * i, seed), _uniform(F.col("id"), 2 * i + 1, seed)
        drawn = sum((F.when(u >= float(x), 1).otherwise(0) for x in upto[:-1]), F.lit(0))
        low, high = F.array(*map(F.lit, map(float, edges[:-1])))[drawn], F.array(*map(F.lit, map(float, edges[1:])))[drawn]
        first = F.col("id") == 0  # the row itself
        values.append(F.when(first, known[f]).otherwise(high - inside * (high - low)).alias(f))
        same.append(F.when(first | (drawn == mine), 1.0).otherwise(0.0).alias(f"__s{i}"))
        held.append(_condition(f, cuts[i], mine))
    done = score(out.select("id", *values, *same))
    apart = sum((1.0 - F.col(f"__s{i}") for i in range(len(features))), F.lit(0.0))
    width = 0.75 * math.sqrt(len(features))
    local = done.select(*(f"__s{i}" for i in range(len(features))), F.col("predicted").alias("__y"), F.sqrt(F.exp(-apart / width**2)).alias("__weight"))
    ready = VectorAssembler(inputCols=[f"__s{i}" for i in range(len(features))], outputCol="__x").transform(local)
    fit = LinearRegression(featuresCol="__x", labelCol="__y", weightCol="__weight", regParam=1e-3, solver="normal", standardization=False).fit(ready)
    found = sorted(zip(held, fit.coefficients.toArray().tolist(), strict=True), key=lambda r: -abs(r[1]))[:most]
    return sorted(found, key=lambda r: -r[1])


#: A condition on a 0/1 input: one feature, no second bound.
BINARY = re.compile(r"(?P<feature>(?:(?! < ).)+) (?P<sign><=|>) 0\.00")


def readable(condition: str, row: Mapping[str, float], families: Mapping[str, str]) -> str:
    """A surrogate's condition in words: of a 0/1 input the row's own category, else yes or no.

    ``families`` gives the display name of every one-hot prefix.
    """
    parsed = BINARY.fullmatch(condition)
    if parsed is None:  # a bound of a number says what it means
        return condition
    feature, holds = parsed["feature"], parsed["sign"] == ">"
    prefix = next(filter(feature.startswith, families), None)
    if prefix is None:
        return f"{'Oui' if holds else 'Non'} : {feature}"
    word = lambda name: name.removeprefix(prefix).replace("_", " ").strip().capitalize()
    own = next((word(n) for n, v in row.items() if n.startswith(prefix) and v == 1), "Inconnu")
    return f"{families[prefix]} : {own}" + ("" if holds else f" (≠ {word(feature)})")
