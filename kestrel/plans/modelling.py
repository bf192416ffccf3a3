"""Regression on a transformed target, out-of-fold stacking, explanation and trajectories, on MLlib.

Only model state (coefficients, trees, a few sums) reaches the driver, never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.operators.columns import c, numeric
from kestrel.operators.aggregates import stacked
from kestrel.operators.metrics import TRANSFORMS, errors, weights
from kestrel.operators.ranks import quantiles
from kestrel.operators.splits import below_limit, clip_quantiles
from kestrel.operators.windows import base_100
from kestrel.plans.growth import DepthwiseTrees, ExtraTrees, ForestModel, LeafwiseTrees, SymmetricTrees
from kestrel.sources.files import read_params, write_params
from kestrel.storage import materialize

# Columns that are never inputs.
NOT_INPUTS = ("market_value_in_eur", "player", "team", "nation", "position")
SEED = 1308


def inputs(df: DataFrame, target: str, exclude: Sequence[str] = NOT_INPUTS) -> list[str]:
    """Numeric columns other than the target and ``exclude``."""
    out = set(exclude) | {target}
    return [n for n in numeric(df) if n not in out]


def prepare(df: DataFrame, target: str, features: Sequence[str], transform: str = "log1p") -> DataFrame:
    """Rows with a target, with its transform as label, weight and feature vector (missing inputs are 0)."""
    rows = weights(df.where(c(target).isNotNull()), target, "weight").withColumn("label", TRANSFORMS[transform][0](c(target)))
    rows = rows.fillna(0, list(features))
    safe = rows.withColumns({f"__x{i}": c(n).cast("double") for i, n in enumerate(features)})
    names = [f"__x{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep").transform(safe).drop(*names)


def base_learners() -> dict[str, Estimator]:
    """Diverse regressors on the log label."""
    tree = {"labelCol": "label", "featuresCol": "features", "weightCol": "weight", "seed": SEED}
    return {
        "ols": LinearRegression(labelCol="label", weightCol="weight", solver="normal", regParam=1e-6),
        "elastic_net": LinearRegression(labelCol="label", weightCol="weight", regParam=0.01, elasticNetParam=0.5),
        "forest": RandomForestRegressor(numTrees=30, maxDepth=8, **tree),
        "boosted": GBTRegressor(maxIter=30, maxDepth=4, stepSize=0.1, **tree),
    }


def boosted_learners(rounds: int = 30, valid: str | None = None) -> dict[str, DepthwiseTrees]:
    """Three boosters that grow their trees in different ways; with a validation column they stop early."""
    return {
        "depthwise": DepthwiseTrees(rounds=rounds, depth=5, rate=0.2, valid=valid, sample=0.8),
        "leafwise": LeafwiseTrees(rounds=rounds, leaves=24, depth=7, rate=0.15, valid=valid, inputs=0.8),
        "symmetric": SymmetricTrees(rounds=rounds, depth=5, rate=0.25, l2=3.0, valid=valid),
    }


def forest_learners(trees: int = 30) -> dict[str, object]:
    """Averaged trees: a random forest and extremely random trees."""
    tree = {"labelCol": "label", "featuresCol": "features", "weightCol": "weight", "seed": SEED}
    return {"forest": RandomForestRegressor(numTrees=trees, maxDepth=8, **tree), "extra": ExtraTrees(trees=trees, depth=9)}


def scored(model: Model, df: DataFrame, out: str, transform: str = "log1p") -> DataFrame:
    """``df`` with the model's prediction on the target's own scale, not below zero."""
    done = model.transform(df).withColumn(out, F.greatest(TRANSFORMS[transform][1](F.col("prediction")), F.lit(0.0)))
    return done.drop("prediction")


def contiguous_folds(df: DataFrame, order: Sequence[str], folds: int, out: str = "fold") -> DataFrame:
    """Fold numbers in unshuffled blocks of rows, at most one row apart in size; ties and nulls in the order key are rows too."""
    placed, _ = materialize(_indexed(df, [c(o) for o in order], "__i"), "folds")
    return placed.withColumn(out, F.floor((F.col("__i") - 1) * folds / F.lit(max(1, placed.count()))).cast("int")).drop("__i")


def out_of_fold(df: DataFrame, learners: Mapping[str, Estimator], fold: str, folds: int, transform: str = "log1p") -> DataFrame:
    """Each row predicted by models that never saw its fold: a column ``p_<learner>`` each.  Every fold is written when it is scored."""
    parts = []
    for k in range(folds):
        part = df.where(c(fold) == k)
        for name, learner in learners.items():
            part = scored(learner.fit(df.where(c(fold) != k)), part, f"p_{name}", transform)
        parts.append(materialize(part.drop("features"), "fold")[0])
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def nnls(df: DataFrame, y: str, xs: Sequence[str]) -> tuple[float, dict[str, float]]:
    """Intercept and non-negative weights of least squares, from one aggregation of cross products.

    Every subset of the few inputs is solved; the best one without a negative weight wins.
    """
    cols = [F.lit(1.0), *(c(x).cast("double") for x in xs), c(y).cast("double")]
    n = len(cols)
    row = df.agg(*(F.sum(cols[i] * cols[j]) for i in range(n) for j in range(i, n))).first()
    gram, at = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            gram[i, j] = gram[j, i] = row[at] or 0.0
            at += 1
    best = (float("inf"), 0.0, dict.fromkeys(xs, 0.0))
    for size in range(len(xs) + 1):
        for chosen in combinations(range(1, len(xs) + 1), size):
            own = [0, *chosen]
            w = np.linalg.lstsq(gram[np.ix_(own, own)], gram[own, -1], rcond=None)[0]
            if (w[1:] < 0).any():
                continue
            loss = gram[-1, -1] - 2 * w @ gram[own, -1] + w @ gram[np.ix_(own, own)] @ w
            if loss < best[0] - 1e-9 * abs(gram[-1, -1]):
                named = dict.fromkeys(xs, 0.0) | {xs[i - 1]: float(v) for i, v in zip(chosen, w[1:], strict=True)}
                best = (float(loss), float(w[0]), named)
    return best[1], best[2]


@dataclass
class Stack:
    """Base models of the transformed target and the linear blend of their predictions, in the target's own scale."""

    features: list[str]
    target: str
    transform: str = "log1p"
    models: dict[str, Model] = field(default_factory=dict)
    intercept: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)

    def fit(self, df: DataFrame, order: Sequence[str], folds: int = 5, learners: Mapping[str, Estimator] | None = None) -> Stack:
        learners = dict(learners or base_learners())
        ready, _ = materialize(contiguous_folds(prepare(df, self.target, self.features, self.transform), order, folds), "train")
        oof = out_of_fold(ready, learners, "fold", folds, self.transform)
        self.intercept, found = nnls(oof, self.target, [f"p_{n}" for n in learners])
        self.weights = {n: found[f"p_{n}"] for n in learners}
        self.models = {n: e.fit(ready) for n, e in learners.items()}
        return self

    def predict(self, df: DataFrame, out: str = "predicted") -> DataFrame:
        """``df`` - aligned to the model's inputs - with every base prediction and the blend."""
        ready = prepare(df.withColumn(self.target, F.coalesce(c(self.target), F.lit(0.0))), self.target, self.features)
        total = F.lit(self.intercept)
        for name, model in self.models.items():
            ready = scored(model, ready, f"p_{name}", self.transform)
            total = total + F.lit(self.weights[name]) * F.col(f"p_{name}")
        return ready.withColumn(out, F.greatest(total, F.lit(0.0))).drop("features", "label", "weight")

    def params(self) -> dict:
        kinds = {n: "forest" if isinstance(model, ForestModel) else "mllib" for n, model in self.models.items()}
        return {"features": self.features, "target": self.target, "transform": self.transform, "intercept": self.intercept, "weights": self.weights, "kinds": kinds}

    def save(self, path: str) -> None:
        """Models as MLlib pipelines or forests; blend as JSON, on any store Spark writes."""
        spark = SparkSession.getActiveSession()
        for name, model in self.models.items():
            if isinstance(model, ForestModel):
                model.save(spark, f"{path}/models/{name}")
            else:
                PipelineModel([model]).write().overwrite().save(f"{path}/models/{name}")
        write_params(spark, self.params(), f"{path}/params")

    @classmethod
    def load(cls, spark, path: str) -> Stack:
        p = read_params(spark, f"{path}/params")
        load = {"forest": lambda at: ForestModel.load(spark, at), "mllib": PipelineModel.load}
        models = {n: load[kind](f"{path}/models/{n}") for n, kind in p["kinds"].items()}
        return cls(p["features"], p["target"], p["transform"], models, p["intercept"], p["weights"])


def ranking(df: DataFrame, y: str, predictions: Sequence[str]) -> DataFrame:
    """Error metrics of every prediction column, best MAE first; all from one pass."""
    long = df.select(c(y), F.expr(f"stack({len(predictions)}, " + ", ".join(f"'{p}', `{p}`" for p in predictions) + ") AS (model, p)"))
    return errors(long, y, "p", ["model"]).orderBy("mae", "model")


def mean_blend(df: DataFrame, predictions: Sequence[str], out: str = "predicted") -> DataFrame:
    """The mean of the predictions that are known."""
    known = sum((F.coalesce(c(p), F.lit(0.0)) for p in predictions), F.lit(0.0))
    n = sum((c(p).isNotNull().cast("int") for p in predictions), F.lit(0))
    return df.withColumn(out, known / F.nullif(n, F.lit(0)))


def best_transform(
    train: DataFrame, test: DataFrame, target: str, features: Sequence[str], transforms: Sequence[str], learner: Callable[[], Estimator]
) -> DataFrame:
    """Error metrics of one learner fitted on each transform of the target and scored on its own scale, best MAE first.

    Transforms that differ by a factor, as log1p and log10, tie but for rounding: errors are compared at nine digits, ties by name.
    """
    # Written once: every transform reads both tables, and solvers pass over them again and again.
    kept = list(dict.fromkeys([target, *features]))
    train, test = (materialize(df.select(*(c(k) for k in kept)), label)[0] for df, label in ((train, "train"), (test, "test")))
    made = None
    for name in transforms:
        model = learner().fit(prepare(train, target, features, name).where(F.col("label").isNotNull()))
        done = scored(model, prepare(test, target, features, name), "p", name)
        own = done.select(F.lit(name).alias("model"), c(target).cast("double").alias("y"), "p")
        made = own if made is None else made.unionByName(own)
    return errors(made, "y", "p", ["model"]).withColumnRenamed("model", "transform").orderBy(rounded("mae"), "transform")


def rounded(x: str) -> Column:
    """A number at nine digits, so that rounding in the last ones decides nothing."""
    return F.format_string("%.8e", c(x)).cast("double")


def restacked(
    train: DataFrame, test: DataFrame, target: str, features: Sequence[str], order: Sequence[str], learner: Callable[[], Estimator],
    learners: Mapping[str, Estimator] | None = None, transforms: Sequence[str] = tuple(TRANSFORMS), folds: int = 5,
) -> tuple[Stack, DataFrame]:
    """(the stack on the transform chosen, its errors on ``test`` beside those of the log1p stack).

    ``learner`` chooses the transform, by MAE on the last fold of ``train`` after fitting on the others, so that ``test`` stays unseen.
    """
    placed, _ = materialize(contiguous_folds(train, order, folds, "__fold"), "placed")
    fit, watch = placed.where(F.col("__fold") < folds - 1).drop("__fold"), placed.where(F.col("__fold") == folds - 1).drop("__fold")
    name = best_transform(fit, watch, target, features, transforms, learner).first()["transform"]  # a row a transform
    made, chosen = None, None
    for transform in dict.fromkeys(("log1p", name)):
        chosen = Stack(list(features), target, transform).fit(train, order, folds, learners)
        own = chosen.predict(test).select(F.lit(transform).alias("model"), c(target).cast("double").alias("y"), F.col("predicted").alias("p"))
        made = own if made is None else made.unionByName(own)
    return chosen, errors(made, "y", "p", ["model"]).withColumnRenamed("model", "transform").orderBy("mae", "transform")


def trimmed_errors(train: DataFrame, test: DataFrame, target: str, features: Sequence[str], learner: Callable[[], Estimator]) -> DataFrame:
    """(model, n_train, errors on all of ``test``) of a model of all rows and of one of the rows below the target's outlier limit."""
    made = None
    for name, rows in (("all", train), ("trimmed", below_limit(train, train, target))):
        ready, _ = materialize(prepare(rows, target, features), "train")
        done = scored(learner().fit(ready), prepare(test, target, features), "p")
        own = done.select(F.lit(name).alias("model"), F.lit(ready.count()).alias("n_train"), c(target).cast("double").alias("y"), "p")
        made = own if made is None else made.unionByName(own)
    return errors(made, "y", "p", ["model", "n_train"]).orderBy("mae", "model")


def gain_importance(spark: SparkSession, model: Model, features: Sequence[str]) -> DataFrame:
    """(feature, gain): a tree model's importances, strongest first; one row an input."""
    rows = [(n, float(v)) for n, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature")


def chosen(importance: DataFrame, value: str, threshold: float, least: int = 5) -> list[str]:
    """Inputs whose importance exceeds ``threshold``, strongest first; at least the ``least`` strongest."""
    ranked = [(r.feature, r[value]) for r in importance.orderBy(F.desc(value), "feature").collect()]  # one row an input
    above = [f for f, v in ranked if v is not None and v > threshold]
    return above if len(above) >= least else [f for f, _ in ranked[:least]]


def select_by_threshold(
    importance: DataFrame, value: str, thresholds: Sequence[float], train: DataFrame, test: DataFrame, target: str,
    learner: Callable[[], Estimator], least: int = 5,
) -> DataFrame:
    """(threshold, features, mae, rmse, r2): a model on the inputs above each threshold, best MAE first."""
    out = []
    for t in thresholds:
        names = chosen(importance, value, t, least)
        done = scored(learner().fit(prepare(train, target, names)), prepare(test, target, names), "p")
        r = errors(done, target, "p").first()
        out.append((float(t), len(names), r.mae, r.rmse, r.r2))
    spark = train.sparkSession
    return spark.createDataFrame(out, "threshold double, features int, mae double, rmse double, r2 double").orderBy("mae", "features")


def specialised(
    train: DataFrame, test: DataFrame, target: str, features: Sequence[str], group: str, learner: Callable[[], Estimator]
) -> DataFrame:
    """Per group of rows: MAE of the model of all rows and of the group's own, and the gain of the latter.

    ``group`` holds a few labels, as goalkeepers and outfield players.
    """
    whole = learner().fit(prepare(train, target, features))
    made = None
    for r in train.select(c(group).alias("g")).where("g IS NOT NULL").distinct().orderBy("g").collect():
        own = learner().fit(prepare(train.where(c(group) == r.g), target, features))
        rows = prepare(test.where(c(group) == r.g), target, features)
        done = scored(own, scored(whole, rows, "p_all"), "p_own").select(F.lit(r.g).alias("group"), c(target).alias("y"), "p_all", "p_own")
        made = done if made is None else made.unionByName(done)
    return made.groupBy("group").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y") - F.col("p_all"))).alias("mae_all"), F.avg(F.abs(F.col("y") - F.col("p_own"))).alias("mae_own")
    ).withColumn("gain", F.col("mae_all") - F.col("mae_own"))


def champion(df: DataFrame, y: str, predictions: Sequence[str]) -> DataFrame:
    """Final comparison: metrics of every approach on the same rows, clipped at zero, best MAE first and marked.

    Raises if an approach lacks a prediction for a row that another has.
    """
    counts = df.agg(*(F.count(c(p)).alias(p) for p in predictions)).first().asDict()
    if len(set(counts.values())) > 1:
        raise ValueError(f"approaches predict different numbers of rows: {counts}")
    clipped = df.withColumns({p: F.when(c(p).isNotNull(), F.greatest(c(p), F.lit(0.0))) for p in predictions})
    table = ranking(clipped, y, predictions)
    best = table.select(F.min(F.struct("mae", "model")).alias("b"))
    return table.join(F.broadcast(best)).withColumn("champion", F.col("model") == F.col("b.model")).drop("b").orderBy("mae", "model")  # one row


def permutation_importance(
    score: Callable[[DataFrame], DataFrame], df: DataFrame, features: Sequence[str], target: str, repeats: int = 3
) -> DataFrame:
    """Mean rise of MAE when one input is shuffled: rows swap values along a hash order, by two joins on rank.

    ``score`` adds ``predicted``.  Ranks come from range-partitioned sorting per partition
    and offsets, not from one global window.
    """
    spark = df.sparkSession
    df, _ = materialize(df, "whole")  # read for every input and repeat
    base = errors(score(df), target, "predicted").first()["mae"]
    rows = []
    for name in features:
        rises = []
        for r in range(repeats):
            shuffled = _shuffled(df, name, SEED + r)
            rises.append(errors(score(shuffled), target, "predicted").first()["mae"] - base)
        rows.append((name, float(np.mean(rises)), float(np.std(rises))))
    return spark.createDataFrame(rows, "feature string, importance double, deviation double")


def _indexed(df: DataFrame, order, out: str) -> DataFrame:
    """Row numbers along ``order``: partition offsets plus ranks within range partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, _ = materialize(df.repartitionByRange(parts, *order).withColumn("__p", F.spark_partition_id()), "ranked")
    sizes = sorted(placed.groupBy("__p").count().collect())  # one row per partition
    offsets, n = [], 0
    for p, size in sizes:
        offsets.append((p, n))
        n += size
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "__p int, __o long")
    w = Window.partitionBy("__p").orderBy(*order)
    return placed.join(F.broadcast(table), "__p").withColumn(out, F.row_number().over(w) + F.col("__o")).drop("__p", "__o")


def _shuffled(df: DataFrame, name: str, seed: int) -> DataFrame:
    keyed = df.withColumn("__h", F.xxhash64(F.lit(seed), *(c(n) for n in df.columns)))
    own = _indexed(keyed, [F.col("__h"), c(name)], "__i").drop("__h")
    other = _indexed(
        keyed.select(F.xxhash64(F.lit(~seed), "__h").alias("__g"), c(name).alias("__v")), [F.col("__g"), F.col("__v")], "__i"
    ).drop("__g")
    return own.join(other, "__i").withColumn(name, F.col("__v")).select(*(c(n) for n in df.columns))


def linear_shap(df: DataFrame, features: Sequence[str], coefficients: Sequence[float]) -> DataFrame:
    """Exact SHAP values of a linear model: w * (x - mean), a column ``shap_<feature>`` each."""
    means = df.agg(*(F.avg(c(n)).alias(f"__m{i}") for i, n in enumerate(features)))
    wide = df.join(F.broadcast(means))  # one row
    return wide.withColumns(
        {f"shap_{n}": F.lit(float(w)) * (c(n) - F.col(f"__m{i}")) for i, (n, w) in enumerate(zip(features, coefficients, strict=True))}
    ).drop(*(f"__m{i}" for i in range(len(features))))


def quartiles(df: DataFrame, names: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Exact lower quartile, median and upper quartile of every column, all placed in one pass; 0 for a column without values."""
    found = {r["column"]: r["__q"] for r in quantiles(stacked(df, names), ["column"], "value", [0.25, 0.5, 0.75]).collect()}  # a row a column
    return {n: tuple(found[n]) if n in found else (0.0, 0.0, 0.0) for n in names}


def imputed(df: DataFrame, names: Sequence[str], learned: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """Unknown values take the column's median."""
    return df.withColumns({n: F.coalesce(c(n).cast("double"), F.lit(learned[n][1])) for n in names})


def robust_scaled(df: DataFrame, names: Sequence[str], learned: Mapping[str, tuple[float, float, float]], out: Sequence[str]) -> DataFrame:
    """(x - median) / (upper - lower quartile); only centred where the quartiles are equal."""
    return df.withColumns({o: (c(n).cast("double") - learned[n][1]) / ((learned[n][2] - learned[n][0]) or 1.0) for n, o in zip(names, out, strict=True)})


def plane(df: DataFrame, features: Sequence[str], k: int | None = None) -> tuple[DataFrame, list[float]]:
    """``df`` with ``components`` (the first ``k``) of its standardised inputs, and the share of variance of each component.

    Unknown values count as the median.  A component's largest loading is positive (of equal ones the first), so its sign is defined.
    """
    names = [f"__x{i}" for i in range(len(features))]
    doubles = df.withColumns({x: c(n).cast("double") for x, n in zip(names, features, strict=True)})
    doubles = imputed(doubles, names, quartiles(doubles, names))
    steps = [
        VectorAssembler(inputCols=names, outputCol="__raw"),
        StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True),
        PCA(k=len(features), inputCol="__scaled", outputCol="components"),
    ]
    model = Pipeline(stages=steps).fit(doubles)
    loadings = model.stages[-1].pc.toArray()
    largest = [int(np.argmax(np.abs(col) >= np.abs(col).max() - 1e-9)) for col in loadings.T]
    signs = F.array(*(F.lit(1.0 if loadings[at, i] > 0 else -1.0) for i, at in enumerate(largest)))
    whole = F.zip_with(vector_to_array("components"), signs, lambda x, s: x * s)
    out = model.transform(doubles).withColumn("components", F.slice(whole, 1, k or len(features)))
    return out.drop("__raw", "__scaled", *names), model.stages[-1].explainedVariance.toArray().tolist()


def reduced(df: DataFrame, features: Sequence[str], share: float) -> tuple[DataFrame, int]:
    """Median-imputed, standardised principal components that explain ``share`` of the variance."""
    out, parts = plane(df, features)
    k = min(int(np.searchsorted(np.cumsum(parts), share - 1e-12) + 1), len(features))
    return out.withColumn("components", F.slice("components", 1, k)), k


def trajectory_stats(df: DataFrame, player: str, season: str, value: str, least: int = 3) -> DataFrame:
    """Per player with ``least`` seasons: mean value, mean and deviation of the changes, seasons."""
    w = Window.partitionBy(c(player)).orderBy(c(season))
    step = df.withColumn("__d", F.when(c(season) - F.lag(c(season)).over(w) == 1, c(value) - F.lag(c(value)).over(w)))
    return (
        step.groupBy(c(player))
        .agg(
            F.avg(c(value)).alias("mean_value"),
            F.avg("__d").alias("mean_delta"),
            F.stddev_samp("__d").alias("std_delta"),
            F.count(c(value)).alias("seasons"),
        )
        .where(F.col("seasons") >= least)
    )


def trajectories(stats: DataFrame, k: int = 4, names: Sequence[str] = ("mean_value", "mean_delta", "std_delta")) -> DataFrame:
    """Clusters of players, numbered by rising mean value: clip 1-99 %, robust scaling, k-means."""
    work = stats.fillna(0.0, list(names))
    for n in names:
        work = clip_quantiles(work, work, n, 0.01, 0.99, f"__c_{n}")
    work, _ = materialize(work, "clipped")
    clipped = [f"__c_{n}" for n in names]
    work = robust_scaled(work, clipped, quartiles(work, clipped), clipped)
    steps = [VectorAssembler(inputCols=clipped, outputCol="features"), KMeans(k=k, seed=SEED, featuresCol="features", predictionCol="__cluster")]
    done, _ = materialize(Pipeline(stages=steps).fit(work).transform(work).drop("features"), "clusters")
    order = Window.orderBy("__m", "__cluster")  # k rows
    named = done.groupBy("__cluster").agg(F.avg("mean_value").alias("__m")).withColumn("cluster", F.row_number().over(order))
    return done.join(F.broadcast(named.drop("__m")), "__cluster").drop("__cluster", *(f"__c_{n}" for n in names))


def with_history(clusters: DataFrame, history: DataFrame, player: str) -> DataFrame:
    """``history`` with the ``cluster`` of its player; players without one are left out."""
    return history.join(clusters.select(c(player), "cluster"), player)


def cluster_plane(clusters: DataFrame, names: Sequence[str] = ("mean_value", "mean_delta", "std_delta")) -> DataFrame:
    """``clusters`` with their players' places x, y in the plane of the first two components of the clustered inputs."""
    out, _ = plane(clusters.fillna(0.0, list(names)), names, 2)
    return out.withColumns({"x": F.col("components")[0], "y": F.col("components")[1]}).drop("components")


def cluster_courses(history: DataFrame, player: str, season: str, value: str, least: int = 30) -> DataFrame:
    """(cluster, season rank, mean of the value in per cent of the player's first, players), where ``least`` players are behind it."""
    based = base_100(history.where(c(value).isNotNull()), [player], season, value, "__base")
    means = based.groupBy("cluster", F.col(f"{season}_rank").alias("rank")).agg(F.avg("__base").alias("base_100"), F.count(F.lit(1)).alias("n"))
    return means.where(F.col("n") >= least)


def silhouettes(vectors: DataFrame, ks: Sequence[int] = tuple(range(2, 9))) -> dict[int, float]:
    """Silhouette of k-means on ``features`` for every k."""
    out = {}
    for k in ks:
        done = KMeans(k=k, seed=SEED).fit(vectors).transform(vectors)
        out[k] = ClusteringEvaluator().evaluate(done)
    return out


def sensitivity(reference: DataFrame, grids: Mapping[str, Sequence[float]]) -> DataFrame:
    """The reference row once per grid point of each variable, changed in that variable alone."""
    out = None
    for name, grid in grids.items():
        moved = reference.withColumn("value", F.explode(F.array(*(F.lit(float(v)) for v in grid)))).withColumn("variable", F.lit(name))
        moved = moved.withColumn(name, F.col("value"))
        out = moved if out is None else out.unionByName(moved)
    return out


# Choices of the manual entry and the model's columns they set.
CHOICES = {
    "poste": {"Gardien": "pos_GK", "Défenseur": "pos_DF", "Milieu": "pos_MF", "Attaquant": "pos_FW"},
    "pied": {"Droit": "foot_right", "Gauche": "foot_left", "Ambidextre": "foot_both"},
    "championnat": {
        "Premier League": "league_ENG-Premier League", "La Liga": "league_ESP-La Liga", "Ligue 1": "league_FRA-Ligue 1",
        "Bundesliga": "league_GER-Bundesliga", "Serie A": "league_ITA-Serie A",
    },
}


def entered(choices: Mapping[str, object]) -> dict[str, float]:
    """A manual entry in business terms as values of the model's columns; unknown fields keep their names."""
    out: dict[str, float] = {}
    for field_, value in choices.items():
        if field_ in CHOICES:
            out |= {column: int(label == value) for label, column in CHOICES[field_].items()}
        elif field_ == "age":
            out |= {"age": value, "age_sq": value * value}
        else:
            out["height_in_cm" if field_ == "taille_cm" else field_] = value
    return out


def manual_row(profile: DataFrame, given: Mapping[str, float]) -> DataFrame:
    """The default profile with known fields overridden; unknown fields are ignored."""
    return profile.withColumns({n: F.lit(v) for n, v in given.items() if n in profile.columns})


def export(df: DataFrame, y: str, p: str, keep: Sequence[str]) -> DataFrame:
    """Real and predicted values with the difference in per cent of the real one."""
    gap = (c(p) - c(y)) / F.nullif(c(y), F.lit(0)) * 100
    return df.select(*(c(n) for n in keep), c(y).alias("vm_reelle_euros"), F.round(c(p), 0).alias("vm_predite_euros"), F.round(gap, 2).alias("ecart_pct"))


def suggestions(df: DataFrame, name: str, text: str, n: int = 5, cutoff: float = 0.5) -> DataFrame:
    """The ``n`` distinct names most like ``text`` by the ratio of matching blocks (difflib's), from ``cutoff``; ties as difflib orders them."""

    def ratio(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = SequenceMatcher()
        match.set_seq2(text)
        for batch in batches:
            out = []
            for x in batch.column(0).to_pylist():
                match.set_seq1(x)
                out.append(match.ratio())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=["name", "score"])

    names = df.select(c(name).cast("string").alias("name")).where("name IS NOT NULL").distinct()
    return names.mapInArrow(ratio, "name string, score double").where(F.col("score") >= cutoff).orderBy(F.desc("score"), F.desc("name")).limit(n)


def nth_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The ``n``-th row (from 1) of every group in the given order, descending."""
    w = Window.partitionBy(*(c(k) for k in keys)).orderBy(*(c(o).desc() for o in order))
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") == n).drop("__n")


def search(df: DataFrame, name: str, text: str, season: str, wanted: int | None = None) -> DataFrame:
    """Rows whose name contains ``text`` (any case): the wanted season, or each player's latest."""
    hit = df.where(F.coalesce(F.contains(F.lower(c(name)), F.lit(text.lower())), F.lit(False)))
    if wanted is not None:
        return hit.where(c(season) == wanted)
    w = Window.partitionBy(c(name)).orderBy(c(season).desc())
    return hit.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
