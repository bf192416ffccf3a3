"""Models on orders and customers: stacking, clusters, components, importance, sensitivity."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.aggregates import profile
from kestrel.operators.splits import hashed
from kestrel.plans import explain, tuning
from kestrel.plans import modelling as m
from kestrel.queries.registry import Tables, query
from kestrel.queries.windows import _yearly
from kestrel.storage import materialize

FEATURES = ["lines", "qty", "avg_discount", "c_acctbal"]


def _learning(t: Tables) -> DataFrame:
    """Per order: total price, and features of its lines and customer."""
    s = t.lineitem.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).cast("double").alias("lines"), F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("avg_discount")
    )
    return (
        t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "o_totalprice", *FEATURES, F.year("o_orderdate").alias("year"))
    )


def _learners():
    return {
        "ols": LinearRegression(labelCol="label", weightCol="weight", solver="normal", regParam=1e-6),
        "boosted": GBTRegressor(labelCol="label", featuresCol="features", weightCol="weight", maxIter=5, maxDepth=3, seed=m.SEED),
    }


@query("""
WITH s AS (SELECT l_orderkey, sum(l_quantity) AS x FROM lineitem GROUP BY 1)
SELECT round(regr_slope(o_totalprice, x), 4) AS slope, round(regr_intercept(o_totalprice, x), 2) AS intercept,
       round(regr_r2(o_totalprice, x), 6) AS r2, count(*) AS n FROM orders JOIN s ON o_orderkey = l_orderkey
""")
def ols_single(t: Tables) -> DataFrame:
    x, y = F.col("qty"), F.col("o_totalprice")
    return _learning(t).agg(
        F.round(F.regr_slope(y, x), 4).alias("slope"),
        F.round(F.regr_intercept(y, x), 2).alias("intercept"),
        F.round(F.regr_r2(y, x), 6).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


@query()
def stacked_ranking(t: Tables) -> DataFrame:
    """Out-of-fold stack of two learners, trained on one hashed split and ranked on the other."""
    data, _ = materialize(hashed(_learning(t), ["o_orderkey"], {"train": 0.7, "test": 0.3}), "learning")
    stack = m.Stack(FEATURES, "o_totalprice").fit(data.where("split = 'train'"), ["o_orderkey"], 3, _learners())
    done = stack.predict(data.where("split = 'test'"))
    return m.ranking(done, "o_totalprice", ["p_ols", "p_boosted", "predicted"])


@query()
def trajectory_clusters(t: Tables) -> DataFrame:
    return m.trajectories(m.trajectory_stats(_yearly(t), "o_custkey", "year", "value"))


@query()
def principal_components(t: Tables) -> DataFrame:
    out, _ = m.reduced(_learning(t), FEATURES, 0.95)
    return out.select("o_orderkey", "components")


@query()
def permutation_importance(t: Tables) -> DataFrame:
    data, _ = materialize(_learning(t), "learning")
    model = _learners()["ols"].fit(m.prepare(data, "o_totalprice", FEATURES))
    score = lambda df: m.scored(model, m.prepare(df, "o_totalprice", FEATURES), "predicted")
    return m.permutation_importance(score, data, FEATURES, "o_totalprice", repeats=1)


@query("""
WITH p AS (SELECT median(p_size) AS p_size, median(p_retailprice) AS p_retailprice FROM part)
SELECT 'p_size' AS variable, g::DOUBLE AS value, g::DOUBLE AS p_size, p_retailprice FROM p, unnest([1, 10, 20, 50]) u(g)
UNION ALL SELECT 'p_retailprice', g::DOUBLE, p_size, g::DOUBLE FROM p, unnest([900, 1500]) u(g)
""")
def sensitivity_grid(t: Tables) -> DataFrame:
    reference = profile(t.part, ["p_size", "p_retailprice"], [])
    return m.sensitivity(reference, {"p_size": [1, 10, 20, 50], "p_retailprice": [900, 1500]}).select("variable", "value", "p_size", "p_retailprice")


@query("""
WITH s AS (SELECT l_orderkey, sum(l_quantity) AS qty, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1)
SELECT l_orderkey AS o_orderkey, round(2.0 * (qty - avg(qty) OVER ()), 6) AS shap_qty,
       round(-1.5 * (lines - avg(lines) OVER ()), 6) AS shap_lines FROM s JOIN orders ON o_orderkey = l_orderkey
""")
def linear_shap(t: Tables) -> DataFrame:
    out = m.linear_shap(_learning(t), ["qty", "lines"], [2.0, -1.5])
    return out.select("o_orderkey", F.round("shap_qty", 6).alias("shap_qty"), F.round("shap_lines", 6).alias("shap_lines"))


@query("""
WITH s AS (SELECT l_orderkey, sum(l_quantity) AS qty, count(*)::DOUBLE AS lines FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, qty, lines, c_acctbal FROM s JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey),
b AS (SELECT avg(qty) AS qty, avg(lines) AS lines, avg(c_acctbal) AS c_acctbal FROM (SELECT * FROM d ORDER BY o_orderkey LIMIT 8))
SELECT o_orderkey, 'volume' AS feature, round(2.0 * (d.qty - b.qty) - 1.5 * (d.lines - b.lines), 4) AS shap FROM d, b
UNION ALL SELECT o_orderkey, 'c_acctbal', round(0.25 * (d.c_acctbal - b.c_acctbal), 4) FROM d, b
""")
def sampled_shap_groups(t: Tables) -> DataFrame:
    """Sampled SHAP of a linear score against eight background orders, added up by group of inputs."""
    data, names = _learning(t), ["qty", "lines", "c_acctbal"]
    score = lambda df: df.withColumn("predicted", 2 * F.col("qty") - 1.5 * F.col("lines") + 0.25 * F.col("c_acctbal"))
    values = explain.sampled_shap(score, data, data.orderBy("o_orderkey").limit(8), "o_orderkey", names, ["o_orderkey"], walks=8)
    out = explain.grouped(values, "o_orderkey", {"volume": ["qty", "lines"]})
    return out.select("o_orderkey", "feature", F.round("shap", 4).alias("shap"))


@query()
def local_surrogate(t: Tables) -> DataFrame:
    """Conditions that carry one order's predicted price, with their impacts."""
    data = _learning(t)
    model = _learners()["ols"].fit(m.prepare(data, "o_totalprice", FEATURES))
    score = lambda df: m.scored(model, m.prepare(df.withColumn("o_totalprice", F.lit(0.0)), "o_totalprice", FEATURES), "predicted")
    row = data.orderBy(F.desc("o_totalprice"), "o_orderkey").first().asDict()
    found = explain.surrogate(score, row, data, FEATURES)
    return t.spark.createDataFrame([(n, explain.readable(n, row, {}), v) for n, v in found], "condition string, label string, impact double")


@query()
def parameter_search(t: Tables) -> DataFrame:
    """Trials of a search for the regularisation of a linear learner, in order."""
    table, _ = materialize(hashed(_learning(t), ["o_orderkey"], {"train": 0.7, "test": 0.3}), "learning")
    data = m.prepare(table, "o_totalprice", FEATURES)
    make = lambda p: LinearRegression(labelCol="label", weightCol="weight", regParam=p["reg"], elasticNetParam=p["mix"])
    space = {"reg": tuning.Range(1e-4, 1, log=True), "mix": [0.0, 0.5, 1.0]}
    done = tuning.tune(make, space, data.where("split = 'train'"), data.where("split = 'test'"), trials=12)[2]
    return t.spark.createDataFrame([(i, p["reg"], p["mix"], v) for i, (p, v) in enumerate(done)], "trial int, reg double, mix double, rmse double")
