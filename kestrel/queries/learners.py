"""Learners whose answers SQL can state: on cells of two inputs a tree predicts means, least squares has a closed form."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import metrics
from kestrel.plans import forest, growth, tuning
from kestrel.plans import modelling as m
from kestrel.queries.files import _place
from kestrel.queries.modelling import FEATURES, _learning
from kestrel.queries.registry import Tables, query
from kestrel.queries.windows import _yearly
from kestrel.storage import materialize

#: A target that steps at a line number and a quantity, with a rest that neither explains.
CELLS = """
WITH d AS (SELECT l_orderkey, l_linenumber, l_linenumber > 3 AS late, l_quantity > 25 AS large,
                  100.0 * (l_linenumber > 3)::INT + 30.0 * (l_quantity > 25)::INT + l_orderkey % 7 AS y FROM lineitem),
c AS (SELECT late, large, count(*) AS n, avg(y) AS f FROM d GROUP BY 1, 2)
"""


def _cells(t: Tables) -> DataFrame:
    late, large = F.col("l_linenumber") > 3, F.col("l_quantity") > 25
    y = 100.0 * late.cast("int") + 30.0 * large.cast("int") + F.col("l_orderkey") % 7
    rows = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_linenumber").cast("double").alias("line"), F.col("l_quantity").cast("double").alias("quantity"),
        late.alias("late"), large.alias("large"), y.cast("double").alias("label"),
    )
    return VectorAssembler(inputCols=["line", "quantity"], outputCol="features").transform(rows)


def _means(done: DataFrame, *learners: str) -> DataFrame:
    """Predictions of each cell, a column each: one value, if the learner found the steps."""
    ends = [F.struct(F.lit(k).alias("learner"), F.min(F.round(k, 4)).alias("lowest"), F.max(F.round(k, 4)).alias("highest")) for k in learners]
    cells = done.groupBy("late", "large").agg(F.count(F.lit(1)).alias("n"), F.array(*ends).alias("e"))
    return cells.select("late", "large", "n", F.inline("e")).select("learner", "late", "large", "n", "lowest", "highest")


@query(CELLS + """
SELECT learner, late, large, n, round(f, 4) AS lowest, round(f, 4) AS highest
FROM c, (SELECT unnest(['depthwise', 'leafwise', 'symmetric', 'saved', 'extra']) AS learner)
""")
def boosted_cell_means(t: Tables) -> DataFrame:
    """One unshrunk tree of every way of growing, of two levels or four leaves, predicts the means of the four cells; a saved one too."""
    rows = _cells(t)
    one = {"rounds": 1, "rate": 1.0, "l2": 0.0, "depth": 2}
    learners = {"depthwise": growth.DepthwiseTrees(**one), "leafwise": growth.LeafwiseTrees(**one | {"depth": 3}, leaves=4), "symmetric": growth.SymmetricTrees(**one)}
    models = growth.fit_together(learners, rows)
    path = _place(t, "model")
    models["depthwise"].save(t.spark, path)
    models["saved"] = growth.ForestModel.load(t.spark, path)
    # One pass over the rows for all models.
    done = rows
    for name, model in models.items():
        done = model.transform(done).withColumnRenamed("prediction", name)
    out = _means(done, *models)
    # Two values an input leave a random cut one place.
    flags = VectorAssembler(inputCols=["line", "quantity"], outputCol="features").transform(
        rows.drop("features").withColumns({"line": F.col("late").cast("double"), "quantity": F.col("large").cast("double")})
    )
    extra = growth.ExtraTrees(trees=3, depth=2).fit(flags)
    return out.unionByName(_means(extra.transform(flags).withColumnRenamed("prediction", "extra"), "extra"))


@query(CELLS + """
, r AS (SELECT late, sum(n) AS n, sum(n * f) / sum(n) AS f FROM c GROUP BY 1),
w AS (SELECT sum(n) AS n, sum(n * f) / sum(n) AS f FROM c),
q AS (SELECT c.large, sum(r.n * c.f) / any_value(w.n) AS f FROM c JOIN r ON c.late = r.late, w GROUP BY 1),
s AS (SELECT c.late, c.large, ((r.f - w.f) + (c.f - q.f)) / 2 AS line, ((q.f - w.f) + (c.f - r.f)) / 2 AS quantity
      FROM c JOIN r ON c.late = r.late JOIN q ON c.large = q.large, w)
SELECT l_orderkey * 10 + l_linenumber AS id, feature, round(CASE feature WHEN 'line' THEN line ELSE quantity END, 4) AS shap
FROM d JOIN s ON d.late = s.late AND d.large = s.large, (SELECT unnest(['line', 'quantity']) AS feature)
""")
def tree_shap_of_cells(t: Tables) -> DataFrame:
    """Exact SHAP values along the paths of a tree with four leaves."""
    rows = _cells(t)
    model = DecisionTreeRegressor(maxDepth=2, maxBins=64, labelCol="label").fit(rows)
    values = forest.tree_shap(forest.of_mllib(model), rows, "id", ["line", "quantity"])
    return values.select("id", "feature", F.round("shap", 4).alias("shap"))


@query(CELLS + """
, r AS (SELECT late, sum(n) AS n, sum(n * f) / sum(n) AS f FROM c GROUP BY 1),
w AS (SELECT sum(n * f) / sum(n) AS f FROM c),
g AS (SELECT (SELECT sum(r.n * (r.f - w.f) ** 2) FROM r, w) AS line, (SELECT sum(c.n * (c.f - r.f) ** 2) FROM c JOIN r ON c.late = r.late) AS quantity)
SELECT 'line' AS feature, round(line / (line + quantity), 6) AS gain FROM g UNION ALL SELECT 'quantity', round(quantity / (line + quantity), 6) FROM g
""")
def gain_of_cells(t: Tables) -> DataFrame:
    """Gain importances of a tree with four leaves: the shares of the squares that its splits explain."""
    model = DecisionTreeRegressor(maxDepth=2, maxBins=64, labelCol="label").fit(_cells(t))
    return m.gain_importance(t.spark, model, ["line", "quantity"]).select("feature", F.round("gain", 6).alias("gain"))


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    data = _learning(t).withColumn("group", F.when(F.col("lines") >= 4, "many").otherwise("few"))
    return data.where("o_orderkey % 2 = 0"), data.where("o_orderkey % 2 <> 0")


def _least_squares() -> LinearRegression:
    return LinearRegression(labelCol="label", weightCol="weight", solver="normal")


SPLIT = """
WITH s AS (SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS x FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, o_totalprice AS y, x, CASE WHEN lines >= 4 THEN 'many' ELSE 'few' END AS "group", 1 / ln(1 + o_totalprice) AS w
      FROM orders JOIN s ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)
"""
#: Weighted least squares of z on x, by sums.
LINE = "(sum(w) * sum(w * x * z) - sum(w * x) * sum(w * z)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2) AS slope, sum(w * z) / sum(w) AS mz, sum(w * x) / sum(w) AS mx"


@query(SPLIT + f"""
, e AS (SELECT *, ln(1 + y) AS z FROM d WHERE o_orderkey % 2 = 0),
a AS (SELECT {LINE} FROM e), o AS (SELECT "group", {LINE} FROM e GROUP BY 1),
p AS (SELECT d."group", y, greatest(exp(a.mz + a.slope * (x - a.mx)) - 1, 0) AS p_all, greatest(exp(o.mz + o.slope * (x - o.mx)) - 1, 0) AS p_own
      FROM d JOIN o ON d."group" = o."group", a WHERE o_orderkey % 2 <> 0)
SELECT "group", count(*) AS n, round(avg(abs(y - p_all)), 2) AS mae_all, round(avg(abs(y - p_own)), 2) AS mae_own,
       round(avg(abs(y - p_all)) - avg(abs(y - p_own)), 2) AS gain FROM p GROUP BY 1
""")
def specialised_errors(t: Tables) -> DataFrame:
    """Errors on unseen rows of a line through all rows and of each group's own line."""
    found = m.specialised(*_split(t), "o_totalprice", ["qty"], "group", _least_squares)
    return found.select("group", "n", *(F.round(k, 2).alias(k) for k in ("mae_all", "mae_own", "gain")))


TRANSFORMED = {"raw": ("y", "p"), "log1p": ("ln(1 + y)", "exp(p) - 1"), "log10": ("log10(y + 1)", "10 ** p - 1"), "sqrt": ("sqrt(y)", "p * p")}


@query(SPLIT + ", e AS (" + " UNION ALL ".join(f"SELECT '{n}' AS transform, o_orderkey, y, x, w, {f} AS z FROM d" for n, (f, _) in TRANSFORMED.items()) + f"""),
a AS (SELECT transform, {LINE} FROM e WHERE o_orderkey % 2 = 0 GROUP BY 1),
p AS (SELECT e.transform, y, mz + slope * (x - mx) AS p FROM e JOIN a ON e.transform = a.transform WHERE o_orderkey % 2 <> 0),
b AS (SELECT transform, y, greatest(CASE transform """ + " ".join(f"WHEN '{n}' THEN {back}" for n, (_, back) in TRANSFORMED.items()) + """ END, 0) AS p FROM p)
SELECT transform, count(*) AS n, round(avg(abs(y - p)), 2) AS mae, row_number() OVER (ORDER BY avg(abs(y - p)))::INT AS place FROM b GROUP BY 1
""")
def transform_errors(t: Tables) -> DataFrame:
    """Errors of a line fitted on every transform of the target, on the target's own scale, best first."""
    rows = m.best_transform(*_split(t), "o_totalprice", ["qty"], tuple(metrics.TRANSFORMS), _least_squares).collect()  # a row a transform
    return t.spark.createDataFrame([(r.transform, r.n, round(r.mae, 2), k + 1) for k, r in enumerate(rows)], "transform string, n long, mae double, place int")


@query(SPLIT + f"""
, e AS (SELECT *, ln(1 + y) AS z FROM d WHERE o_orderkey % 2 = 0),
q AS (SELECT quantile_cont(y, 0.25) AS a, quantile_cont(y, 0.75) AS b FROM e),
l AS (SELECT 'all' AS model, count(*) AS n_train, {LINE} FROM e UNION ALL SELECT 'trimmed', count(*), {LINE} FROM e, q WHERE y <= b + 1.5 * (b - a))
SELECT model, n_train, count(*) AS n, round(avg(abs(y - greatest(exp(mz + slope * (x - mx)) - 1, 0))), 2) AS mae
FROM d, l WHERE o_orderkey % 2 <> 0 GROUP BY 1, 2
""")
def trimmed_model_errors(t: Tables) -> DataFrame:
    """A line refitted without the target's outliers, scored on all unseen rows beside the one with them."""
    found = m.trimmed_errors(*_split(t), "o_totalprice", ["qty"], _least_squares)
    return found.select("model", "n_train", "n", F.round("mae", 2).alias("mae"))


@query("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, sum(o_totalprice) AS value FROM orders GROUP BY 1, 2),
b AS (SELECT c_mktsegment AS cluster, value / first_value(value) OVER w * 100 AS base, row_number() OVER w AS rank
      FROM y JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY o_custkey ORDER BY year))
SELECT cluster, rank::INT AS rank, round(avg(base), 4) AS base_100, count(*) AS n FROM b GROUP BY 1, 2 HAVING count(*) >= 30
""")
def cluster_courses(t: Tables) -> DataFrame:
    """Given clusters (market segments) joined back to the yearly values: mean course in per cent of the first year, 30 players at least."""
    history = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.sum("o_totalprice").alias("value"))
    given = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("cluster"))
    out = m.cluster_courses(m.with_history(given, history, "o_custkey"), "o_custkey", "year", "value")
    return out.select("cluster", F.col("rank").cast("int").alias("rank"), F.round("base_100", 4).alias("base_100"), "n")


@query("""
WITH z AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER () AS a,
                  (c_nationkey - avg(c_nationkey) OVER ()) / stddev_samp(c_nationkey) OVER () AS b FROM customer),
r AS (SELECT corr(a, b) AS r FROM z)
SELECT c_custkey, round((a + sign(r) * b) / sqrt(2), 5) AS x, round((a - sign(r) * b) / sqrt(2), 5) AS y FROM z, r
""")
def cluster_places(t: Tables) -> DataFrame:
    """Places in the plane of two standardised inputs: along the diagonals, the one of more variance first."""
    out = m.cluster_plane(t.customer.select("c_custkey", "c_acctbal", "c_nationkey"), ["c_acctbal", "c_nationkey"])
    return out.select("c_custkey", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


@query("SELECT learner, true AS better_than_mean FROM (SELECT unnest(['depthwise', 'leafwise', 'symmetric', 'forest', 'extra', 'svr']) AS learner)")
def tree_learners(t: Tables) -> DataFrame:
    """Three boosters, two averaged forests and a kernel machine on a target that follows its inputs: each halves the mean's error on unseen rows."""
    data, _ = materialize(_learning(t).withColumn("o_totalprice", 3 * F.col("qty") * F.col("lines") + 500), "learning")
    train, test = data.where("o_orderkey % 2 = 0"), data.where("o_orderkey % 2 <> 0")
    ready, unseen = m.prepare(train, "o_totalprice", FEATURES), m.prepare(test, "o_totalprice", FEATURES)
    learners = {"depthwise": growth.DepthwiseTrees(rounds=3, depth=3, rate=0.7), "leafwise": growth.LeafwiseTrees(rounds=3, leaves=8, depth=4, rate=0.7)}
    learners |= {"symmetric": growth.SymmetricTrees(rounds=3, depth=3, rate=0.7), "extra": growth.ExtraTrees(trees=8, depth=4)}
    learners["forest"] = RandomForestRegressor(labelCol="label", weightCol="weight", numTrees=5, maxDepth=5, seed=m.SEED)
    learners["svr"] = tuning.kernel_svr(c=10.0, epsilon=0.1, landmarks=64)
    names = []
    for name, e in learners.items():
        unseen = m.scored(e.fit(ready), unseen, f"p_{name}")
        names.append(f"p_{name}")
    ranked = m.ranking(unseen, "o_totalprice", names)
    return ranked.select(F.substr("model", F.lit(3)).alias("learner"), (F.col("r2") > 0.5).alias("better_than_mean"))


@query("""
WITH c AS (SELECT unnest([120000.0, 135000.0, 150000.0, 165000.0, 180000.0])::DOUBLE AS centre), o AS (SELECT o_totalprice AS y FROM orders)
SELECT centre, round(sqrt(avg((y - centre) ** 2)), 2) AS rmse, centre = arg_min(centre, sqrt(avg((y - centre) ** 2))) OVER () AS best FROM o, c GROUP BY centre
""")
def searched_centres(t: Tables) -> DataFrame:
    """A search over listed values whose loss is an aggregate of the orders: every trial's loss, and the value found."""
    orders = t.orders.select(F.col("o_totalprice").alias("y")).cache()
    loss = lambda p: orders.agg(F.sqrt(F.avg((F.col("y") - p["centre"]) ** 2))).first()[0]
    best, _, done = tuning.search(loss, {"centre": [120000.0, 135000.0, 150000.0, 165000.0, 180000.0]}, trials=40, first=30)
    orders.unpersist()
    found = sorted({(p["centre"], round(v, 2), p["centre"] == best["centre"]) for p, v in done})
    return t.spark.createDataFrame(found, "centre double, rmse double, best boolean")


@query("""
WITH g AS (SELECT i / 10.0 AS lam FROM range(-20, 41) r(i)),
t AS (SELECT lam, count(*) AS n, sum(ln(1 + o_totalprice)) AS j, var_pop(CASE WHEN lam = 0 THEN ln(1 + o_totalprice) ELSE ((o_totalprice + 1) ** lam - 1) / lam END) AS v FROM orders, g GROUP BY lam),
b AS (SELECT arg_max(lam, -n / 2 * ln(v) + (lam - 1) * j) AS lam FROM t),
m AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) AS min_max, round(log10(o_totalprice + 1), 6) AS log10,
       round(CASE WHEN lam = 0 THEN ln(1 + o_totalprice) ELSE ((o_totalprice + 1) ** lam - 1) / lam END, 4) AS yeo_johnson FROM orders, b, m
""")
def transformed_targets(t: Tables) -> DataFrame:
    """Targets on other scales: min-max, log10, Yeo-Johnson at the lambda of greatest likelihood."""
    o, y = t.orders.select("o_orderkey", "o_totalprice"), F.col("o_totalprice")
    out = metrics.min_max_target(o, o, "o_totalprice", "min_max")
    lam = metrics.fit_yeo_johnson(o, "o_totalprice")
    out = out.withColumns({"log10": metrics.TRANSFORMS["log10"][0](y), "yeo_johnson": metrics.yeo_johnson(y, lam)})
    return out.select("o_orderkey", F.round("min_max", 6).alias("min_max"), F.round("log10", 6).alias("log10"), F.round("yeo_johnson", 4).alias("yeo_johnson"))


@query()
def close_matches(t: Tables) -> DataFrame:
    """Names most like a misspelt one, by matching blocks."""
    return m.suggestions(t.supplier, "s_name", "Suplier#00000001")


@query("""
WITH d AS (SELECT c_custkey, year(o_orderdate) AS year, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT count(DISTINCT c_custkey) AS players, count(*) AS seasons FROM d WHERE c_custkey IN (SELECT c_custkey FROM d GROUP BY 1 HAVING count(*) >= 3)
""")
def clustered_history(t: Tables) -> DataFrame:
    """Clusters joined back to the seasons they were made of."""
    history = _yearly(t)
    done = m.with_history(m.trajectories(m.trajectory_stats(history, "o_custkey", "year", "value")), history, "o_custkey")
    return done.agg(F.countDistinct("o_custkey").alias("players"), F.count("cluster").alias("seasons"))
