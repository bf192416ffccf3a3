"""Selections, formats, correlations, target inverses, comparisons and searches."""

from __future__ import annotations

from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.numbers import finite
from kestrel.functions.seasons import age_at, month_label, season_from_code
from kestrel.functions.text import per_cent, strip_parentheses, thousands
from kestrel.operators import aggregates, columns, metrics, splits, windows
from kestrel.operators.splits import hashed
from kestrel.plans import modelling as m
from kestrel.queries.modelling import FEATURES, _learning
from kestrel.queries.registry import Tables, query
from kestrel.queries.windows import YEARLY, _yearly


@query(f"""
WITH y AS ({YEARLY}), l AS (SELECT *, lag(value) OVER w AS v0, lag(year) OVER w AS y0 FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY year))
SELECT o_custkey, year, round(CASE WHEN year - y0 = 1 THEN value - v0 END, 4) AS gap,
       round(CASE WHEN year - y0 = 1 THEN (value - v0) / nullif(v0, 0) * 100 END, 4) AS gap_pct FROM l
""")
def value_gaps(t: Tables) -> DataFrame:
    """Change of value against the season just before, absolute and in per cent; null where seasons do not follow."""
    y = windows.delta(_yearly(t), ["o_custkey"], "year", "value", "gap", None)
    y = windows.relative_delta(y, ["o_custkey"], "year", "value", "gap_pct")
    return y.select("o_custkey", "year", F.round("gap", 4).alias("gap"), F.round("gap_pct", 4).alias("gap_pct"))


@query("""
SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)::INT AS n
FROM orders) WHERE n IN (1, 3)
""")
def latest_and_third(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    parts = [m.nth_of_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], n).withColumn("n", F.lit(n)) for n in (1, 3)]
    return parts[0].unionByName(parts[1]).drop("o_orderdate")


@query("""
SELECT p_partkey, contains(p_type, 'BRASS') AS keeper FROM part
""")
def keeper_split(t: Tables) -> DataFrame:
    gk, field = splits.by_position(t.part.select("p_partkey", "p_type"), "p_type", "BRASS")
    return gk.withColumn("keeper", F.lit(True)).unionByName(field.withColumn("keeper", F.lit(False))).drop("p_type")


@query("SELECT d.doc_id, lang, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def complete_columns(t: Tables) -> DataFrame:
    """Columns without a null in the training rows: the label's two are missing somewhere and go."""
    d = t.documents.select("doc_id", "lang", "source").join(t.labels, "doc_id", "left")
    return columns.complete_in(d, d)


@query("SELECT 0.0::DOUBLE AS age, s_suppkey, s_acctbal FROM supplier")
def aligned_signature(t: Tables) -> DataFrame:
    return columns.align(t.supplier, ["age", "s_suppkey", "s_acctbal"])


@query("SELECT s_acctbal, s_name FROM supplier")
def selected_existing(t: Tables) -> DataFrame:
    return columns.select_existing(t.supplier, ["s_acctbal", "no such column", "s_name"])


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def prefixed_columns(t: Tables) -> DataFrame:
    mixed = t.nation.withColumn("other", F.lit(1))
    return mixed.select(*columns.with_prefix(mixed, "n_"))


@query("SELECT d.doc_id, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality IS NOT NULL AND lang IS NOT NULL")
def known_in_subset(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.na.drop(subset=["quality", "lang"]).drop("lang")


@query("SELECT s_suppkey, s_acctbal, s_name FROM supplier")
def varying_columns(t: Tables) -> DataFrame:
    """Numeric columns of one value go."""
    return columns.without_constant(t.supplier.select("s_suppkey", "s_acctbal", "s_name").withColumn("constant", F.lit(7)))


@query("SELECT n_nationkey AS \"Nation_key\", n_name AS \"Nation_name\", n_regionkey AS region FROM nation")
def joined_header_levels(t: Tables) -> DataFrame:
    levels = [["Nation", "key"], ["Nation", "name"], ["Unnamed: 2_level_0", "region"]]
    return t.nation.select("n_nationkey", "n_name", "n_regionkey").toDF(*(columns.join_levels(x) for x in levels))


@query("SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def shared_keys(t: Tables) -> DataFrame:
    return t.orders.select("o_custkey").intersect(t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"))


@query("""
SELECT doc_id, CASE WHEN lang IS NULL THEN 'Unknown' ELSE lang END AS lang, coalesce(quality, 0) AS quality
FROM (SELECT d.doc_id, CASE WHEN d.doc_id % 7 <> 0 THEN lang END AS lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
""")
def filled_by_type(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))
    return columns.fill_by_type(d.join(t.labels.select("doc_id", "quality"), "doc_id", "left"))


@query("""
SELECT o_orderkey, replace(format('{:,}', round_even(o_totalprice, 0)::BIGINT), ',', ' ') || ' €' AS euros,
       printf('%.2f%%', o_totalprice / 1234567.89::DOUBLE * 100) AS share FROM orders
""")
def formatted_values(t: Tables) -> DataFrame:
    price = F.col("o_totalprice")
    return t.orders.select("o_orderkey", thousands(price, unit=" €").alias("euros"), per_cent(price / 1_234_567.89).alias("share"))


@query("""
SELECT ['Jan', 'Fév', 'Mar', 'Avr', 'Mai', 'Juin', 'Juil', 'Août', 'Sep', 'Oct', 'Nov', 'Déc'][month(o_orderdate)] AS label, count(*) AS n FROM orders GROUP BY 1
""")
def month_labels(t: Tables) -> DataFrame:
    return t.orders.groupBy(month_label(F.col("o_orderdate")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p_partkey, trim(regexp_replace(regexp_replace(p_name || ' (' || p_brand || ')  x', '\\([^)]*\\)', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part
""")
def without_parentheses(t: Tables) -> DataFrame:
    told = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")  x"))
    return t.part.select("p_partkey", strip_parentheses(told).alias("name"))


@query("""
SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 2021 - 1 WHEN 1 THEN 2023 WHEN 2 THEN 2019 END AS season FROM supplier
""")
def season_codes(t: Tables) -> DataFrame:
    """"2021.0", "23/24", "2019/2020" and anything else."""
    k = F.col("s_suppkey") % 4
    code = F.when(k == 0, "2021.0").when(k == 1, "23/24").when(k == 2, "2019/2020").otherwise("n/a")
    return t.supplier.select("s_suppkey", season_from_code(code).alias("season"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal END AS x FROM supplier")
def infinite_to_null(t: Tables) -> DataFrame:
    k = F.col("s_suppkey") % 3
    wild = F.when(k == 0, F.col("s_acctbal")).when(k == 1, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return t.supplier.select("s_suppkey", finite(wild).alias("x"))


@query("SELECT o_orderkey, (2025 - year(o_orderdate))::INT AS age FROM orders")
def age_at_reference(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", age_at(F.year("o_orderdate"), 2025).alias("age"))


@query("""
WITH s AS (SELECT stddev_samp(l_extendedprice) FILTER (l_quantity < 25) AS a, stddev_samp(l_extendedprice) FILTER (l_quantity >= 25) AS b FROM lineitem)
SELECT round(a, 4) AS std_below, round(b, 4) AS std_from, round((1 - b / a) * 100, 4) AS reduction_pct FROM s
""")
def noise_reduction(t: Tables) -> DataFrame:
    return aggregates.noise_reduction(t.lineitem, "l_quantity", "l_extendedprice", 25)


NAMES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")


@query("SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS feature, round(corr({n}, l_extendedprice), 6) AS r FROM lineitem" for n in NAMES) + ") ORDER BY abs(r) DESC, feature LIMIT 3")
def strongest_correlations(t: Tables) -> DataFrame:
    """The three columns that go most with the target, by absolute value."""
    return aggregates.target_correlations(t.lineitem, NAMES, "l_extendedprice", 3)


SIZES = ("1-URGENT", "3-MEDIUM", "5-LOW")


@query(
    "WITH h AS (SELECT o_orderstatus, " + ", ".join(f"coalesce(median(o_totalprice) FILTER (o_orderpriority = '{s}'), 0) AS \"{s}\"" for s in SIZES)
    + " FROM orders GROUP BY 1) SELECT *, row_number() OVER (ORDER BY list_sort([" + ", ".join(f'"{s}"' for s in SIZES) + "])[2] DESC, o_orderstatus)::INT AS place FROM h"
)
def ordered_heatmap(t: Tables) -> DataFrame:
    """Medians of status by priority; rows numbered by the median of their cells, highest first."""
    cells = aggregates.median_pivot(t.orders, "o_orderstatus", "o_orderpriority", SIZES, "o_totalprice")
    return aggregates.rows_by_median(cells, ["o_orderstatus"], SIZES, "place")


@query("""
SELECT o_orderkey, round(o_totalprice, 2) AS min_max, round(o_totalprice, 2) AS yeo_johnson, round(o_totalprice, 2) AS quantile, round(o_totalprice, 2) AS log10 FROM orders
""")
def target_round_trips(t: Tables) -> DataFrame:
    """Targets transformed and taken back: min-max, Yeo-Johnson, quantiles, log10."""
    o = t.orders.select("o_orderkey", "o_totalprice")
    y = F.col("o_totalprice")
    out = metrics.min_max_target(o, o, "o_totalprice", "z")
    out = metrics.from_min_max(out, o, "o_totalprice", "z", "min_max")
    lam = metrics.fit_yeo_johnson(o, "o_totalprice")
    out = out.withColumn("yeo_johnson", metrics.from_yeo_johnson(metrics.yeo_johnson(y, lam), lam))
    grid = metrics.quantile_grid(o, "o_totalprice")  # the same both ways
    out = metrics.quantile_uniform(out, "o_totalprice", "u", grid=grid)
    out = metrics.from_quantile_uniform(out, o, "o_totalprice", "u", "quantile", grid=grid)
    forward, back = metrics.TRANSFORMS["log10"]
    out = out.withColumn("log10", back(forward(y)))
    return out.select("o_orderkey", *(F.round(n, 2).alias(n) for n in ("min_max", "yeo_johnson", "quantile", "log10")))


@query("""
WITH g AS (SELECT quantile_cont(o_totalprice, list_transform(range(101), lambda i: i / 100.0)) AS q FROM orders),
k AS (SELECT o_orderkey, o_totalprice AS y, q, greatest(least(len(list_filter(q, lambda x: x <= o_totalprice)), 100), 1) AS k FROM orders, g)
SELECT o_orderkey, round(greatest(least((k - 1 + coalesce((y - q[k]) / nullif(q[k + 1] - q[k], 0), 0)) / 100, 1), 0), 6) AS u FROM k
""")
def quantile_positions(t: Tables) -> DataFrame:
    out = metrics.quantile_uniform(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "u")
    return out.select("o_orderkey", F.round("u", 6).alias("u"))


@query("""
SELECT o_orderkey, o_totalprice AS vm_reelle_euros, round(o_totalprice * 1.1, 0) AS vm_predite_euros, round((o_totalprice * 1.1 - o_totalprice) / o_totalprice * 100, 2) AS ecart_pct FROM orders
""")
def exported_predictions(t: Tables) -> DataFrame:
    return m.export(t.orders.withColumn("p", F.col("o_totalprice") * 1.1), "o_totalprice", "p", ["o_orderkey"])


@query("""
SELECT 30.0::DOUBLE AS age, 900.0::DOUBLE AS age_sq, 1 AS "pos_MF", 0 AS "pos_GK", 1 AS foot_left, 0 AS foot_right, median(p_size) AS p_size FROM part
""")
def manual_entry(t: Tables) -> DataFrame:
    """The default profile with a manual entry in business terms over it; unknown fields are ignored."""
    blank = {n: F.lit(0) for n in ("pos_MF", "pos_GK", "foot_left", "foot_right")}
    profile = aggregates.profile(t.part, ["p_size"], []).withColumns({"age": F.lit(25.0), "age_sq": F.lit(625.0), **blank})
    given = m.entered({"age": 30.0, "poste": "Milieu", "pied": "Gauche", "inconnu": 5})
    return m.manual_row(profile, given).select("age", "age_sq", "pos_MF", "pos_GK", "foot_left", "foot_right", "p_size")


@query("""
SELECT p_partkey, p_name, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey) AS n FROM part WHERE contains(lower(p_name), 'an'))
WHERE n = 1
""")
def player_search(t: Tables) -> DataFrame:
    """Rows whose name holds a text, the latest of each name."""
    one = windows.top_n(t.part.select("p_partkey", "p_name", "p_size"), ["p_name", "p_size"], [F.col("p_partkey")], 1).drop("rank")
    return m.search(one, "p_name", "AN", "p_size")


@query("SELECT o_orderkey, round((o_totalprice + o_totalprice * 2) / 2, 4) AS predicted FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, round(o_totalprice, 4) FROM orders WHERE o_orderkey % 3 = 0")
def mean_blend(t: Tables) -> DataFrame:
    """The mean of those predictions that are known."""
    o = t.orders.withColumn("p1", F.col("o_totalprice")).withColumn("p2", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * 2))
    return m.mean_blend(o, ["p1", "p2"]).select("o_orderkey", F.round("predicted", 4).alias("predicted"))


@query("""
WITH e AS (SELECT 'low' AS model, abs(o_totalprice - greatest(o_totalprice - 500000, 0)) AS e FROM orders
           UNION ALL SELECT 'high', abs(o_totalprice - o_totalprice * 1.2) FROM orders UNION ALL SELECT 'near', abs(o_totalprice - o_totalprice * 0.95) FROM orders),
g AS (SELECT model, count(*) AS n, round(avg(e), 4) AS mae FROM e GROUP BY 1)
SELECT *, mae = min(mae) OVER () AS champion FROM g
""")
def final_comparison(t: Tables) -> DataFrame:
    """Approaches on the same rows, clipped at zero; the first by MAE is the champion."""
    y = F.col("o_totalprice")
    o = t.orders.select(y, (y - 500_000).alias("low"), (y * 1.2).alias("high"), (y * 0.95).alias("near"))
    return m.champion(o, "o_totalprice", ["low", "high", "near"]).select("model", "n", F.round("mae", 4).alias("mae"), "champion")


def _split(t: Tables) -> tuple[DataFrame, DataFrame]:
    data = _learning(t).withColumn("even", F.col("o_orderkey") % 2 == 0).withColumn("group", F.when(F.col("lines") >= 4, "many").otherwise("few"))
    return data.where("even").drop("even"), data.where("NOT even").drop("even")


def _linear():
    return LinearRegression(labelCol="label", weightCol="weight", regParam=1e-4)


@query("""
SELECT CASE WHEN lines >= 4 THEN 'many' ELSE 'few' END AS "group", count(*) AS n, true AS adds_up FROM
(SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderkey % 2 <> 0 GROUP BY 1
""")
def specialised_models(t: Tables) -> DataFrame:
    """Each group's own model beside the model of all rows: rows, and whether the gain is the difference of their errors."""
    found = m.specialised(*_split(t), "o_totalprice", FEATURES, "group", _linear)
    whole = (F.abs(F.col("mae_all") - F.col("mae_own") - F.col("gain")) < 1e-6) & (F.col("mae_all") > 0) & (F.col("mae_own") > 0)
    return found.select("group", "n", whole.alias("adds_up"))


@query("""
SELECT name AS transform, n, true AS ordered FROM (SELECT unnest(['raw', 'log1p', 'log10', 'sqrt']) AS name),
(SELECT count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 2 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem))
""")
def best_target_transform(t: Tables) -> DataFrame:
    """One learner on every transform of the target, scored on the target's scale, best first."""
    rows = m.best_transform(*_split(t), "o_totalprice", FEATURES, tuple(metrics.TRANSFORMS), _linear).collect()  # a row a transform
    told = [float(f"{r.mae:.8e}") for r in rows]  # transforms that differ by a factor tie but for rounding
    ordered = told == sorted(told)
    return t.spark.createDataFrame([(r.transform, r.n, ordered) for r in rows], "transform string, n long, ordered boolean")


@query("SELECT 4::BIGINT AS inputs, 1.0::DOUBLE AS total, true AS falling")
def gain_importances(t: Tables) -> DataFrame:
    train, _ = _split(t)
    tree = GBTRegressor(labelCol="label", weightCol="weight", maxIter=3, maxDepth=3, seed=m.SEED).fit(m.prepare(train, "o_totalprice", FEATURES))
    gains = [r.gain for r in m.gain_importance(t.spark, tree, FEATURES).collect()]  # a row an input
    return t.spark.createDataFrame([(len(gains), round(sum(gains), 6), gains == sorted(gains, reverse=True))], "inputs long, total double, falling boolean")


@query("SELECT * FROM (VALUES (0.0::DOUBLE, 3), (0.15, 2), (0.9, 2)) v(threshold, features)")
def importance_thresholds(t: Tables) -> DataFrame:
    """Inputs above each threshold - at least two - and a model on each choice."""
    told = t.spark.createDataFrame([("qty", 0.5), ("lines", 0.3), ("avg_discount", 0.1), ("c_acctbal", -0.1)], "feature string, importance double")
    found = m.select_by_threshold(told, "importance", [0.0, 0.15, 0.9], *_split(t), "o_totalprice", _linear, least=2)
    return found.where("mae > 0").select("threshold", "features")


#: SQL of the share of its range that the MD5 of an order's key takes.
SHARE = "('0x' || substr(md5('1308|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT o_orderkey, CASE WHEN {SHARE} < 0.7 THEN 'train' WHEN {SHARE} < 0.85 THEN 'validation' ELSE 'test' END AS split FROM orders")
def hashed_three_way_split(t: Tables) -> DataFrame:
    return hashed(t.orders.select("o_orderkey"), ["o_orderkey"], {"train": 0.7, "validation": 0.15, "test": 0.15})
