"""Linkage steps, enrichment and models: rows that SQL knows, or properties that must hold."""

from __future__ import annotations

from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import repair_mojibake
from kestrel.operators import linkage, windows
from kestrel.plans import modelling as m
from kestrel.plans import tuning
from kestrel.queries.joins import corrupted_names
from kestrel.queries.modelling import FEATURES, _learning
from kestrel.queries.registry import Tables, query
from kestrel.queries.windows import _yearly
from kestrel.storage import materialize

NAMED = "SELECT p_partkey AS tm_id, p_name || ' ' || lower(to_hex(p_partkey)) AS name, p_type AS club, (p_partkey % 20)::INT AS season FROM part"
SPELT = f"""
WITH p AS ({NAMED}), l AS (
  SELECT tm_id AS row_id, season, CASE tm_id % 4 WHEN 1 THEN array_to_string(list_reverse(string_split(name, ' ')), ' ')
         WHEN 2 THEN substr(name, 2) WHEN 3 THEN name || ' jr' ELSE name END AS name FROM p)
"""


@query(SPELT + ", m AS (SELECT name, min(tm_id) AS tm_id FROM p WHERE tm_id % 3 = 0 GROUP BY 1) SELECT row_id, m.tm_id, 'exact_mapping' AS match_method FROM l JOIN m USING (name)")
def exact_mapping_step(t: Tables) -> DataFrame:
    """Names that a mapping offers, among the names that occur in the season."""
    players, mapping, _ = corrupted_names(t)
    seasonal = players.select("season", "name_clean").distinct().join(mapping, "name_clean")
    return linkage.exact_step(players, seasonal, ["season", "name_clean"], "row_id", "exact_mapping", ["tm_id"]).drop("score")


@query(SPELT + "SELECT row_id, min(tm_id) AS tm_id FROM l JOIN p USING (season, name) GROUP BY row_id")
def exact_valuation_step(t: Tables) -> DataFrame:
    players, _, clean = corrupted_names(t)
    return linkage.exact_step(players, clean, ["season", "name_clean"], "row_id", "exact_valuation", ["tm_id"]).select("row_id", "tm_id")


def _juniors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Names with a token more: their token sets nest, so each is nearest to its own name with a score of 100."""
    clean, _ = materialize(corrupted_names(t)[2], "clean")
    return clean.select(F.col("tm_id").alias("row_id"), "season", F.concat("name_clean", F.lit(" jr")).alias("name_clean"), "club_clean"), clean


@query("SELECT p_partkey AS row_id, p_partkey AS tm_id, 'fuzzy_mapping' AS match_method, 100.0::DOUBLE AS score FROM part")
def fuzzy_nested_names(t: Tables) -> DataFrame:
    left, right = _juniors(t)
    return linkage.fuzzy_step(left, right, ["season"], "name_clean", "row_id", "fuzzy_mapping", ["tm_id"])


@query("SELECT p_partkey AS row_id, p_partkey AS tm_id, 'fuzzy_valuation' AS match_method, 100.0::DOUBLE AS score FROM part")
def fuzzy_nested_names_with_club(t: Tables) -> DataFrame:
    left, right = _juniors(t)
    return linkage.fuzzy_club_step(left, right, ["season"], "name_clean", "club_clean", "row_id", "fuzzy_valuation", ["tm_id"])


@query("""
WITH s AS (SELECT s_suppkey, 45.0 + s_suppkey % 56 AS a, CASE WHEN s_suppkey % 11 > 0 THEN 60.0 + s_suppkey % 30 END AS b FROM supplier)
SELECT s_suppkey, a >= 50 AND (a >= 95 OR b IS NULL OR (a >= 75 AND coalesce(b, 0) >= 65) OR (a < 75 AND coalesce(b, 0) >= 80)) AS accepted FROM s
""")
def club_acceptance(t: Tables) -> DataFrame:
    """Which name and club scores the last linkage step accepts."""
    k = F.col("s_suppkey")
    name, club = 45.0 + k % 56, F.when(k % 11 > 0, 60.0 + k % 30)
    return t.supplier.select(k, F.coalesce(linkage.accept_with_club(name, club), F.lit(False)).alias("accepted"))


@query("""
WITH d AS (SELECT l_orderkey, l_linenumber, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1)
SELECT o_orderkey, coalesce(l_linenumber, 999)::INT AS line, coalesce(quality, 0)::INT AS quality
FROM orders LEFT JOIN d ON o_orderkey = l_orderkey LEFT JOIN labels ON doc_id = o_orderkey
""")
def enriched_with_defaults(t: Tables) -> DataFrame:
    """Left joins of a deduplicated table and of a sparse one; what is missing takes its default (999, 0)."""
    best = windows.top_n(t.lineitem, ["l_orderkey"], [F.desc("l_extendedprice"), F.col("l_linenumber")], 1)
    best = best.select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("line"))
    marks = t.labels.select(F.col("doc_id").alias("o_orderkey"), "quality")
    out = t.orders.select("o_orderkey").join(best, "o_orderkey", "left").join(marks, "o_orderkey", "left")
    return out.fillna(999, ["line"]).fillna(0, ["quality"]).select("o_orderkey", F.col("line").cast("int").alias("line"), F.col("quality").cast("int").alias("quality"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'José ' ELSE 'José-Ö ' END || n_name AS name FROM nation")
def repaired_mojibake(t: Tables) -> DataFrame:
    """UTF-8 read as Latin-1 is repaired, proper text is left alone."""
    wrong = F.decode(F.encode(F.concat(F.lit("José "), "n_name"), "UTF-8"), "ISO-8859-1")
    told = F.when(F.col("n_nationkey") % 2 == 0, wrong).otherwise(F.concat(F.lit("José-Ö "), "n_name"))
    return t.nation.select("n_nationkey", repair_mojibake(told).alias("name"))


@query("""
WITH s AS (SELECT l_orderkey, count(*)::DOUBLE AS lines, sum(l_quantity) AS qty FROM lineitem GROUP BY 1),
w AS (SELECT o_orderkey, ln(1 + o_totalprice) AS label, 1 / ln(1 + o_totalprice) AS raw, lines + qty AS total FROM orders JOIN s ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, round(label, 6) AS label, round(raw / avg(raw) OVER (), 6) AS weight, round(total, 4) AS total FROM w
""")
def prepared_rows(t: Tables) -> DataFrame:
    """Log label, weight of mean one, and the inputs as a vector (here: their sum)."""
    from pyspark.ml.functions import vector_to_array

    ready = m.prepare(_learning(t), "o_totalprice", ["lines", "qty"])
    total = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x)
    return ready.select("o_orderkey", F.round("label", 6).alias("label"), F.round("weight", 6).alias("weight"), F.round(total, 4).alias("total"))


@query("""
WITH n AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, floor((i - 1) * 5 / n)::INT AS fold FROM n
""")
def contiguous_folds(t: Tables) -> DataFrame:
    return m.contiguous_folds(t.orders.select("o_orderkey"), ["o_orderkey"], 5)


@query("SELECT count(*) AS n, 3::BIGINT AS inputs, true AS orthogonal FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def ols_three_inputs(t: Tables) -> DataFrame:
    """Least squares on three inputs: residuals sum to nothing and are orthogonal to every input."""
    names = ["lines", "qty", "avg_discount"]
    ready = m.prepare(_learning(t), "o_totalprice", names)
    model = LinearRegression(labelCol="label", solver="normal").fit(ready)
    e = F.col("label") - F.col("prediction")
    done = model.transform(ready).agg(
        F.count(F.lit(1)).alias("n"), F.abs(F.sum(e)).alias("s"), *(F.abs(F.corr(e, F.col(x))).alias(f"c{i}") for i, x in enumerate(names))
    )
    fine = (F.col("s") / F.col("n") < 1e-6) & (F.greatest(*(F.col(f"c{i}") for i in range(3))) < 1e-6)
    return done.select("n", F.lit(len(model.coefficients)).cast("long").alias("inputs"), fine.alias("orthogonal"))


@query("SELECT o_orderkey, true AS seen_once FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def out_of_fold_rows(t: Tables) -> DataFrame:
    """Every row is predicted once, by models that never saw its fold."""
    ready = m.contiguous_folds(m.prepare(_learning(t), "o_totalprice", FEATURES), ["o_orderkey"], 3)
    done = m.out_of_fold(ready, {"ols": LinearRegression(labelCol="label", weightCol="weight", regParam=1e-4)}, "fold", 3)
    return done.groupBy("o_orderkey").agg((F.count("p_ols") == 1).alias("seen_once"))


@query("SELECT 4::BIGINT AS clusters, true AS rising, count(*) AS n FROM (SELECT o_custkey FROM (SELECT DISTINCT o_custkey, year(o_orderdate) FROM orders) GROUP BY 1 HAVING count(*) >= 3)")
def clusters_by_value(t: Tables) -> DataFrame:
    """Clusters of players are numbered by rising mean value, and hold every player with three seasons."""
    done = m.trajectories(m.trajectory_stats(_yearly(t), "o_custkey", "year", "value"))
    rows = done.groupBy("cluster").agg(F.avg("mean_value").alias("mean"), F.count(F.lit(1)).alias("n")).orderBy("cluster").collect()  # four rows
    means = [r["mean"] for r in rows]
    return t.spark.createDataFrame([(len(rows), means == sorted(means), sum(r["n"] for r in rows))], "clusters long, rising boolean, n long")


@query("SELECT count(*) AS n, true AS uncorrelated, true AS falling FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def component_plane(t: Tables) -> DataFrame:
    """The first two components: uncorrelated, the first of the larger variance."""
    out, _ = m.reduced(_learning(t), FEATURES, 0.95)
    x, y = F.col("components")[0], F.col("components")[1]
    return out.agg(
        F.count(F.lit(1)).alias("n"), (F.abs(F.corr(x, y)) < 1e-6).alias("uncorrelated"), (F.var_samp(x) >= F.var_samp(y)).alias("falling")
    )


@query("SELECT 6::BIGINT AS trials, true AS in_range, true AS best_is_least")
def search_trials(t: Tables) -> DataFrame:
    """A parameter search stays in its ranges and returns the trial of the least error."""
    table, _ = materialize(_learning(t), "learning")
    data = m.prepare(table, "o_totalprice", FEATURES)
    make = lambda p: LinearRegression(labelCol="label", weightCol="weight", regParam=p["reg"])
    space = {"reg": tuning.Range(1e-4, 1, log=True)}
    best, _, done = tuning.tune(make, space, data.where("o_orderkey % 2 = 0"), data.where("o_orderkey % 2 <> 0"), trials=6)
    least = min(done, key=lambda x: x[1])
    return t.spark.createDataFrame(
        [(len(done), all(1e-4 <= p["reg"] <= 1 for p, _ in done), best == least[0])], "trials long, in_range boolean, best_is_least boolean"
    )


@query("SELECT * FROM (VALUES ('avg_discount', true), ('c_acctbal', true), ('lines', true), ('qty', true)) v(feature, plausible)")
def permutation_by_weight(t: Tables) -> DataFrame:
    """Shuffling an input that the score ignores changes nothing; shuffling one that it uses raises the error."""
    data = _learning(t).withColumn("y", 3 * F.col("qty") + 500)
    score = lambda df: df.withColumn("predicted", 3 * F.col("qty") + 500)
    found = m.permutation_importance(score, data, FEATURES, "y", repeats=1)
    used = F.col("feature") == "qty"
    return found.select("feature", F.when(used, F.col("importance") > 1).otherwise(F.abs("importance") < 1e-9).alias("plausible"))
