"""Profiles, statistics, encodings, imputation and error reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.functions.numbers import floor_bin
from kestrel.operators import aggregates, encode, impute, metrics, ranks, splits
from kestrel.operators.columns import at_least_known
from kestrel.queries.registry import Tables, query


@query("""
SELECT p_brand,
       count(p_type) AS nb_total, sum(p_size)::BIGINT AS amount_total, max(p_retailprice) AS peak_max,
       count(*) FILTER (m) AS metal_nb, sum(CASE WHEN m THEN p_size ELSE 0 END)::BIGINT AS metal_amount,
       max(CASE WHEN m THEN p_retailprice ELSE 0 END) AS metal_peak, max(m::INT) AS metal,
       count(*) FILTER (s) AS small_nb, sum(CASE WHEN s THEN p_size ELSE 0 END)::BIGINT AS small_amount,
       max(CASE WHEN s THEN p_retailprice ELSE 0 END) AS small_peak, max(s::INT) AS small,
       count(*) FILTER (NOT m AND NOT s) AS other_nb, sum(CASE WHEN NOT m AND NOT s THEN p_size ELSE 0 END)::BIGINT AS other_amount,
       max(CASE WHEN NOT m AND NOT s THEN p_retailprice ELSE 0 END) AS other_peak, max((NOT m AND NOT s)::INT) AS other
FROM (SELECT *, lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%steel%' AS m, lower(p_type) LIKE '%small%' AS s FROM part)
GROUP BY 1
""")
def keyword_family_aggregation(t: Tables) -> DataFrame:
    table = {"metal": ["brass", "steel"], "small": ["small"]}
    return aggregates.families(t.part, ["p_brand"], "p_type", F.col("p_size"), F.col("p_retailprice"), table, "other")


@query("""
SELECT l_orderkey, sum(l_quantity) AS quantity, avg(l_discount) AS discount_rate, sum(l_extendedprice) AS price,
       arg_max(l_returnflag, (l_linenumber, l_partkey, l_extendedprice)) AS flag, max(l_linenumber)::INT AS line_season_year
FROM lineitem GROUP BY 1
""")
def pattern_driven_aggregation(t: Tables) -> DataFrame:
    lines = t.lineitem.select(
        "l_orderkey", F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount_rate"),
        F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("line_season_year"), "l_partkey",
    )
    merged = aggregates.merge_duplicates(lines, ["l_orderkey"], ["line_season_year", "l_partkey", "price"])
    return merged.drop("l_partkey")


@query("""
SELECT event_type AS value, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY 1
""")
def value_counts(t: Tables) -> DataFrame:
    return aggregates.value_counts(t.events, "event_type")


def _described(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
  min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25), 4) AS q1, round(median({c}), 4) AS median,
  round(quantile_cont({c}, 0.75), 4) AS q3, max({c})::DOUBLE AS max FROM part"""


@query(" UNION ALL ".join(_described(c) for c in ("p_size", "p_retailprice")))
def describe_numeric(t: Tables) -> DataFrame:
    return aggregates.describe(t.part, ["p_size", "p_retailprice"])


@query("""
SELECT (floor(n_chars / 500) * 500)::BIGINT AS bin, count(*) AS n, round(stddev_samp(n_chars), 4) AS spread
FROM documents GROUP BY 1
""")
def histogram_bins(t: Tables) -> DataFrame:
    binned = t.documents.select(floor_bin(F.col("n_chars"), 500).cast("long").alias("bin"), "n_chars")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_samp("n_chars"), 4).alias("spread"))


NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
    for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]
))
def corr_matrix_topn(t: Tables) -> DataFrame:
    return aggregates.correlations(t.lineitem, NUMBERS)


@query("""
WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, n_chars FROM documents, q WHERE n_chars <= b + 1.5 * (b - a)
""")
def iqr_outlier_filter(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "n_chars")
    return splits.below_limit(d, d.where("doc_id % 2 = 0"), "n_chars")


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, 0.01) AS a, quantile_cont(o_totalprice, 0.99) AS b FROM orders)
SELECT o_orderkey, round(least(greatest(o_totalprice, a), b), 4) AS clipped FROM orders, q
""")
def clip_quantile(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_totalprice")
    return splits.clip_quantiles(o, o, "o_totalprice", 0.01, 0.99, "clipped").select("o_orderkey", F.round("clipped", 4).alias("clipped"))


@query("""
WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS median FROM customer GROUP BY 1)
SELECT c_mktsegment, median, round((median - min(median) OVER ()) / (max(median) OVER () - min(median) OVER () + 1e-9), 6) AS median_nor FROM m
""")
def median_profile_minmax(t: Tables) -> DataFrame:
    m = aggregates.median_by(t.customer, ["c_mktsegment"], "c_acctbal")
    return aggregates.min_max(m, ["median"]).withColumn("median_nor", F.round("median_nor", 6))


SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query(
    "SELECT c_nationkey, "
    + ", ".join(f"coalesce(median(c_acctbal) FILTER (c_mktsegment = '{s}'), 0) AS \"{s}\"" for s in SEGMENTS)
    + " FROM customer GROUP BY 1"
)
def median_heatmap_pivot(t: Tables) -> DataFrame:
    return aggregates.median_pivot(t.customer, "c_nationkey", "c_mktsegment", SEGMENTS, "c_acctbal")


@query(
    "SELECT c_custkey, "
    + ", ".join(f"(c_mktsegment = '{s}')::INT AS seg_{s}" for s in SEGMENTS)
    + " FROM customer"
)
def one_hot(t: Tables) -> DataFrame:
    return encode.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS, "seg").drop("c_mktsegment")


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer")
def onehot_inverse(t: Tables) -> DataFrame:
    wide = encode.one_hot(t.customer.select("c_custkey", "c_mktsegment"), "c_mktsegment", SEGMENTS, "seg")
    return wide.select("c_custkey", encode.from_one_hot([f"seg_{s}" for s in SEGMENTS], "seg").alias("segment"))


@query("""
SELECT p_partkey, list_contains(string_split(p_name, ' '), 'red')::INT AS tok_red,
       list_contains(string_split(p_name, ' '), 'widget')::INT AS tok_widget FROM part
""")
def multi_label(t: Tables) -> DataFrame:
    return encode.multi_label(t.part.select("p_partkey", "p_name"), "p_name", ["red", "widget"], "tok", " ").drop("p_name")


@query("""
WITH r AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_name)::INT AS rank FROM nation)
SELECT n_nationkey, """ + ", ".join(f"(rank = {i})::INT AS top_{i}" for i in range(1, 6)) + " FROM r")  # fmt: skip
def rank_dummies(t: Tables) -> DataFrame:
    r = t.nation.withColumn("rank", F.row_number().over(Window.orderBy("n_name")))  # 25 rows, a fixed dimension
    return encode.rank_dummies(r.select("n_nationkey", "rank"), "rank", 5, "top").drop("rank")


@query("""
WITH c AS (SELECT *, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS b FROM customer),
     tr AS (SELECT * FROM c WHERE c_custkey % 2 = 1 OR c_custkey % 4 = 2),
     l1 AS (SELECT c_nationkey, c_mktsegment, median(b) AS m FROM tr GROUP BY 1, 2),
     l2 AS (SELECT c_nationkey, median(b) AS m FROM tr GROUP BY 1), l3 AS (SELECT median(b) AS m FROM tr)
SELECT c_custkey, round(coalesce(b, l1.m, l2.m, l3.m), 4) AS filled
FROM c LEFT JOIN l1 USING (c_nationkey, c_mktsegment) LEFT JOIN l2 ON c.c_nationkey = l2.c_nationkey, l3
""")
def hierarchical_median_impute(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    cust = t.customer.withColumn("b", F.when(k % 4 != 0, F.col("c_acctbal")))
    levels = [["c_nationkey", "c_mktsegment"], ["c_nationkey"], ()]
    out = impute.hierarchical(cust, cust.where((k % 2 == 1) | (k % 4 == 2)), "b", levels)
    return out.select("c_custkey", F.round("b", 4).alias("filled"))


@query("""
WITH m AS (SELECT p_type, median(p_size) AS m FROM part WHERE p_size BETWEEN 5 AND 45 GROUP BY 1),
     g AS (SELECT median(p_size) AS m FROM part WHERE p_size BETWEEN 5 AND 45)
SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 45 THEN p_size::DOUBLE ELSE coalesce(m.m, g.m) END AS size
FROM part LEFT JOIN m USING (p_type), g
""")
def outlier_replace_by_group_median(t: Tables) -> DataFrame:
    p = t.part.select("p_partkey", "p_type", F.col("p_size").cast("double").alias("p_size"))
    return impute.replace_outliers(p, p, "p_size", 5, 45, ["p_type"], "size").select("p_partkey", "size")


PRED = """SELECT o_orderkey, o_totalprice AS y, s.p, extract(year FROM o_orderdate)::INT AS year FROM orders
  JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount)) AS p FROM lineitem GROUP BY 1) s ON o_orderkey = l_orderkey"""


def predicted(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("p"))
    return t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", F.col("o_totalprice").alias("y"), "p", F.year("o_orderdate").alias("year")
    )


@query(f"""
SELECT year, count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
       round(avg(abs(y - p) / abs(y)), 6) AS mape, round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 6) AS r2,
       round(1 - (sum((y - p) * (y - p)) / (var_pop(y) * count(*))) * (count(*) - 1) / (count(*) - 3 - 1), 6) AS adj_r2,
       round(sqrt(avg(pow(ln(1 + y) - ln(1 + greatest(p, 0)), 2))), 6) AS rmse_log
FROM ({PRED}) GROUP BY 1
""")
def error_metrics(t: Tables) -> DataFrame:
    e = metrics.errors(predicted(t), "y", "p", ["year"], features=3)
    return e.withColumns({"mae": F.round("mae", 4), "rmse": F.round("rmse", 4)})


@query(f"""
WITH b AS (
  SELECT CASE WHEN y > 0 AND y <= 50000 THEN 'low' WHEN y > 50000 AND y <= 200000 THEN 'mid' WHEN y > 200000 THEN 'high' END AS band,
         y, abs(y - p) AS e FROM ({PRED})
)
SELECT band, count(*) AS n, round(avg(y), 4) AS mean_y, round(avg(e), 4) AS mae, round(avg(e / y) * 100, 4) AS mape_pct,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS rows_pct, round(sum(e) * 100.0 / sum(sum(e)) OVER (), 4) AS error_pct
FROM b WHERE band IS NOT NULL GROUP BY 1
""")
def band_errors(t: Tables) -> DataFrame:
    return metrics.banded_errors(predicted(t), "y", "p", "y", (0, 50_000, 200_000, float("inf")), ("low", "mid", "high"))


@query("""
SELECT o_orderkey, round((1 / ln(1 + o_totalprice)) / avg(1 / ln(1 + o_totalprice)) OVER (), 6) AS weight FROM orders
""")
def sample_weights(t: Tables) -> DataFrame:
    w = metrics.weights(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")
    return w.select("o_orderkey", F.round("weight", 6).alias("weight"))


@query("""
SELECT o_orderkey, round(ln(1 + o_totalprice), 6) AS log1p, round(log10(o_totalprice + 1), 6) AS log10,
       round(sqrt(o_totalprice), 6) AS sqrt, round((pow(o_totalprice + 1, 0.5) - 1) / 0.5, 4) AS yeo_johnson FROM orders
""")
def target_transforms(t: Tables) -> DataFrame:
    y = F.col("o_totalprice")
    forms = {n: F.round(metrics.TRANSFORMS[n][0](y), 6) for n in ("log1p", "log10", "sqrt")}
    return t.orders.select("o_orderkey", *(x.alias(n) for n, x in forms.items()), F.round(metrics.yeo_johnson(y, 0.5), 4).alias("yeo_johnson"))


@query("""
SELECT count(o_totalprice) AS n, round(skewness(o_totalprice), 6) AS skew, round(kurtosis(o_totalprice), 6) AS kurt,
       round(skewness(ln(1 + o_totalprice)), 6) AS skew_log FROM orders
""")
def skew_kurt(t: Tables) -> DataFrame:
    y = F.col("o_totalprice")
    return t.orders.agg(
        F.count(y).alias("n"),
        F.round(aggregates.sample_skewness(y), 6).alias("skew"),
        F.round(aggregates.sample_kurtosis(y), 6).alias("kurt"),
        F.round(aggregates.sample_skewness(F.log1p(y)), 6).alias("skew_log"),
    )


@query("SELECT median(p_retailprice) AS p_retailprice, median(p_size) AS p_size, (SELECT p_brand_no FROM (SELECT substr(p_brand, 7)::INT AS p_brand_no, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand_no LIMIT 1)) AS brand_no FROM part")
def profile_row(t: Tables) -> DataFrame:
    p = t.part.withColumn("brand_no", F.substring("p_brand", 7, 9).cast("int"))
    return aggregates.profile(p, ["p_retailprice", "p_size"], ["brand_no"])


@query("""
WITH m AS (SELECT p_size, median(p_retailprice) AS m, count(*) AS n FROM part GROUP BY 1)
SELECT arg_max(p_size, (m, -p_size)) AS peak_size, max(m) AS peak FROM m WHERE n >= 10
""")
def peak_of_group_medians(t: Tables) -> DataFrame:
    sizes = t.part.groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).where("n >= 10")
    m = aggregates.median_by(t.part, ["p_size"], "p_retailprice", "m").join(sizes, "p_size")
    return m.agg(F.max_by("p_size", F.struct("m", (-F.col("p_size")).alias("s"))).alias("peak_size"), F.max("m").alias("peak"))


@query(f"SELECT doc_id FROM (SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) WHERE (lang IS NOT NULL)::INT + (quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT >= 3")  # noqa: F541
def rows_with_enough_known(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return at_least_known(d, ["lang", "quality", "toxic"], 3).select("doc_id")


@query("""
SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice), 8) AS pct FROM orders
""")
def percentile_rank(t: Tables) -> DataFrame:
    ranked = ranks.percent_ranks(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), ["o_orderpriority"], "o_totalprice", "pct")
    return ranked.select("o_orderkey", F.round("pct", 8).alias("pct"))


@query("""
SELECT year(o_orderdate)::INT AS year, median(o_totalprice / 1e6) AS median_m, round(avg(o_totalprice / 1e6), 6) AS mean_m, count(*) AS n,
       count(*) FILTER (o_totalprice >= 200000) AS elite FROM orders GROUP BY 1
""")
def season_value_summary(t: Tables) -> DataFrame:
    o = splits.elite(t.orders.withColumn("m", F.col("o_totalprice") / 1e6), "o_totalprice", 200_000)
    o = o.withColumn("year", F.year("o_orderdate"))
    rest = o.groupBy("year").agg(
        F.round(F.avg("m"), 6).alias("mean_m"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("group") == "elite").alias("elite"),
    )
    return aggregates.median_by(o, ["year"], "m", "median_m").join(rest, "year")


@query("""
SELECT o_orderstatus, round(avg(o_totalprice) FILTER (year(o_orderdate) = 1996), 4) AS "1996",
       round(avg(o_totalprice) FILTER (year(o_orderdate) = 1997), 4) AS "1997" FROM orders GROUP BY 1
""")
def crosstab_of_means(t: Tables) -> DataFrame:
    o = t.orders.withColumn("year", F.year("o_orderdate"))
    return aggregates.crosstab(o, "o_orderstatus", "year", [1996, 1997], F.round(F.avg("o_totalprice"), 4), fill=None)


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, count(DISTINCT o_orderpriority) AS priorities FROM orders")
def distinct_counts(t: Tables) -> DataFrame:
    return t.orders.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("o_custkey").alias("customers"),
        F.count_distinct("o_orderpriority").alias("priorities"),
    )


@query("""
WITH g AS (SELECT quantile_cont(o_totalprice, list_transform(range(101), lambda i: i / 100.0)) AS q FROM orders),
k AS (SELECT o_orderkey, o_totalprice AS y, q, ('0x' || substr(md5('1308|' || o_orderkey), 1, 8))::BIGINT / 4294967296.0 AS s,
             greatest(least(len(list_filter(q, lambda x: x <= o_totalprice)), 100), 1) AS k FROM orders, g)
SELECT o_orderkey, CASE WHEN s < 0.7 THEN 'train' WHEN s < 0.85 THEN 'validation' ELSE 'test' END AS split,
       round(greatest(least((k - 1 + coalesce((y - q[k]) / nullif(q[k + 1] - q[k], 0), 0)) / 100, 1), 0), 6) AS u FROM k
""")
def quantile_target(t: Tables) -> DataFrame:
    """Target mapped to [0, 1] by exact quantiles, and the split its key's hash gives it."""
    o = splits.hashed(t.orders, ["o_orderkey"], {"train": 0.7, "validation": 0.15, "test": 0.15})
    return metrics.quantile_uniform(o, "o_totalprice", "u").select("o_orderkey", "split", F.round("u", 6).alias("u"))
