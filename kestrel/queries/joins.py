"""Joins, set operations and record linkage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import normalise_name, token_set_ratio
from kestrel.operators import linkage, quality, splits
from kestrel.queries.registry import Tables, query
from kestrel.sources.files import union_landed


@query("""
WITH s AS (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT event_id, e.user_id, event_type FROM events e JOIN s ON e.user_id = s.user_id WHERE ts BETWEEN a AND b
""")
def interval_filtered_events(t: Tables) -> DataFrame:
    span = t.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return t.events.join(span, "user_id").where(F.col("ts").between(F.col("a"), F.col("b"))).select("event_id", "user_id", "event_type")


@query("""
SELECT r_name, n_name, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
     LEFT JOIN region ON n_regionkey = r_regionkey
GROUP BY ALL
""")
def left_chain_reports(t: Tables) -> DataFrame:
    return (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .groupBy("r_name", "n_name", "o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    )


IN_1997 = "SELECT 1 FROM orders WHERE o_custkey = c_custkey AND year(o_orderdate) = 1997"


@query(f"SELECT c_custkey, c_name FROM customer WHERE EXISTS ({IN_1997})")
def semi_filter(t: Tables) -> DataFrame:
    active = t.orders.where(F.year("o_orderdate") == 1997)
    return t.customer.join(active, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(f"SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS ({IN_1997})")
def anti_orphans(t: Tables) -> DataFrame:
    active = t.orders.where(F.year("o_orderdate") == 1997)
    return t.customer.join(active, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("""
WITH k AS (
  SELECT key, max(a) AS a, max(b) AS b FROM (
    SELECT doc_id AS key, 1 AS a, 0 AS b FROM documents UNION ALL SELECT doc_id, 0, 1 FROM labels) GROUP BY 1
)
SELECT sum(a)::BIGINT AS child_keys, sum(b)::BIGINT AS parent_keys, count(*) FILTER (a = 1 AND b = 1) AS shared,
       count(*) FILTER (a = 1 AND b = 0) AS orphans, count(*) FILTER (a = 0 AND b = 1) AS unused FROM k
""")
def referential_integrity(t: Tables) -> DataFrame:
    return quality.integrity(t.documents, t.labels, "doc_id", "doc_id")


@query("SELECT DISTINCT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_keys(t: Tables) -> DataFrame:
    return quality.orphans(t.documents, t.labels, "doc_id", "doc_id")


@query("""
SELECT 'early' AS part, o_orderkey, o_totalprice, NULL AS o_orderpriority FROM orders WHERE year(o_orderdate) < 1997
UNION ALL SELECT 'late', o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE year(o_orderdate) >= 1997
""")
def union_by_name_splits(t: Tables) -> DataFrame:
    year = F.year("o_orderdate")
    early = t.orders.where(year < 1997).select("o_orderkey", "o_totalprice")
    late = t.orders.where(year >= 1997).select("o_totalprice", "o_orderkey", "o_orderpriority")
    return union_landed({"early": early, "late": late}, "part").select("part", "o_orderkey", "o_totalprice", "o_orderpriority")


@query("""
SELECT CASE WHEN year(o_orderdate) IN (1995, 1996, 1997) THEN 'train' WHEN year(o_orderdate) = 1998 THEN 'validation'
            WHEN year(o_orderdate) = 1999 THEN 'test' WHEN year(o_orderdate) = 2000 THEN 'in_progress' END AS split,
       count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1
""")
def temporal_split(t: Tables) -> DataFrame:
    parts = {"train": (1995, 1996, 1997), "validation": (1998,), "test": (1999,), "in_progress": (2000,)}
    o = splits.temporal(t.orders.withColumn("year", F.year("o_orderdate")), "year", parts)
    return o.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""
WITH p AS (SELECT DISTINCT p_brand, p_name FROM part)
SELECT a.p_brand, a.p_name AS l, b.p_name AS r, levenshtein(a.p_name, b.p_name)::INT AS distance
FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 6
""")
def fuzzy_levenshtein_block(t: Tables) -> DataFrame:
    p = t.part.select("p_brand", "p_name").distinct()
    pairs = linkage.block_pairs(p, p, ["p_brand"], "p_name").where("l < r")
    return pairs.withColumn("distance", F.levenshtein("l", "r")).where("distance <= 6")


def corrupted_names(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Players, mapping and valuations made from parts: names spelt with tokens swapped or a letter lost."""
    p = t.part.repartition("p_partkey").select(  # a small file, and names take long to normalise
        F.col("p_partkey").alias("tm_id"), F.concat_ws(" ", "p_name", F.lower(F.hex("p_partkey"))).alias("name"),
        F.col("p_type").alias("club"), (F.col("p_partkey") % 20).cast("int").alias("season"),
    )
    words = F.split("name", " ")
    spelt = (
        F.when(F.col("tm_id") % 4 == 1, F.array_join(F.reverse(words), " "))
        .when(F.col("tm_id") % 4 == 2, F.expr("substr(name, 2)"))
        .when(F.col("tm_id") % 4 == 3, F.concat("name", F.lit(" jr")))
        .otherwise(F.col("name"))
    )
    players = p.select(F.col("tm_id").alias("row_id"), "season", normalise_name(spelt).alias("name_clean"), F.col("club").alias("club_clean"))
    clean = p.select("season", normalise_name(F.col("name")).alias("name_clean"), F.col("club").alias("club_clean"), "tm_id")
    mapping = clean.where("tm_id % 3 = 0").groupBy("name_clean").agg(F.min("tm_id").alias("tm_id"))
    return players, mapping, clean


@query()
def fuzzy_token_set_cascade(t: Tables) -> DataFrame:
    """Exact mapping, fuzzy mapping, exact valuations, fuzzy valuations with club check."""
    matched, _ = linkage.cascade(*corrupted_names(t))
    return matched


@query()
def orphan_diagnostics(t: Tables) -> DataFrame:
    players, mapping, clean = corrupted_names(t)
    _, orphans = linkage.cascade(players, mapping, clean.where("tm_id % 2 = 0"))
    return linkage.diagnose(orphans, clean, "name_clean", "row_id", "club_clean")


@query("""
WITH d AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS n, s_suppkey FROM supplier)
SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'Score nom OK mais club trop faible' ELSE 'Score nom + club OK — à vérifier manuellement' END AS reason,
       count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM d), 2) AS pct FROM d GROUP BY 1
""")
def orphan_reason_shares(t: Tables) -> DataFrame:
    """Orphans whose nearest name is the same, and those with a name and club of their own."""
    s = t.supplier.select(F.col("s_suppkey").alias("row_id"))
    word = F.translate(F.col("row_id").cast("string"), "0123456789", "abcdefghij")
    known = s.select(F.concat(F.lit("player "), word).alias("name_clean"), F.lit("alpha").alias("club_clean"))
    odd = F.col("row_id") % 4 == 0
    lost = s.select("row_id", F.when(odd, F.concat(F.lit("zzqq xxww "), word, word)).otherwise(F.concat(F.lit("player "), word)).alias("name_clean"),
                    F.when(odd, F.lit("zeta")).otherwise(F.lit("alpha")).alias("club_clean"))
    return linkage.reason_shares(linkage.diagnose(lost, known, "name_clean", "row_id", "club_clean"))


@query("""
SELECT 1 AS block, CASE WHEN n_nationkey % 2 = 0 THEN lower(n_name) ELSE lower(n_name) || ' fc' END AS name, n_nationkey FROM nation
""")
def fuzzy_dimension_fallback(t: Tables) -> DataFrame:
    """Exact join of a dimension, similar names for rows without a partner."""
    n = t.nation.select(F.lit(1).alias("block"), F.lower("n_name").alias("name"), "n_nationkey")
    told = t.nation.select(
        F.lit(1).alias("block"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.concat(F.lower("n_name"), F.lit(" fc"))).alias("name")
    )
    return linkage.fuzzy_dimension(told, n, ["block"], "name", ["n_nationkey"])


@query("""
SELECT p_name AS name,
       CASE WHEN len(list_intersect(a, b)) > 0 AND
                 (len(list_intersect(a, b)) = len(a) OR len(list_intersect(a, b)) = len(b)) THEN 100.0::DOUBLE END AS score
FROM (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS a,
             list_distinct(string_split(p_name || ' jr', ' ')) AS b FROM part)
""")
def token_set_of_extended_name(t: Tables) -> DataFrame:
    """A name and the same name with a token more: token sets nest, so the ratio is 100."""
    p = t.part.select(F.col("p_name").alias("name")).distinct()
    return p.withColumn("score", token_set_ratio(F.col("name"), F.concat("name", F.lit(" jr"))))
