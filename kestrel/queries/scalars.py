"""Scalar functions, nested data, unpivoting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import text
from kestrel.functions.numbers import leading_int, ratio, ratio_or
from kestrel.operators.encode import confederation
from kestrel.queries.registry import Tables, query
from kestrel.sources.html import links


@query("""
SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 8) AS unit_price,
       round(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 9.0 END, 6) AS tax_per_discount FROM lineitem
""")
def safe_ratios(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.round(ratio(F.col("l_extendedprice"), F.col("l_quantity")), 8).alias("unit_price"),
        F.round(ratio_or(F.col("l_tax"), F.col("l_discount"), 9.0), 6).alias("tax_per_discount"),
    )


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(lower(strip_accents(replace(replace(text, 'ß', 'ss'), 'ø', 'o'))),
       '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g')) AS name FROM documents
""")
def name_normalise(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalise_name(F.col("text")).alias("name"))


@query(r"""
SELECT s_suppkey, trim(regexp_replace(translate(regexp_replace(trim(lower(strip_accents(s_name || ' St.-O''Brien'))), '[.''’]', '', 'g'),
       '-', ' '), '\s+', ' ', 'g')) AS club FROM supplier
""")
def club_normalise(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", text.clean_club(F.concat("s_name", F.lit(" St.-O'Brien"))).alias("club"))


@query("SELECT p_partkey, pos::INT AS pos, token FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS token, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS pos FROM part)")
def explode_tokens(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("pos", "token"))


@query("""
SELECT l_orderkey, l_linenumber, 'quantity' AS side, l_quantity AS score FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'price', l_extendedprice FROM lineitem
""")
def unpivot_scores(t: Tables) -> DataFrame:
    lines = t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    return lines.unpivot(["l_orderkey", "l_linenumber"], ["quantity", "price"], "side", "score")


@query("SELECT event_type, count(*) AS n, sum((props::JSON->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1")
def json_props(t: Tables) -> DataFrame:
    k = F.from_json("props", "k long")["k"]
    return t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("k"))


@query(r"""
WITH l AS (SELECT page_id, regexp_extract_all(html, '(?i)<a\s[^>]*?href="([^"]*)"', 1) AS h FROM pages)
SELECT page_id, unnest(h) AS href, (generate_subscripts(h, 1) - 1)::INT AS pos FROM l
""")
def html_links(t: Tables) -> DataFrame:
    return links(t.pages, "html", "page_id")


@query("""
SELECT o_orderkey, regexp_extract(o_orderpriority, '^([0-9]+)', 1)::INT AS level,
       split_part(o_orderpriority, '-', -1) AS word FROM orders
""")
def leading_number_and_last_token(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey", leading_int(F.col("o_orderpriority")).alias("level"), F.split_part("o_orderpriority", F.lit("-"), F.lit(-1)).alias("word")
    )


CODES = ("ARG", "FRA", "KEN", "JPN", "XYZ")


@query("""
SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'CONMEBOL' WHEN 1 THEN 'UEFA' WHEN 2 THEN 'CAF' WHEN 3 THEN 'AFC'
       ELSE 'Inconnu' END AS confederation FROM nation
""")
def dictionary_with_default(t: Tables) -> DataFrame:
    code = F.array(*(F.lit(x) for x in CODES))[F.col("n_nationkey") % 5]
    return t.nation.select("n_nationkey", confederation(code).alias("confederation"))


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS status,
       replace(o_totalprice::VARCHAR, '.', ',') LIKE '%,%' AS has_comma FROM orders
""")
def map_then_fallback(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        text.map_or_self(F.col("o_orderstatus"), {"O": "open", "F": "filled"}).alias("status"),
        F.contains(F.translate(F.col("o_totalprice").cast("string"), ".", ","), F.lit(",")).alias("has_comma"),
    )
