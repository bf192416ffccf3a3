"""Data-quality audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import aggregates, quality
from kestrel.queries.registry import Tables, query


@query("""
WITH g AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey, year(o_orderdate))
SELECT median(n) AS median_n, round(avg(n), 4) AS mean_n, max(n) AS max_n,
       round(avg((n = 1)::INT) * 100, 4) AS once_pct, round(avg((n = 2)::INT) * 100, 4) AS twice_pct,
       round(avg((n >= 3)::INT) * 100, 4) AS more_pct FROM g
""")
def update_frequency(t: Tables) -> DataFrame:
    return quality.update_frequency(t.orders.withColumn("year", F.year("o_orderdate")), ["o_custkey", "year"])


@query("""
SELECT sum(n)::BIGINT AS row_count, count(*) AS keys, sum(n - 1)::BIGINT AS surplus
FROM (SELECT count(*) AS n FROM documents GROUP BY text)
""")
def duplicate_audit(t: Tables) -> DataFrame:
    return quality.duplicates(t.documents, ["text"])


JOINED = "documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _labelled(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang", "source", "n_chars").join(t.labels, "doc_id", "left")


@query(f"""
WITH j AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM {JOINED})
SELECT unnest(['doc_id', 'lang', 'source', 'n_chars', 'quality', 'toxic']) AS column,
       unnest([count(*) - count(doc_id), count(*) - count(lang), count(*) - count(source), count(*) - count(n_chars),
               count(*) - count(quality), count(*) - count(toxic)]) AS nulls,
       round(unnest([count(*) - count(doc_id), count(*) - count(lang), count(*) - count(source), count(*) - count(n_chars),
               count(*) - count(quality), count(*) - count(toxic)]) * 100.0 / count(*), 4) AS pct FROM j
""")
def null_profile(t: Tables) -> DataFrame:
    return quality.null_profile(_labelled(t))


@query(f"""
SELECT source, round(avg((quality IS NULL)::INT) * 100, 4) AS quality_null_pct,
       round(avg((toxic IS NULL)::INT) * 100, 4) AS toxic_null_pct FROM {JOINED} GROUP BY 1
""")
def null_by_group(t: Tables) -> DataFrame:
    return quality.null_share_by(_labelled(t), ["source"], ["quality", "toxic"])


@query(f"""
WITH p AS (
  SELECT unnest([avg((d.doc_id IS NULL)::INT), avg((lang IS NULL)::INT), avg((source IS NULL)::INT), avg((n_chars IS NULL)::INT),
                 avg((quality IS NULL)::INT), avg((toxic IS NULL)::INT)]) * 100 AS pct FROM {JOINED}
)
SELECT round(100 - avg(pct), 4) AS before_pct, round(100 - avg(pct) FILTER (pct <= 20), 4) AS after_pct,
       count(*) FILTER (pct > 20) AS dropped_columns FROM p
""")
def completeness(t: Tables) -> DataFrame:
    return quality.completeness(_labelled(t))


@query("""
SELECT * FROM (VALUES ('o_orderkey', true, 0.0::DOUBLE), ('o_custkey', true, 0.0), ('o_clubkey', false, NULL)) v("column", present, pct)
""")
def key_column_coverage(t: Tables) -> DataFrame:
    return quality.key_columns(t.orders, ["o_orderkey", "o_custkey", "o_clubkey"])


@query("""
SELECT year(o_orderdate)::INT AS year, count(*) FILTER (o_orderpriority = '1-URGENT') AS "1-URGENT",
       count(*) FILTER (o_orderpriority = '2-HIGH') AS "2-HIGH", count(*) FILTER (o_orderpriority = '3-MEDIUM') AS "3-MEDIUM"
FROM orders GROUP BY 1
""")
def coverage_crosstab(t: Tables) -> DataFrame:
    o = t.orders.select(F.year("o_orderdate").alias("year"), "o_orderpriority")
    return aggregates.crosstab(o, "year", "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("""
SELECT min(ts)::DATE AS first_day, max(ts)::DATE AS last_day, datediff('day', min(ts)::DATE, max(ts)::DATE)::INT AS days,
       count(DISTINCT ts::DATE) AS active_days FROM events
""")
def temporal_coverage(t: Tables) -> DataFrame:
    return quality.coverage(t.events, "ts")


@query("""
WITH s AS (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1),
     j AS (SELECT o_totalprice AS o, v FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
SELECT unnest(['no_lines', 'negative', 'off_by_more_than_1']) AS rule,
       unnest([count(*) FILTER (v IS NULL), count(*) FILTER (o < 0), count(*) FILTER (abs(o - v) > 1)]) AS broken FROM j
""")
def coherence_checks(t: Tables) -> DataFrame:
    s = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("v"))
    j = t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return quality.coherence(
        j,
        {
            "no_lines": F.col("v").isNull(),
            "negative": F.col("o_totalprice") < 0,
            "off_by_more_than_1": F.abs(F.col("o_totalprice") - F.col("v")) > 1,
        },
    )
