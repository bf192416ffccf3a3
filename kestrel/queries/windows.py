"""Seasons, latest values, lags, ranks and shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions.numbers import half_even
from kestrel.functions.seasons import JULY, SEPTEMBER, is_world_cup_season, season_label, season_year
from kestrel.operators import runs
from kestrel.operators import windows as w
from kestrel.plans.modelling import trajectory_stats as _trajectory_stats
from kestrel.queries.registry import Tables, query

SEASON = "(year(o_orderdate) - CASE WHEN month(o_orderdate) < {} THEN 1 ELSE 0 END)::INT"
YEARLY = """
  SELECT o_custkey, year(o_orderdate)::INT AS year, round(sum(o_totalprice), 2) AS value
  FROM orders GROUP BY 1, 2
"""


def _orders(t: Tables, start: int = JULY) -> DataFrame:
    return t.orders.withColumn("season", season_year(F.col("o_orderdate"), start))


def _yearly(t: Tables) -> DataFrame:
    return (
        t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    )


@query(f"""
WITH l AS (
  SELECT o_custkey, {SEASON.format(7)} AS season, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey, {SEASON.format(7)} ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
  FROM orders
), v AS (SELECT o_custkey, season, o_totalprice AS latest FROM l WHERE n = 1)
SELECT o_custkey, season, latest,
       round(ln(1 + lag(latest) OVER w), 6) AS log_prev_value,
       round(CASE WHEN season - lag(season) OVER w = 1 THEN latest - lag(latest) OVER w ELSE 0 END, 2) AS delta
FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY season)
""")
def flagship_valuation_history(t: Tables) -> DataFrame:
    """Latest value per entity and season, its lagged log and its change between consecutive seasons."""
    latest = w.last_known(_orders(t), ["o_custkey", "season"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])
    latest = latest.withColumnRenamed("o_totalprice", "latest")
    out = w.lagged(latest, ["o_custkey"], "season", "latest", "prev", False)
    out = out.withColumn("log_prev_value", F.round(F.log1p("prev"), 6)).drop("prev")
    out = w.delta(out, ["o_custkey"], "season", "latest", "delta")
    return out.withColumn("delta", F.round("delta", 2))


@query(f"""
SELECT o_custkey, season, o_totalprice FROM (
  SELECT o_custkey, {SEASON.format(7)} AS season, o_totalprice,
         row_number() OVER (PARTITION BY o_custkey, {SEASON.format(7)} ORDER BY o_orderdate DESC, o_orderkey DESC) AS n
  FROM orders) WHERE n = 1
""")
def latest_value_per_season(t: Tables) -> DataFrame:
    return w.last_known(_orders(t), ["o_custkey", "season"], ["o_orderdate", "o_orderkey"], ["o_totalprice"])


def _calendar(t: Tables, start: int) -> DataFrame:
    g = _orders(t, start).groupBy("season").agg(F.count(F.lit(1)).alias("n"))
    return g.select("season", season_label(F.col("season")).alias("label"), is_world_cup_season(F.col("season")).alias("world_cup"), "n")


CALENDAR = """
SELECT season, season::VARCHAR || '/' || (season + 1)::VARCHAR AS label, (season + 1) % 4 = 2 AS world_cup, count(*) AS n
FROM (SELECT {} AS season FROM orders) GROUP BY season
"""


@query(CALENDAR.format(SEASON.format(7)))
def season_calendar_july(t: Tables) -> DataFrame:
    return _calendar(t, JULY)


@query(CALENDAR.format(SEASON.format(9)))
def season_calendar_sept(t: Tables) -> DataFrame:
    return _calendar(t, SEPTEMBER)


@query(f"""
SELECT o_custkey, {SEASON.format(7)} AS season,
       arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest,
       round_even(avg(o_totalprice), 0) AS mean, max(o_totalprice) AS highest, max(o_orderdate)::DATE AS date_ref
FROM orders GROUP BY 1, 2
""")
def value_agg_latest_mean_max(t: Tables) -> DataFrame:
    return _orders(t).groupBy("o_custkey", "season").agg(
        F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("latest"),
        half_even(F.avg("o_totalprice")).alias("mean"),
        F.max("o_totalprice").alias("highest"),
        F.to_date(F.max("o_orderdate")).alias("date_ref"),
    )


@query("""
WITH r AS (
  SELECT s_nationkey, s_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, sum(l_quantity) AS qty,
         count(*) AS lines
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2
)
SELECT s_nationkey, s_suppkey, revenue, qty, lines,
       row_number() OVER (PARTITION BY s_nationkey ORDER BY revenue DESC, qty DESC, lines DESC, s_suppkey)::INT AS position
FROM r
""")
def standings(t: Tables) -> DataFrame:
    sold = t.lineitem.groupBy("l_suppkey").agg(
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.sum("l_quantity").alias("qty"),
        F.count(F.lit(1)).alias("lines"),
    )
    r = t.supplier.join(sold, F.col("s_suppkey") == F.col("l_suppkey")).select("s_nationkey", "s_suppkey", "revenue", "qty", "lines")
    return w.standings(r, ["s_nationkey"], "s_suppkey", "revenue", "qty", "lines")


@query("""
WITH m AS (
  SELECT l_returnflag AS league, c_nationkey AS home, s_nationkey AS away,
         (l_linenumber % 5)::INT AS hg, (l_orderkey % 5)::INT AS ag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN supplier ON l_suppkey = s_suppkey
), s AS (
  SELECT league, home AS team, hg AS scored, ag AS conceded FROM m
  UNION ALL SELECT league, away, ag, hg FROM m
), p AS (
  SELECT league, team,
         sum(CASE WHEN scored > conceded THEN 3 WHEN scored = conceded THEN 1 ELSE 0 END)::BIGINT AS points,
         sum(scored)::BIGINT AS goals_for, sum(conceded)::BIGINT AS goals_against,
         (sum(scored) - sum(conceded))::BIGINT AS goal_diff
  FROM s GROUP BY 1, 2
)
SELECT *, row_number() OVER (PARTITION BY league ORDER BY points DESC, goal_diff DESC, goals_for DESC, team)::INT AS position
FROM p
""")
def two_sided_union_standings(t: Tables) -> DataFrame:
    m = (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            F.col("l_returnflag").alias("league"), F.col("c_nationkey").alias("home"), F.col("s_nationkey").alias("away"),
            (F.col("l_linenumber") % 5).cast("int").alias("hg"), (F.col("l_orderkey") % 5).cast("int").alias("ag"),
        )
    )
    points = w.match_points(m, ["league"], "home", "away", "hg", "ag")
    return w.standings(points, ["league"], "team", "points", "goal_diff", "goals_for")


@query("""
WITH r AS (
  SELECT s_nationkey, year(l_shipdate)::INT AS year, s_suppkey, round(sum(l_extendedprice), 2) AS revenue
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3
), n AS (
  SELECT *, row_number() OVER (PARTITION BY s_nationkey, year ORDER BY revenue DESC, s_suppkey)::INT AS rank FROM r
)
SELECT * FROM n WHERE rank <= 3
""")
def topn_by_rank(t: Tables) -> DataFrame:
    r = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", F.year("l_shipdate").alias("year"), "s_suppkey")
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    )
    return w.top_n(r, ["s_nationkey", "year"], [F.desc("revenue"), F.asc("s_suppkey")], 3)


AT = ["l_linenumber", "l_partkey", "l_extendedprice"]  # line numbers repeat within an order
KNOWN = """
  SELECT l_orderkey, (l_linenumber, l_partkey, l_extendedprice) AS pos, CASE WHEN l_linenumber % 3 <> 1 THEN l_quantity END AS q,
         CASE WHEN l_linenumber % 3 <> 0 THEN l_shipdate END AS d FROM lineitem
"""


def _holes(t: Tables) -> DataFrame:
    n = F.col("l_linenumber") % 3
    return t.lineitem.select(
        "l_orderkey", *AT, F.when(n != 1, F.col("l_quantity")).alias("q"), F.when(n != 0, F.col("l_shipdate")).alias("d")
    )


@query(f"""
SELECT l_orderkey, arg_min(q, pos) FILTER (q IS NOT NULL) AS q, arg_min(d, pos) FILTER (d IS NOT NULL) AS d
FROM ({KNOWN}) GROUP BY 1
""")
def first_non_null_merge(t: Tables) -> DataFrame:
    return w.first_known(_holes(t), ["l_orderkey"], AT, ["q", "d"])


@query(f"""
SELECT l_orderkey, arg_max(q, pos) FILTER (q IS NOT NULL) AS q, arg_max(d, pos) FILTER (d IS NOT NULL) AS d
FROM ({KNOWN}) GROUP BY 1
""")
def last_non_null_merge(t: Tables) -> DataFrame:
    return w.last_known(_holes(t), ["l_orderkey"], AT, ["q", "d"])


@query("""
SELECT l_orderkey, l_extendedprice, l_linenumber, l_partkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber DESC) AS n FROM lineitem
) WHERE n = 1
""")
def keep_max_metric(t: Tables) -> DataFrame:
    one = t.lineitem.select("l_orderkey", "l_extendedprice", "l_linenumber", "l_partkey")
    return w.keep_latest(one, ["l_orderkey"], ["l_extendedprice", "l_linenumber"])


@query(f"""
SELECT o_custkey, year, value, round(ln(1 + lag(value) OVER (PARTITION BY o_custkey ORDER BY year)), 6) AS log_prev
FROM ({YEARLY})
""")
def lag_log_value(t: Tables) -> DataFrame:
    out = w.lagged(_yearly(t), ["o_custkey"], "year", "value", "prev", False)
    return out.select("o_custkey", "year", "value", F.round(F.log1p("prev"), 6).alias("log_prev"))


@query(f"""
SELECT o_custkey, year, value,
       round(CASE WHEN year - lag(year) OVER w = 1 THEN value - lag(value) OVER w ELSE 0 END, 2) AS delta,
       round(CASE WHEN year - lag(year) OVER w = 1 THEN (value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) * 100 END, 4) AS delta_pct
FROM ({YEARLY}) WINDOW w AS (PARTITION BY o_custkey ORDER BY year)
""")
def consecutive_delta(t: Tables) -> DataFrame:
    out = w.delta(_yearly(t), ["o_custkey"], "year", "value", "delta")
    out = w.relative_delta(out, ["o_custkey"], "year", "value", "delta_pct")
    return out.withColumns({"delta": F.round("delta", 2), "delta_pct": F.round("delta_pct", 4)})


@query(f"""
SELECT o_custkey, year, value,
       (value > 300000 AND coalesce(lag(value) OVER (PARTITION BY o_custkey ORDER BY year), 0) > 300000)::INT AS chronic
FROM ({YEARLY})
""")
def chronic_flag(t: Tables) -> DataFrame:
    return w.chronic(_yearly(t), ["o_custkey"], "year", "value", 300000, "chronic")


@query("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)
SELECT event_id, user_id, ts, coalesce(
  last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
  first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
) AS value FROM e
""")
def group_fill(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return w.fill_in_group(e, ["user_id"], ["ts", "event_id"], ["value"])


@query("""
WITH r AS (
  SELECT s_nationkey, s_suppkey, round(sum(l_extendedprice), 2) AS revenue
  FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY 1, 2
)
SELECT s_nationkey, s_suppkey, revenue, round(revenue / sum(revenue) OVER (PARTITION BY s_nationkey), 8) AS share FROM r
""")
def team_share(t: Tables) -> DataFrame:
    r = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("s_nationkey", "s_suppkey")
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue"))
    )
    return w.share_of_group(r, ["s_nationkey"], "revenue", "share").withColumn("share", F.round("share", 8))


@query(f"""
SELECT o_custkey, year, value,
       round(value / first_value(value) OVER (PARTITION BY o_custkey ORDER BY year) * 100, 4) AS base100,
       row_number() OVER (PARTITION BY o_custkey ORDER BY year)::INT AS year_rank
FROM ({YEARLY})
""")
def rank_index_base100(t: Tables) -> DataFrame:
    return w.base_100(_yearly(t), ["o_custkey"], "year", "value", "base100").withColumn("base100", F.round("base100", 4))


@query(f"""
WITH d AS (
  SELECT o_custkey, value,
         CASE WHEN year - lag(year) OVER w = 1 THEN value - lag(value) OVER w END AS d
  FROM ({YEARLY}) WINDOW w AS (PARTITION BY o_custkey ORDER BY year)
)
SELECT o_custkey, round(avg(value), 4) AS mean_value, round(avg(d), 4) AS mean_delta, round(stddev_samp(d), 4) AS std_delta,
       count(value) AS seasons
FROM d GROUP BY 1 HAVING count(value) >= 3
""")
def trajectory_stats(t: Tables) -> DataFrame:
    s = _trajectory_stats(_yearly(t), "o_custkey", "year", "value")
    return s.withColumns({n: F.round(n, 4) for n in ("mean_value", "mean_delta", "std_delta")})


@query("""
SELECT event_id, user_id, event_type, ts::DATE AS day FROM (
  SELECT *, count(*) OVER (PARTITION BY user_id, event_type, ts::DATE) AS n FROM events) WHERE n > 1
""")
def duplicate_members(t: Tables) -> DataFrame:
    e = t.events.select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return w.duplicate_members(e, ["user_id", "event_type", "day"])


@query("""
SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE n >= 15
""")
def large_groups_only(t: Tables) -> DataFrame:
    return w.in_large_groups(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], 15)


@query("""
SELECT event_id, lag(value) OVER w AS before, round(sum(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS total FROM events
WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)
""")
def running_values_of_few_keys(t: Tables) -> DataFrame:
    """Value before and sum so far within event types: few keys, each over many partitions."""
    e = t.events.select("event_id", "event_type", "ts", F.col("value").cast("double").alias("value"))
    out = runs.running_sum(runs.lagged(e, ["event_type"], ["ts", "event_id"], {"before": "value"}), ["event_type"], ["ts", "event_id"], {"total": "value", "n": F.lit(1)})
    return out.select("event_id", "before", F.when(F.col("n") > 0, F.round("total", 4)).alias("total"))
