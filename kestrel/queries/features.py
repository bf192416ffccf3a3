"""Derived player-season features over a performance table made from orders (a customer is a player, a year a season)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators.aggregates import recompute_ratios
from kestrel.plans.features import engineer
from kestrel.plans.learning_table import build, encoded
from kestrel.queries.registry import Tables, query
from kestrel.storage import materialize

BASE = """
WITH b AS (
  SELECT o_custkey AS player, year(o_orderdate)::INT AS season_year, o_custkey % 10 AS team, count(*)::DOUBLE AS n,
         sum(o_orderkey % 5)::DOUBLE AS a, sum(o_orderkey % 40)::DOUBLE AS d
  FROM orders GROUP BY 1, 2, 3
)
"""


def _season(t: Tables) -> DataFrame:
    """The base counts n, a, d of ``BASE`` under the names of a performance table."""
    b = t.orders.groupBy(
        F.col("o_custkey").alias("player"), F.year("o_orderdate").alias("season_year"), (F.col("o_custkey") % 10).alias("team")
    ).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(F.col("o_orderkey") % 5).cast("double").alias("a"),
        F.sum(F.col("o_orderkey") % 40).cast("double").alias("d"),
    )
    n, a, d = F.col("n"), F.col("a"), F.col("d")
    return b.select(
        "player", "season_year", "team",
        (n - 1).alias("Performance_Gls"), a.alias("Performance_Ast"), (n * 90).alias("Playing Time_Min"), n.alias("Playing Time_MP"),
        n.alias("Playing Time_90s"), (n - 1).alias("Playing Time_Starts"), a.alias("Starts_Compl"), (a / 10).alias("Standard_G/SoT"),
        d.alias("Standard_SoT%"), a.alias("Performance_Fls"), (n - 1).alias("Performance_Int"), (n * 0).alias("Performance_TklW"),
        d.alias("Performance_Save%"), F.lit(180.0).alias("height_in_cm"), (a / 2).alias("xg"), (d * 5).alias("injury_days_total"),
        (d % 2).cast("int").alias("classement_FIFA_1"), (a % 2).cast("int").alias("classement_FIFA_4"), (d * 20).alias("contrat_jours_restants"),
        (a / 4).alias("Team Success_PPM"), a.alias("Performance_CrdY"), n.alias("Performance_CrdR"), F.lit(1.0).alias("Performance_2CrdY"),
        F.greatest(n - 2, F.lit(0.0)).alias("Performance_G-PK"), (n % 2).cast("int").alias("pos_DF"), F.lit(1).alias("pos_MF"),
        (d % 20 + 18).alias("age"), F.element_at(F.array(F.lit("UEFA"), F.lit("CAF"), F.lit("AFC")), (F.col("player") % 3 + 1).cast("int")).alias("confederation"),
    )


def _of(t: Tables, *names: str) -> DataFrame:
    """The features named, rounded."""
    return engineer(_season(t)).select("player", "season_year", *(F.round(F.col(f"`{x}`").cast("double"), 6).alias(x) for x in names))


def _sql(**formulas: str) -> str:
    return BASE + "SELECT player, season_year, " + ", ".join(f'round(({f})::DOUBLE, 6) AS "{x}"' for x, f in formulas.items()) + " FROM b"


@query(_sql(
    indice_danger_tirs="a / 10 * d / 100", efficacite_devant_but="CASE WHEN n - 1 > 0 THEN a / 2 / (n - 1) ELSE 9 END",
    rentabilite_buts_minutes="(n - 1) / (n * 90)", impact_buts_points="(n - 1) / n * (a / 4)",
    ratio_buts_hors_penalty="CASE WHEN n > 1 THEN greatest(n - 2, 0) / (n - 1) ELSE 0 END",
    ratio_buts_penalty="CASE WHEN n > 1 THEN 1 - greatest(n - 2, 0) / (n - 1) ELSE 0 END",
))
def shooting_features(t: Tables) -> DataFrame:
    return _of(
        t, "indice_danger_tirs", "efficacite_devant_but", "rentabilite_buts_minutes", "impact_buts_points", "ratio_buts_hors_penalty", "ratio_buts_penalty"
    )


@query(_sql(
    ratio_agressivite="CASE WHEN n - 1 > 0 THEN a / (n - 1) ELSE 0 END",
    indiscipline_par_90="((a - 2) + 6 * (n - 1) + 3) / n",
    taux_matchs_termines="CASE WHEN n - 1 > 0 THEN a / (n - 1) ELSE 0 END",
    urgence_contractuelle="(d * 20 <= 365)::INT",
))
def discipline_features(t: Tables) -> DataFrame:
    return _of(t, "ratio_agressivite", "indiscipline_par_90", "taux_matchs_termines", "urgence_contractuelle")


@query(_sql(
    taux_arretXtaille_gardien="d / 100 * 180", score_hype_nation="(d % 2) * 10 + (a % 2) * 7", est_polyvalent="(n % 2)",
    pic_distance="d % 20 + 18 - 25", age_sq="(d % 20 + 18) * (d % 20 + 18)", pic_age="(d % 20 + 18 BETWEEN 24 AND 28)::INT",
    taux_indisponibilite="least(d * 5 / 365, 1)",
))
def profile_features(t: Tables) -> DataFrame:
    return _of(t, "taux_arretXtaille_gardien", "score_hype_nation", "est_polyvalent", "pic_distance", "age_sq", "pic_age", "taux_indisponibilite")


@query(BASE + """
, u AS (SELECT *, least(d * 5 / 365, 1) AS i FROM b),
s AS (SELECT *, lag(n * 90) OVER w AS n0, lag(a / 2) OVER w AS x0, lag(season_year) OVER w AS y0, lag(i) OVER w AS i0, sum(n - 1) OVER (PARTITION BY team, season_year) AS g
      FROM u WINDOW w AS (PARTITION BY player ORDER BY season_year))
SELECT player, season_year, round(CASE WHEN season_year - y0 = 1 THEN n * 90 - n0 ELSE 0 END, 6) AS delta_minutes_jouees,
       round(CASE WHEN season_year - y0 = 1 THEN a / 2 - x0 ELSE 0 END, 6) AS delta_xg, round(coalesce(i0, 0), 6) AS taux_indisponibilite_prec,
       (i > 0.15 AND coalesce(i0, 0) > 0.15)::INT::DOUBLE AS fragilite_chronique,
       round(CASE WHEN g > 0 THEN (n - 1 + a) / g ELSE 0 END, 6) AS contribution_offensive_equipe
FROM s
""")
def season_change_features(t: Tables) -> DataFrame:
    return _of(t, "delta_minutes_jouees", "delta_xg", "taux_indisponibilite_prec", "fragilite_chronique", "contribution_offensive_equipe")


@query(BASE + """
SELECT player, season_year, ((season_year + 1) % 4 = 2 OR (player % 3 = 0 AND season_year IN (2020, 2023)) OR
       (player % 3 = 1 AND season_year IN (2020, 2022, 2024)) OR (player % 3 = 2 AND season_year = 2022))::INT::DOUBLE AS competition_internationale FROM b
""")
def cup_features(t: Tables) -> DataFrame:
    return _of(t, "competition_internationale")


@query("""
SELECT s_suppkey, s_acctbal AS "Performance_Gls", round(s_acctbal / nullif(s_suppkey % 9, 0), 4) AS "Per 90 Minutes_Gls",
       round(s_suppkey * 90.0 / nullif(s_nationkey, 0), 4) AS "Playing Time_Mn/MP",
       round(s_suppkey * 90.0 / nullif(s_nationkey, 0) * (100.0 / 90.0), 4) AS "Playing Time_Min%" FROM supplier
""")
def recomputed_ratios(t: Tables) -> DataFrame:
    """Ratios from their merged parts; a zero denominator gives null."""
    null = F.lit(None).cast("double")
    s = t.supplier.select(
        "s_suppkey", F.col("s_acctbal").alias("Performance_Gls"), (F.col("s_suppkey") % 9).cast("double").alias("Playing Time_90s"),
        (F.col("s_suppkey") * 90.0).alias("Playing Time_Min"), F.col("s_nationkey").cast("double").alias("Playing Time_MP"),
        null.alias("Per 90 Minutes_Gls"), null.alias("Playing Time_Mn/MP"), null.alias("Playing Time_Min%"),
    )
    return recompute_ratios(s).drop("Playing Time_90s", "Playing Time_Min", "Playing Time_MP")


CODES = {"ALGERIA": "ALG", "ARGENTINA": "ARG", "BRAZIL": "BRA", "CANADA": "CAN", "EGYPT": "EGY", "FRANCE": "FRA", "GERMANY": "GER", "UNITED KINGDOM": " Eng", "PERU": "PER"}
WHERE = {"UEFA": ("FRA", "GER"), "CONMEBOL": ("ARG", "BRA", "PER"), "CONCACAF": ("CAN",), "CAF": ("ALG", "EGY"), "AFC": (), "OFC": ()}
ENCODED = (
    "est_anglais", "classement_FIFA_1", "classement_FIFA_7", *(f"confederation_{x}" for x in (*WHERE, "Inconnu")), "pos_DF", "pos_FW", "pos_MF",
    "foot_left", "foot_right",
)


@query(
    "WITH c AS (SELECT n_nationkey, CASE n_name "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CODES.items())
    + " ELSE 'XXX' END AS code FROM nation) SELECT n_nationkey, (lower(trim(code)) = 'eng')::INT AS est_anglais, "
    + "(n_nationkey = 1)::INT AS \"classement_FIFA_1\", (n_nationkey = 7)::INT AS \"classement_FIFA_7\", "
    + ", ".join(f"(code IN ({', '.join(repr(v) for v in codes) or 'NULL'}) IS TRUE)::INT AS \"confederation_{name}\"" for name, codes in WHERE.items())
    + f", (code NOT IN ({', '.join(repr(v) for codes in WHERE.values() for v in codes)}))::INT AS \"confederation_Inconnu\", "
    + "1 AS \"pos_DF\", (n_nationkey % 3 = 1)::INT AS \"pos_FW\", (n_nationkey % 3 = 2)::INT AS \"pos_MF\", "
    + "(n_nationkey % 2 = 1)::INT AS foot_left, (n_nationkey % 2 = 0)::INT AS foot_right FROM c"
)
def encoded_categories(t: Tables) -> DataFrame:
    """Nation flags and ranks, confederations, positions and feet as one column a category."""
    from kestrel.functions.text import map_or_self
    from kestrel.operators.encode import confederation

    key = F.col("n_nationkey")
    n = t.nation.select(
        "n_nationkey", map_or_self(F.col("n_name"), CODES, F.lit("XXX")).alias("nation"), key.alias("rank"),
        F.when(key % 3 == 1, "DF, FW").when(key % 3 == 2, "DF,MF").otherwise("DF").alias("pos"), F.when(key % 2 == 0, "right").otherwise("left").alias("foot"),
    ).withColumn("confederation", confederation(F.col("nation")))
    return encoded(n).select("n_nationkey", *ENCODED)


#: The whole learning table, from sources made of customers (players), their orders (matches), nations (two clubs each).
TABLE = """
WITH o AS (
  SELECT c_custkey AS id, c_name AS player, n_name, n_nationkey, n_regionkey, c_mktsegment AS league, year(o_orderdate)::INT + 25 AS sy, o_orderkey, (o_orderkey % 2)::INT AS half
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), m AS (
  SELECT id, player, sy, any_value(league) AS league, any_value(n_name) || ' ' || max(half) AS team, any_value(n_regionkey) AS region, any_value(n_nationkey) + max(half) AS classement,
         count(*)::DOUBLE AS gls, sum(o_orderkey % 5)::DOUBLE AS ast, sum(o_orderkey % 90)::DOUBLE AS mins, sum(o_orderkey % 7) / 4.0 AS xg,
         CASE WHEN id % 2 = 0 THEN sum(o_orderkey % 40) ELSE 0 END AS days
  FROM o GROUP BY 1, 2, 3
), k AS (
  SELECT *, gls * 1000 + id AS value, (id % 3)::INT AS position, CASE WHEN id % 5 > 0 THEN (sy - (1990 + id % 12))::DOUBLE END AS own_age, (150 + id % 70)::DOUBLE AS own_height,
         CASE WHEN sy BETWEEN 2020 AND 2022 THEN 'train' WHEN sy = 2023 THEN 'validation' WHEN sy = 2024 THEN 'test' WHEN sy = 2025 THEN 'in_progress' END AS split,
         least(days / 365.0, 1.0) AS taux, (CASE region WHEN 0 THEN 5 WHEN 1 THEN 1 WHEN 2 THEN 11 WHEN 3 THEN 3 ELSE 997 END + sy % 2 + CASE WHEN region = 4 THEN 2 - sy % 2 ELSE 0 END)::INT AS rank
  FROM m WHERE (id + sy) % 4 <> 0
), l AS (
  SELECT *, ln(1 + lag(value) OVER w) AS own_log, lag(sy) OVER w AS before, lag(mins) OVER w AS mins_before, lag(xg) OVER w AS xg_before, lag(taux) OVER w AS taux_before
  FROM k WINDOW w AS (PARTITION BY player ORDER BY sy)
), t AS (SELECT * FROM l WHERE split = 'train'),
h1 AS (SELECT position, median(own_height) AS v FROM t WHERE own_height BETWEEN 155 AND 210 GROUP BY 1),
h0 AS (SELECT median(own_height) AS v FROM t WHERE own_height BETWEEN 155 AND 210),
a0 AS (SELECT median(own_age) AS v FROM t),
g3 AS (SELECT league, position, sy, median(own_log) AS v FROM t WHERE own_log IS NOT NULL GROUP BY 1, 2, 3),
g2 AS (SELECT league, position, median(own_log) AS v FROM t WHERE own_log IS NOT NULL GROUP BY 1, 2),
g1 AS (SELECT position, median(own_log) AS v FROM t WHERE own_log IS NOT NULL GROUP BY 1),
g0 AS (SELECT median(own_log) AS v FROM t),
f AS (
  SELECT l.*, coalesce(own_age, a0.v, 25) AS age, CASE WHEN own_height BETWEEN 155 AND 210 THEN own_height ELSE coalesce(h1.v, h0.v, 0) END AS height,
         coalesce(own_log, g3.v, g2.v, g1.v, g0.v, 0) AS log_prev, sum(gls) OVER (PARTITION BY team, l.sy) AS team_gls
  FROM l LEFT JOIN h1 USING (position) LEFT JOIN g3 ON l.league = g3.league AND l.position = g3.position AND l.sy = g3.sy
  LEFT JOIN g2 ON l.league = g2.league AND l.position = g2.position LEFT JOIN g1 ON l.position = g1.position, h0, a0, g0
)
SELECT player, sy AS season_year, split, team, classement::INT AS classement, gls, mins, xg, days::INT AS injury_days_total, age, height AS height_in_cm, round(log_prev, 6) AS log_prev_value,
       (region = 3)::INT AS est_anglais, (rank = 3)::INT AS "classement_FIFA_3", (region = 3)::INT AS "confederation_UEFA", (region = 4)::INT AS "confederation_Inconnu",
       (position = 1)::INT AS "pos_MF", (position = 2)::INT AS "pos_FW", (position = 1)::INT AS est_polyvalent, (league = 'BUILDING')::INT AS "league_BUILDING", (id % 2 = 0)::INT AS foot_left,
       CASE WHEN rank <= 10 THEN 11 - rank ELSE 0 END::INT AS score_hype_nation, age - 25 AS pic_distance, (age BETWEEN 24 AND 28)::INT AS pic_age,
       ((sy + 1) % 4 = 2 OR (region = 3 AND sy IN (2020, 2023)) OR (region = 1 AND sy IN (2020, 2023)) OR (region = 0 AND sy IN (2020, 2022, 2024)) OR (region = 2 AND sy = 2022))::INT AS competition_internationale,
       round(taux, 6) AS taux_indisponibilite, round(coalesce(taux_before, 0), 6) AS taux_indisponibilite_prec, (taux > 0.15 AND coalesce(taux_before, 0) > 0.15)::INT AS fragilite_chronique,
       CASE WHEN sy - before = 1 THEN mins - mins_before ELSE 0 END::DOUBLE AS delta_minutes_jouees, CASE WHEN sy - before = 1 THEN xg - xg_before ELSE 0 END::DOUBLE AS delta_xg,
       round((gls + ast) / team_gls, 6) AS contribution_offensive_equipe, round(CASE WHEN mins > 0 THEN gls / mins ELSE 0 END, 6) AS rentabilite_buts_minutes
FROM f
"""


@query(TABLE)
def learning_table_rows(t: Tables) -> DataFrame:
    """Seven sources linked, enriched, merged, cleaned, imputed, encoded, derived and split, end to end."""
    nation = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key, half, year = F.col("c_custkey"), (F.col("o_orderkey") % 2).cast("int"), (F.year("o_orderdate") + 25).cast("int")
    code = lambda sep: F.concat(F.substring(F.col("sy").cast("string"), 3, 2), F.lit(sep), F.substring((F.col("sy") + 1).cast("string"), 3, 2))
    nations = F.element_at(F.array(*(F.lit(x) for x in ("SEN", "BRA", "JPN", "ENG", "XXX"))), (F.col("n_regionkey") + 1).cast("int"))
    o = o.select(
        key.alias("id"), F.col("c_name").alias("player"), F.concat_ws(" ", "n_name", half).alias("team"), F.col("c_mktsegment").alias("league"), year.alias("sy"),
        nations.alias("nation"), F.col("n_nationkey").cast("int").alias("n_nationkey"), half.alias("half"), F.col("o_orderkey").alias("k"), "n_name",
    )
    o, _ = materialize(o, "orders")  # seven sources are made of it
    pick = lambda *names: F.element_at(F.array(*(F.lit(n) for n in names)), (F.col("id") % 3 + 1).cast("int"))
    minutes = F.sum(F.col("k") % 90).cast("double")
    performance = o.groupBy("id", "player", "team", "league", "sy", "nation").agg(
        F.count(F.lit(1)).cast("double").alias("Performance_Gls"), F.sum(F.col("k") % 5).cast("double").alias("Performance_Ast"),
        minutes.alias("Playing Time_Min"), (minutes / 90).alias("Playing Time_90s"), (F.sum(F.col("k") % 7) / 4).alias("xg"),
    ).select("player", "team", "league", code("").alias("season"), "nation", pick("GK", "DF,MF", "FW").alias("pos"), "Performance_Gls", "Performance_Ast", "Playing Time_Min", "Playing Time_90s", "xg")
    who = o.select("id", "player", "n_name").distinct()
    mapping = who.select(F.col("player").alias("PlayerFBref"), F.col("id").alias("tm_id"))
    born = F.when(F.col("id") % 5 > 0, F.make_date(1990 + F.col("id") % 12, F.lit(5), F.lit(5)))
    players = who.select(
        F.col("id").alias("player_id"), F.col("player").alias("name"), born.alias("date_of_birth"), pick("Goalkeeper", "Defender", "Attack").alias("position"),
        pick("GK", "CB", "ST").alias("sub_position"), F.when(F.col("id") % 2 == 0, "left").otherwise("right").alias("foot"), (150 + F.col("id") % 70).cast("double").alias("height_in_cm"),
    )
    worth = o.groupBy("id", "sy", "n_name").agg(F.count(F.lit(1)).cast("double").alias("n")).where((F.col("id") + F.col("sy")) % 4 != 0)
    # Each season an early value, and a later one that counts.
    dated = [(9, F.lit(1), F.col("n")), (10, F.col("id") % 20 + 1, F.col("n") * 1000 + F.col("id"))]
    values = None
    for month, day, value in dated:
        own = worth.select(F.col("id").alias("player_id"), F.make_date("sy", F.lit(month), day).alias("date"), value.cast("double").alias("market_value_in_eur"), F.col("n_name").alias("current_club_name"))
        values = own if values is None else values.unionByName(own)
    hurt = o.where("id % 2 = 0").select(
        F.col("id").alias("player_id"), code("/").alias("Saison"), F.lit("knee").alias("Blessure"), F.concat(F.col("k") % 40, F.lit(" days")).alias("Jours"), F.lit("1").alias("Matchs_Manques")
    )
    standings = o.select(F.col("sy").alias("season_year"), "team", (F.col("n_nationkey") + F.col("half")).alias("classement")).distinct()
    best = F.when(F.col("nation") == "SEN", 5).when(F.col("nation") == "BRA", 1).when(F.col("nation") == "JPN", 11).when(F.col("nation") == "ENG", 3)
    ranking = o.where("nation <> 'XXX'").select(F.col("nation").alias("country_abrv"), F.make_date("sy", F.lit(10), F.lit(1)).alias("rank_date"), (best + F.col("sy") % 2).cast("int").alias("rank")).distinct()
    table, _ = build(performance, mapping, players, values, hurt, standings, ranking)
    exact = ["player", "season_year", "split", "team", "classement", "injury_days_total", "age", "height_in_cm", "est_anglais", "classement_FIFA_3", "confederation_UEFA", "confederation_Inconnu"]
    exact += ["pos_MF", "pos_FW", "est_polyvalent", "league_BUILDING", "foot_left", "score_hype_nation", "pic_distance", "pic_age", "competition_internationale", "fragilite_chronique"]
    rounded = ["log_prev_value", "taux_indisponibilite", "taux_indisponibilite_prec", "contribution_offensive_equipe", "rentabilite_buts_minutes"]
    return table.select(
        *(F.col(n).cast("int").alias(n) if n in ("classement", "injury_days_total") else F.col(n) for n in exact), *(F.round(n, 6).alias(n) for n in rounded),
        F.col("Performance_Gls").alias("gls"), F.col("Playing Time_Min").alias("mins"), "xg", "delta_minutes_jouees", "delta_xg",
    )
