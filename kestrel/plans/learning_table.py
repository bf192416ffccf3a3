"""The learning table: link sources, enrich, merge duplicates, clean, impute, encode, derive, split.

Sources (see FIXTURES.md): players, valuations, performance, mapping, injuries,
standings, ranking.  Plans are declared; only the linkage steps write intermediates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import seasons, text
from kestrel.functions.numbers import first_int, leading_int
from kestrel.operators import aggregates, encode, impute, linkage, splits, windows
from kestrel.operators.columns import c
from kestrel.plans.features import engineer
from kestrel.storage import materialize


def valuations_by_season(players: DataFrame, valuations: DataFrame, start_month: int = seasons.SEPTEMBER) -> DataFrame:
    """Last known value and club per (player, season), with the player's name and birth date."""
    dated = valuations.withColumn("season_year", seasons.season_year(c("date"), start_month))
    last = windows.last_known(dated, ["player_id", "season_year"], ["date"], ["market_value_in_eur", "current_club_name"])
    who = players.select("player_id", "name", "date_of_birth", "position", "sub_position", "foot", "height_in_cm")
    return last.join(who, "player_id")


def bounded_by_activity(appearances: DataFrame, valuations: DataFrame) -> DataFrame:
    """Valuations dated within the player's first and last appearance."""
    span = appearances.groupBy("player_id").agg(F.min("date").alias("__from"), F.max("date").alias("__to"))
    return valuations.join(span, "player_id").where(c("date").between(c("__from"), c("__to"))).drop("__from", "__to")


def injuries_by_season(injuries: DataFrame) -> DataFrame:
    """Counts, days and longest absence per (player, season), overall and per injury family."""
    days = F.coalesce(first_int(c("Jours")), F.lit(0))
    games = F.coalesce(c("Matchs_Manques").try_cast("int"), F.lit(0))
    dated = injuries.withColumn("season_year", seasons.season_from_code(c("Saison")))
    out = aggregates.families(dated, ["player_id", "season_year"], "Blessure", days, games, aggregates.INJURY_FAMILIES)
    names = {"nb_total": "injury_nb_total", "amount_total": "injury_days_total", "peak_max": "injury_matches_max_single"}
    for family in (*aggregates.INJURY_FAMILIES, "minor_unknown"):
        names |= {
            f"{family}_nb": f"injury_{family}_nb",
            f"{family}_amount": f"injury_{family}_nb_d",
            f"{family}_peak": f"injury_{family}_nb_m",
            family: f"injury_{family}",
        }
    return out.withColumnsRenamed(names)


def league_table(matches: DataFrame) -> DataFrame:
    """Final position of every club per league and July season, from match results (dates day-first)."""
    played = matches.withColumn("day", F.try_to_date("Date", "dd/MM/yyyy")).na.drop(subset=["day", "FTHG", "FTAG"])
    played = played.withColumn("season_year", seasons.season_year(c("day"), seasons.JULY))
    points = windows.match_points(played, ["league", "season_year"], "HomeTeam", "AwayTeam", "FTHG", "FTAG")
    return windows.standings(points, ["league", "season_year"], "team", "points", "goal_diff", "goals_for", "classement")


def nation_rank(ranking: DataFrame) -> DataFrame:
    """Last rank of every nation per September season."""
    dated = ranking.withColumn("season_year", seasons.season_year(c("rank_date"), seasons.SEPTEMBER))
    return windows.last_known(dated, ["country_abrv", "season_year"], ["rank_date"], ["rank"])


def link(performance: DataFrame, mapping: DataFrame, values: DataFrame, score_min: float = 90) -> tuple[DataFrame, DataFrame]:
    """(performance rows with tm_id and match_method, orphans)."""
    name, club = text.normalise_name(c("player")), text.clean_club(c("team"))
    left = performance.withColumns(
        {
            "season_year": seasons.season_from_code(c("season")),
            "name_clean": name,
            "club_clean": club,
            "row_id": F.xxhash64("player", "team", "league", "season"),
        }
    )
    left, _ = materialize(left, "performance")
    known = mapping.select(text.normalise_name(c("PlayerFBref")).alias("name_clean"), "tm_id")
    pool = values.select(
        "season_year",
        text.normalise_name(c("name")).alias("name_clean"),
        text.clean_club(c("current_club_name")).alias("club_clean"),
        c("player_id").alias("tm_id"),
    )
    found, orphans = linkage.cascade(left.select("row_id", "season_year", "name_clean", "club_clean"), known, pool, season="season_year", score_min=score_min)
    return left.join(found, "row_id"), left.join(orphans.select("row_id"), "row_id", "left_semi")


def encoded(df: DataFrame) -> DataFrame:
    """Nation flags and ranks, confederations, positions and one column a category; the schema follows the whole table."""
    out = df.withColumn("est_anglais", F.coalesce(F.lower(F.trim(c("nation"))) == "eng", F.lit(False)).cast("int"))
    out = encode.rank_dummies(out, "rank", 10, "classement_FIFA")
    out = encode.one_hot(out, "confederation", [*encode.CONFEDERATIONS, "Inconnu"])
    if "pos" in df.columns:
        parts = df.select(F.explode(F.split("pos", ",")).alias("label")).select(F.trim("label").alias("label")).where("label <> ''")
        labels = encode.categories(parts, "label", 50)
        out = encode.multi_label(out, "pos", labels, "pos") if len(labels) > 1 else out
        out = out.drop("pos")
    for name in ("sub_position", "league", "foot"):
        if name in df.columns:
            out = encode.one_hot(out, name, encode.categories(df, name))
    return out


def build(
    performance: DataFrame, mapping: DataFrame, players: DataFrame, valuations: DataFrame, injuries: DataFrame,
    standings: DataFrame, ranking: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """(learning table with a ``split`` column, orphans)."""
    # Read by several of the next steps.
    values, _ = materialize(valuations_by_season(players, valuations), "values")
    linked, orphans = link(performance, mapping, values)
    hurt = injuries_by_season(injuries).withColumnRenamed("player_id", "tm_id")
    hurt_columns = [n for n in hurt.columns if n.startswith("injury_")]
    clubs = standings.select(
        "season_year", text.map_or_self(text.clean_club(c("team")), text.CLUB_SYNONYMS).alias("club_clean"), "classement"
    )
    table = linked.withColumn("club_clean", text.map_or_self(c("club_clean"), text.CLUB_SYNONYMS))
    table = linkage.fuzzy_dimension(table, clubs, ["season_year"], "club_clean", ["classement"])
    merged = aggregates.merge_duplicates(
        table.drop("row_id", "name_clean", "club_clean", "score"),
        ["player", "season_year"],
        ["team", "league"],
        # Positions of clubs are not additive over a season's clubs.
        {"classement": "last", "season": "last"},
    )
    merged = aggregates.recompute_ratios(merged)
    # A player's identity follows from name and season, so what is known of it is joined to merged rows, not to each club's.
    identity = values.drop("current_club_name").withColumnRenamed("player_id", "tm_id")
    own = [n for n in identity.columns if n not in ("tm_id", "season_year")]
    # A player listed twice is one player; of two entries the larger one counts.
    identity = identity.groupBy("tm_id", "season_year").agg(*(F.max(c(n)).alias(n) for n in own))
    known = merged.join(identity.where("market_value_in_eur IS NOT NULL"), ["tm_id", "season_year"])
    known = known.join(hurt, ["tm_id", "season_year"], "left").fillna(0, hurt_columns)
    ranks = nation_rank(ranking).select(c("country_abrv").alias("nation"), "season_year", "rank")
    known = known.join(ranks, ["nation", "season_year"], "left")
    known = known.fillna(999, ["rank"]).withColumn("confederation", encode.confederation(c("nation")))
    age = c("season_year") - F.year("date_of_birth")
    if "age" in known.columns:  # the source's own age ("23-328") where the birth date is unknown
        age = F.coalesce(age, leading_int(c("age")))
    known = known.withColumn("age", age.cast("double"))
    known, _ = materialize(known, "known")  # its categories are counted before it is encoded
    known = encoded(known)
    known = splits.temporal(known, "season_year")
    train = known.where("split = 'train'")
    known = impute.hierarchical(known, train, "age", [()], 25.0)
    known = impute.replace_outliers(known, train, "height_in_cm", 155, 210, ["position"])
    known = windows.lagged(known, ["player"], "season_year", "market_value_in_eur", "prev_value", False)
    known = known.withColumn("log_prev_value", F.log1p("prev_value")).drop("prev_value")
    known = impute.hierarchical(
        known, known.where("split = 'train'"), "log_prev_value",
        [["league", "position", "season_year"], ["league", "position"], ["position"], ()], 0.0,
    )
    return engineer(known), orphans
