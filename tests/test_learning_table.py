"""The learning table's joins: names are prepared only for those who are still looked for, a dimension once, an identity after the merge."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kestrel.operators import linkage, similarity
from kestrel.plans import learning_table as lt


def unwanted(*a, **k):
    raise AssertionError("nobody is left to look for")


def test_no_step_runs_once_everybody_is_matched(spark, monkeypatch):
    players = spark.createDataFrame([(1, 2020, "a b", "x"), (2, 2021, "a b", "y")], "row_id long, season int, name_clean string, club_clean string")
    mapping = spark.createDataFrame([("a b", 11), ("a b", 10), ("c d", 12)], "name_clean string, tm_id long")
    values = spark.createDataFrame([(2020, "a b", "x", 20)], "season int, name_clean string, club_clean string, tm_id long")
    for step in ("fuzzy_step", "fuzzy_club_step"):
        monkeypatch.setattr(linkage, step, unwanted)
    found, orphans = linkage.cascade(players, mapping, values)
    assert {(r.row_id, r.tm_id, r.match_method) for r in found.collect()} == {(1, 10, "exact_mapping"), (2, 10, "exact_mapping")}
    assert orphans.count() == 0 and orphans.columns == players.columns


def test_a_season_that_is_not_known_matches_nobody(spark):
    players = spark.createDataFrame([(1, None, "a b", "x"), (2, 2020, "a b", "y")], "row_id long, season int, name_clean string, club_clean string")
    mapping = spark.createDataFrame([("a b", 10)], "name_clean string, tm_id long")
    values = spark.createDataFrame([(2020, "c d", "x", 20)], "season int, name_clean string, club_clean string, tm_id long")
    found, orphans = linkage.cascade(players, mapping, values)
    assert [r.row_id for r in found.collect()] == [2] and [r.row_id for r in orphans.collect()] == [1]


def test_dimension_is_read_once_and_rows_are_joined_once(spark, monkeypatch):
    rows = spark.createDataFrame([(1, 2020, "roma"), (2, 2020, "lazio rome"), (3, 2020, None), (4, 2021, "roma"), (5, 2020, "roma")], "id int, season int, club string")
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def cleaned(x):
        read.add(1)
        return x.lower()

    clubs = spark.createDataFrame([(2020, "Roma", 3), (2020, "Lazio Roma", 5)], "season int, club string, place int")
    out = linkage.fuzzy_dimension(rows, clubs.withColumn("club", cleaned("club")), ["season"], "club", ["place"])
    assert {(r.id, r.place) for r in out.collect()} == {(1, 3), (2, 5), (3, None), (4, None), (5, 3)}
    assert read.value == 2
    monkeypatch.setattr(similarity, "best", unwanted)
    out = linkage.fuzzy_dimension(rows.where("id IN (1, 3, 5)"), clubs.withColumn("club", F.lower("club")), ["season"], "club", ["place"])
    assert {(r.id, r.place) for r in out.collect()} == {(1, 3), (3, None), (5, 3)}


@pytest.fixture(scope="module")
def table(spark):
    """Ann played for two clubs in a season and is listed twice, once without a birth date; Bo is hurt and has no value in 2021."""
    of = spark.createDataFrame
    performance = of(
        [("Ann", "A", "L", "2021", "ENG", "DF", 2.0, 90.0), ("Ann", "B", "L", "2021", "ENG", "MF", 3.0, 60.0), ("Bo", "A", "L", "2021", "FRA", "GK", 1.0, 30.0), ("Bo", "A", "L", "2122", "FRA", "GK", 9.0, 30.0)],
        "player string, team string, league string, season string, nation string, pos string, Performance_Gls double, `Playing Time_Min` double",
    )
    mapping = of([("Ann", 1), ("Bo", 2)], "PlayerFBref string, tm_id long")
    players = of(
        [(1, "Ann", None, "Defender", "CB", "left", 170.0), (1, "Ann", dt.date(2000, 1, 1), "Defender", "CB", "left", 170.0), (2, "Bo", dt.date(1999, 1, 1), "Goalkeeper", "GK", "right", 190.0)],
        "player_id long, name string, date_of_birth date, position string, sub_position string, foot string, height_in_cm double",
    )
    values = of([(1, dt.date(2020, 10, 1), 5.0, "A"), (2, dt.date(2020, 10, 1), 7.0, "A")], "player_id long, date date, market_value_in_eur double, current_club_name string")
    hurt = of([(2, "20/21", "knee", "4 days", "1"), (2, "20/21", "calf", "3 days", "2")], "player_id long, Saison string, Blessure string, Jours string, Matchs_Manques string")
    standings = of([(2020, "A", 1), (2020, "B", 2)], "season_year int, team string, classement int")
    ranking = of([("ENG", dt.date(2020, 10, 1), 3)], "country_abrv string, rank_date date, rank int")
    built, orphans = lt.build(performance, mapping, players, values, hurt, standings, ranking)
    assert orphans.count() == 0
    return {r.player: r for r in built.collect()}, built.count()


def test_a_player_listed_twice_counts_once(table):
    rows, n = table
    assert n == 2 and set(rows) == {"Ann", "Bo"}
    assert (rows["Ann"]["Performance_Gls"], rows["Ann"]["Playing Time_Min"], rows["Ann"].age, rows["Ann"].market_value_in_eur) == (5.0, 150.0, 20.0, 5.0)
    assert (rows["Bo"]["Performance_Gls"], rows["Bo"].age) == (1.0, 21.0)


def test_identity_and_injuries_are_of_the_merged_row(table):
    rows, _ = table
    assert (rows["Ann"].classement, rows["Ann"].team, rows["Ann"].injury_days_total, rows["Ann"].foot_left) == (2, "B", 0, 1)
    assert (rows["Bo"].classement, rows["Bo"].injury_days_total, rows["Bo"].injury_genou_nb, rows["Bo"].injury_mollet_tibia_nb_d) == (1, 7, 1, 3)
