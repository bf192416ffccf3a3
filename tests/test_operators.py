"""Operators whose semantics one SQL query would not show: linkage, plans, files, models."""

import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from kestrel.operators import aggregates, columns, encode, linkage, metrics, splits, similarity
from kestrel.plans import learning_table as lt
from kestrel.plans import modelling as m
from kestrel.sources import files, html
from kestrel.storage import scratch


def test_cascade_methods(spark):
    players = spark.createDataFrame(
        [(1, 2020, "kevin de bruyne", "man city"), (2, 2020, "de bruyne kevin x", "man city"), (3, 2020, "luka modric", "real madrid"),
         (4, 2020, "luca modrik", "real madrid"), (5, 2020, "nobody here", "none")],
        "row_id long, season int, name_clean string, club_clean string",
    )
    mapping = spark.createDataFrame([("kevin de bruyne", 10)], "name_clean string, tm_id long")
    values = spark.createDataFrame(
        [(2020, "luka modric", "real madrid", 20), (2019, "nobody here", "none", 30)],
        "season int, name_clean string, club_clean string, tm_id long",
    )
    found, orphans = linkage.cascade(players, mapping, values)
    assert {(r.row_id, r.tm_id, r.match_method) for r in found.collect()} == {
        (1, 10, "exact_mapping"), (2, 10, "fuzzy_mapping"), (3, 20, "exact_valuation"), (4, 20, "fuzzy_valuation"),
    }
    assert [r.row_id for r in orphans.collect()] == [5]


def test_index_finds_what_the_whole_block_holds(spark):
    names = ["anna berg", "berg anna", "ana berg", "carl dahl", "karl dahl"]
    df = spark.createDataFrame([(1, n) for n in names], "b int, name string")
    every = {(r.l, r.r) for r in linkage.block_pairs(df, df, ["b"], "name").collect()}
    own = similarity.distinct_names(df, ["b"], "name")
    with scratch(spark) as out:
        got = {(r.l, r.r) for r in similarity.candidates(own, own, ["b"], out, 85, 75).collect()}
    assert got < every and len(every) == 25
    assert {("anna berg", "berg anna"), ("anna berg", "ana berg"), ("carl dahl", "karl dahl")} <= got


def test_names_with_another_head_are_matched(spark):
    schema = "row_id long, season int, name_clean string, club_clean string"
    players = spark.createDataFrame([(1, 2020, "thiago", "x"), (2, 2020, "ronaldo", "y")], schema)
    mapping = spark.createDataFrame([("tiago", 10)], "name_clean string, tm_id long")
    values = spark.createDataFrame([(2020, "tiago", "x", 10), (2020, "onaldo", "y", 20)], "season int, name_clean string, club_clean string, tm_id long")
    found, orphans = linkage.cascade(players, mapping, values)
    assert {(r.row_id, r.tm_id) for r in found.collect()} == {(1, 10), (2, 20)} and orphans.count() == 0
    near = linkage.diagnose(players, values, "name_clean", "row_id")
    assert {(r.row_id, r.nearest, r.reason) for r in near.collect()} == {(1, "tiago", linkage.TO_VERIFY), (2, "onaldo", linkage.TO_VERIFY)}
    dim = values.drop("club_clean")
    assert {r.tm_id for r in linkage.fuzzy_dimension(players, dim, ["season"], "name_clean", ["tm_id"]).collect()} == {10, 20}


def test_league_table_breaks_ties_by_name(spark):
    rows = [("E", "14/08/2020", "A", "B", 1, 1), ("E", "15/08/2020", "C", "A", 0, 2), ("E", "bad", "A", "B", 5, 0)]
    df = spark.createDataFrame(rows, "league string, Date string, HomeTeam string, AwayTeam string, FTHG int, FTAG int")
    got = {(r.team, r.points, r.classement) for r in lt.league_table(df).collect()}
    assert got == {("A", 4, 1), ("B", 1, 2), ("C", 0, 3)}


def test_injuries(spark):
    rows = [(1, "23/24", "Hamstring tear", "24 days", "5"), (1, "23/24", "Knee problem", "10 days", "-"), (1, "23/24", "unknown", None, "2")]
    df = spark.createDataFrame(rows, "player_id long, Saison string, Blessure string, Jours string, Matchs_Manques string")
    r = lt.injuries_by_season(df).first()
    assert (r.season_year, r.injury_nb_total, r.injury_days_total, r.injury_matches_max_single) == (2023, 3, 34, 5)
    assert (r.injury_musculaire_nb_d, r.injury_genou, r.injury_minor_unknown_nb, r.injury_dos_bassin) == (24, 1, 1, 0)


def test_merge_rules():
    assert aggregates.merge_rule("Performance_Gls", True) == "sum"
    assert aggregates.merge_rule("Standard_SoT%", True) == "mean"
    assert aggregates.merge_rule("market_value_in_eur", True) == "last"
    assert aggregates.merge_rule("team", False) == "last"
    assert aggregates.merge_rule("height_in_cm", True, {"height_in_cm": "last"}) == "last"


def test_learning_table_end_to_end(spark):
    performance = spark.createDataFrame(
        [("Kévin Un", "FC Köln", "L1", s, "GER", "MF", 5.0, 2.0, 900.0, 10.0, 1.0) for s in ("2021", "2122", "2324")]
        + [("Paul Deux", "AS Roma", "L2", "2021", "ITA", "FW", 3.0, 1.0, 450.0, 5.0, None), ("Paul Deux", "Inter", "L2", "2021", "ITA", "FW", 1.0, 0.0, 90.0, 1.0, 0.5),
           ("Inconnu Total", "Inter", "L2", "2021", "ITA", "FW", 1.0, 0.0, 90.0, 1.0, 0.5)],
        "player string, team string, league string, season string, nation string, pos string, Performance_Gls double, Performance_Ast double, "
        "`Playing Time_Min` double, `Playing Time_90s` double, xg double",
    )
    mapping = spark.createDataFrame([("Kevin Un", 1)], "PlayerFBref string, tm_id long")
    players = spark.createDataFrame(
        [(1, "Kevin Un", "1995-01-01", "Midfield", "CM", "right", 180.0), (2, "Paul Deux", "1999-05-05", "Attack", "ST", "left", 999.0)],
        "player_id long, name string, date_of_birth string, position string, sub_position string, foot string, height_in_cm double",
    ).withColumn("date_of_birth", F.to_date("date_of_birth"))
    values = spark.createDataFrame(
        [(1, "2020-10-01", 1e6, "fc koln"), (1, "2021-10-01", 2e6, "fc koln"), (1, "2023-10-01", 3e6, "fc koln"), (2, "2020-10-01", 5e5, "roma")],
        "player_id long, date string, market_value_in_eur double, current_club_name string",
    ).withColumn("date", F.to_date("date"))
    injuries = spark.createDataFrame([(1, "21/22", "knee", "5 days", "1")], "player_id long, Saison string, Blessure string, Jours string, Matchs_Manques string")
    standings = spark.createDataFrame([(2020, "FC Koln", 9), (2020, "Roma", 7), (2020, "Inter", 1)], "season_year int, team string, classement int")
    ranking = spark.createDataFrame([("GER", "2021-01-01", 3)], "country_abrv string, rank_date string, rank int").withColumn("rank_date", F.to_date("rank_date"))
    table, orphans = lt.build(performance, mapping, players, values, injuries, standings, ranking)
    rows = {(r.player, r.season_year): r for r in table.collect()}
    assert set(rows) == {("Kévin Un", 2020), ("Kévin Un", 2021), ("Kévin Un", 2023), ("Paul Deux", 2020)}
    assert [r.player for r in orphans.collect()] == ["Inconnu Total"]
    two = rows["Paul Deux", 2020]
    assert (two["Performance_Gls"], two["Playing Time_Min"], two.split) == (4.0, 540.0, "train")
    one = rows["Kévin Un", 2021]
    assert one.injury_days_total == 5 and one.log_prev_value == pytest.approx(np.log1p(1e6)) and one.confederation == "UEFA"
    assert rows["Kévin Un", 2020].classement_FIFA_3 == 1 and rows["Kévin Un", 2023].split == "validation"
    assert rows["Kévin Un", 2023].delta_minutes_jouees == 0.0
    assert {
        "est_anglais", "classement_FIFA_10", "confederation_UEFA", "confederation_Inconnu", "pos_MF", "pos_FW", "sub_position_CM", "league_L1", "foot_left",
        "age", "log_prev_value", "est_polyvalent", "pic_distance", "age_sq", "pic_age", "competition_internationale", "delta_minutes_jouees", "delta_xg",
        "taux_indisponibilite", "taux_indisponibilite_prec", "fragilite_chronique", "contribution_offensive_equipe", "rentabilite_buts_minutes",
        "efficacite_devant_but", "score_hype_nation",
    } <= set(table.columns)
    assert one.pos_MF == 1 and one.foot_right == 1 and one.est_polyvalent == 0 and one.age == 26.0


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "Élan"), (2, float("nan"), None)], "id int, x double, s string")
    files.write_csv(df, f"{tmp_path}/a", bom=True)
    got = files.read_csv(spark, f"{tmp_path}/a", "id int, x double, s string")
    assert sorted(map(tuple, got.collect())) == [(1, 1.5, "Élan"), (2, None, None)]
    files.write_csv(df, f"{tmp_path}/b", decimal_comma=True)
    assert "1;1,5;Élan" in "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/b").collect())
    latin = tmp_path / "latin.csv"
    latin.write_bytes("n\nÖzil\n".encode("latin-1"))
    assert files.read_csv(spark, str(latin), "n string", encoding="ISO-8859-1").first()[0] == "Özil"
    (tmp_path / "j" / "sub").mkdir(parents=True)
    (tmp_path / "j" / "sub" / "77.json").write_text('[{"team": {"id": 1}, "lineup": [{"p": {"n": "x"}}, {"p": {"n": "y"}}]}]')
    schema = "team struct<id: long>, lineup array<struct<p: struct<n: string>>>"
    rec = files.read_records(spark, f"{tmp_path}/j", schema, "lineup", ["team"], key="match_id")
    assert sorted(map(tuple, rec.collect())) == [(77, 1, "x"), (77, 1, "y")] and rec.columns == ["match_id", "team.id", "p.n"]
    files.write_params(spark, {"é": 1}, f"{tmp_path}/p")
    assert files.read_params(spark, f"{tmp_path}/p") == {"é": 1}
    df.write.parquet(f"{tmp_path}/t")
    assert files.replace_table(spark.read.parquet(f"{tmp_path}/t").where("id = 1"), f"{tmp_path}/t").count() == 1


def test_html_table(spark):
    df = spark.createDataFrame([(1, "<table><tr><th>A</th></tr><tr class='x'><td><b>1</b></td><td>2 &amp; 3</td></tr></table>")], "id int, h string")
    assert [(r.row, r.cells) for r in html.table_rows(df, "h", "id").collect()] == [(0, ["A"]), (1, ["1", "2 & 3"])]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2.0, None, "a"), (1, 3.0, 4.0, "b")], "k int, x double, y double, s string")
    assert columns.without_constant(df).columns == ["x", "s"]  # y has one known value
    assert columns.align(df, ["z", "x"]).columns == ["z", "x"]
    assert columns.prune_sparse(df, 0.2).columns == ["k", "x", "s"]
    assert columns.join_levels(["Performance", "", "Unnamed: 1"]) == "Performance"
    with pytest.raises(ValueError):
        encode.categories(df, "x", most=1)


def test_nnls_and_stack(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float(3 * a + 1)) for i, (a, b) in enumerate(rng.uniform(1, 9, (200, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    intercept, w = m.nnls(df, "y", ["a", "b"])
    assert intercept == pytest.approx(1, abs=1e-6) and w["a"] == pytest.approx(3, abs=1e-6) and w["b"] == pytest.approx(0, abs=1e-6)
    assert m.nnls(df.withColumn("y", -F.col("y")), "y", ["a"])[1]["a"] == 0.0
    learners = {"ols": LinearRegression(labelCol="label", weightCol="weight", regParam=1e-6)}
    stack = m.Stack(["a", "b"], "y").fit(df, ["id"], 4, learners)
    done = stack.predict(df)
    assert metrics.errors(done, "y", "predicted").first()["mape"] < 0.2
    shuffled = m._shuffled(df, "a", 1)
    assert sorted(r[0] for r in shuffled.select("a").collect()) == sorted(r[0] for r in df.select("a").collect())


def test_hashed_split_depends_on_the_key_alone(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    shares = {"train": 0.7, "val": 0.15, "test": 0.15}
    a = {r.k: r.split for r in splits.hashed(df, ["k"], shares).collect()}
    b = {r.k: r.split for r in splits.hashed(df.repartition(7), ["k"], shares).collect()}
    assert a == b and 620 < sum(v == "train" for v in a.values()) < 780
    assert splits.sample(df, ["k"], 10).count() == 10
