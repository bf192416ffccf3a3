import numpy as np
import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from kestrel.plans import explain, tuning
from kestrel.plans import modelling as m


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(a), float(b), float(k)) for i, (a, b, k) in enumerate(zip(rng.uniform(0, 4, 200), rng.uniform(0, 4, 200), rng.integers(0, 2, 200), strict=True))]
    return spark.createDataFrame(data, "id long, a double, b double, pos_gk double")


def linear(df):
    return df.withColumn("predicted", 3 * F.col("a") - 2 * F.col("b") + 1)


def test_sampled_shap_is_exact_for_a_linear_score(spark, rows):
    few = rows.where("id < 5").unionByName(spark.createDataFrame([(99, None, 1.0, None)], rows.schema))
    got = explain.sampled_shap(linear, few, rows, "id", ["a", "b", "pos_gk"], ["id"], walks=6)
    by = {(r.id, r.feature): r.shap for r in got.collect()}
    start = explain.sample(rows, ["id"], 6, explain.SEED).agg(F.avg("a"), F.avg("b")).first()
    for r in few.collect():
        assert by[r.id, "a"] == pytest.approx(3 * ((r.a or 0) - start[0])) and by[r.id, "pos_gk"] == pytest.approx(0)
        assert by[r.id, "b"] == pytest.approx(-2 * (r.b - start[1]))
    assert len(by) == 18
    both = {(r.id, r.feature): r.shap for r in explain.grouped(got, "id", {"ab": ["a", "b"]}).collect()}
    assert both[1, "ab"] == pytest.approx(by[1, "a"] + by[1, "b"]) and (1, "pos_gk") in both
    assert explain.importance(got).count() == 3
    assert explain.sampled_shap(linear, rows.limit(0), rows, "id", ["a", "b"], ["id"], walks=2).count() == 0
    with pytest.raises(ValueError):
        explain.sampled_shap(linear, few, rows.limit(0), "id", ["a", "b"], ["id"], walks=2)


def test_sampled_shap_adds_up_for_any_score(rows):
    score = lambda df: df.withColumn("predicted", F.col("a") * F.col("b") + F.col("pos_gk"))
    few = rows.where("id < 4")
    got = explain.sampled_shap(score, few, rows, "id", ["a", "b", "pos_gk"], ["id"], walks=4)
    total = {r.id: r.s for r in got.groupBy("id").agg(F.sum("shap").alias("s")).collect()}
    base = score(explain.sample(rows, ["id"], 4, explain.SEED)).agg(F.avg("predicted")).first()[0]
    for r in score(few).collect():
        assert total[r.id] == pytest.approx(r.predicted - base)


def test_surrogate(rows):
    found = dict(explain.surrogate(linear, {"a": 3.9, "b": 0.1, "pos_gk": 1.0}, rows, ["a", "b", "pos_gk"], samples=2000))
    a, b, k = (next(v for n, v in found.items() if f in n) for f in ("a >", "b <=", "pos_gk"))
    assert a > 2 and b > 1 and abs(k) < 0.7
    assert explain.surrogate(linear, {"a": 3.9}, rows, ["a", "b"], samples=500, most=1)[0][0].startswith("a > ")


def test_readable():
    row, families = {"pos_gk": 0, "pos_left_wing": 1}, {"pos_": "Poste"}
    assert explain.readable("pos_gk <= 0.00", row, families) == "Poste : Left wing (≠ Gk)"
    assert explain.readable("pos_left_wing > 0.00", row, families) == "Poste : Left wing"
    assert explain.readable("pos_gk <= 0.00", {}, families) == "Poste : Inconnu (≠ Gk)"
    assert explain.readable("est_anglais > 0.00", row, families) == "Oui : est_anglais"
    assert explain.readable("1.00 < age <= 2.00", row, families) == "1.00 < age <= 2.00"


def test_search():
    space = {"x": tuning.Range(-5, 5), "rate": tuning.Range(1e-4, 1, log=True), "n": tuning.Range(1, 9, whole=True), "kind": ["p", "q"]}
    loss = lambda p: (p["x"] - 1) ** 2 + (np.log10(p["rate"]) + 2) ** 2 + abs(p["n"] - 4) + (p["kind"] == "p")
    best, value, done = tuning.search(loss, space, trials=75)
    assert len(done) == 75 and value == min(v for _, v in done) and best["kind"] == "q" and isinstance(best["n"], int)
    chance = np.median([tuning.search(loss, space, trials=75, first=75, seed=s)[1] for s in range(9)])
    assert np.median([tuning.search(loss, space, trials=75, seed=s)[1] for s in range(9)]) < chance
    assert tuning.search(lambda p: float("nan"), space, trials=3)[1] == float("inf")


def test_tune(rows):
    ready = m.prepare(rows.withColumn("y", F.expm1(F.col("a") / 4)), "y", ["a", "b"])
    make = lambda p: LinearRegression(labelCol="label", regParam=p["reg"])
    best, value, done = tuning.tune(make, {"reg": tuning.Range(1e-4, 10, log=True)}, ready.where("id % 2 = 0"), ready.where("id % 2 = 1"), trials=4)
    assert value == min(v for _, v in done) and value < 0.3
    assert "prediction" in tuning.robust_linear().fit(ready).transform(ready).columns


def test_sampled_shap_holds_one_group_a_row(rows):
    """Scores are added up in one aggregation by the row's key, a sum an input: no row is exploded into its steps."""
    score = lambda df: df.withColumn("predicted", F.col("a") * F.col("b") + F.col("pos_gk"))
    got = explain.sampled_shap(score, rows, rows, "id", ["a", "b", "pos_gk"], ["id"], walks=4)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [id#") == 1 and ", at#" not in plan
    assert got.count() == 3 * rows.count()
