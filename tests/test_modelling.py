"""Model selection, comparison, search and persistence."""

import difflib

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from kestrel.operators import metrics
from kestrel.plans import learning_table as lt
from kestrel.plans import modelling as m
from kestrel.sources import files


def learner():
    return LinearRegression(labelCol="label", weightCol="weight", regParam=1e-6)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b), float(np.expm1(0.5 * a + 1)), "gk" if i % 3 else "field") for i, (a, b) in enumerate(rng.uniform(1, 9, (240, 2)))]
    return spark.createDataFrame(rows, "id long, a double, b double, y double, g string")


def test_saved_stack_predicts_the_same(spark, data, tmp_path):
    stack = m.Stack(["a", "b"], "y").fit(data, ["id"], 3, {"ols": learner()})
    stack.save(f"{tmp_path}/stack")
    again = m.Stack.load(spark, f"{tmp_path}/stack")
    one, two = ({r.id: r.predicted for r in s.predict(data).collect()} for s in (stack, again))
    assert one == pytest.approx(two) and again.weights == stack.weights


def test_folds_are_contiguous_and_equal(spark):
    rows = [(None if i % 10 == 0 else i // 50, i) for i in range(203)]
    df = spark.createDataFrame(rows, "k int, i int")
    got = m.contiguous_folds(df, ["k", "i"], 4).collect()
    sizes = [sum(r.fold == f for r in got) for f in range(4)]
    assert sum(sizes) == 203 and max(sizes) - min(sizes) <= 1
    order = [r.fold for r in sorted(got, key=lambda r: (-1 if r.k is None else r.k, r.i))]
    assert order == sorted(order)


def test_transforms_are_ranked_and_the_log_wins(data):
    found = m.best_transform(data.where("id % 2 = 0"), data.where("id % 2 = 1"), "y", ["a", "b"], tuple(metrics.TRANSFORMS), learner).collect()
    assert found[0]["transform"] == "log1p" and [r.mae for r in found] == sorted(r.mae for r in found)


def test_inverse_transforms(spark):
    df = spark.createDataFrame([(float(x),) for x in (-7.5, -1, 0, 0.5, 3, 90)], "x double")
    for lam in (-1.0, 0.0, 0.7, 2.0, 3.0):
        back = df.select("x", metrics.from_yeo_johnson(metrics.yeo_johnson(F.col("x"), lam), lam).alias("b")).collect()
        assert [r.b for r in back] == pytest.approx([r.x for r in back])
    same = spark.createDataFrame([(5.0,), (5.0,), (None,)], "x double")
    assert [r.z for r in metrics.min_max_target(same, same, "x", "z").collect()] == [0.0, 0.0, None]


def test_specialised_models_gain_on_split_laws(data):
    two = data.withColumn("y", F.when(F.col("g") == "gk", F.col("y")).otherwise(F.expm1(6 - 0.5 * F.col("a"))))
    found = {r.group: r for r in m.specialised(two, two, "y", ["a", "b"], "g", learner).collect()}
    assert set(found) == {"gk", "field"} and all(r.gain > 0 for r in found.values())


def test_selection_keeps_the_least_number(spark):
    told = spark.createDataFrame([("a", 0.9), ("b", 0.2), ("c", 0.0)], "feature string, importance double")
    assert m.chosen(told, "importance", 0.5, 2) == ["a", "b"] and m.chosen(told, "importance", 0.1, 1) == ["a", "b"]


def test_comparison_refuses_unequal_rows(data):
    with pytest.raises(ValueError):
        m.champion(data.withColumn("p", F.when(F.col("id") > 3, 1.0)), "y", ["p", "a"])
    table = m.champion(data.withColumn("p", F.col("y") * 1.01), "y", ["p", "a"]).collect()
    assert [r.model for r in table if r.champion] == ["p"] == [table[0].model]


def test_silhouettes_peak_at_the_number_of_groups(spark):
    rng = np.random.default_rng(1)
    points = [(float(x), float(y)) for cx, cy in ((0, 0), (20, 0), (0, 20)) for x, y in rng.normal((cx, cy), 0.5, (40, 2))]
    df = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(spark.createDataFrame(points, "x double, y double"))
    found = m.silhouettes(df, (2, 3, 4))
    assert max(found, key=found.get) == 3


def test_suggestions_are_difflibs(spark):
    names = ["Kylian Mbappe", "Kilian Bappe", "Kevin De Bruyne", "Kyle Walker", "Mbappe", "K. Mbappé", "Zidane", "Kylian M"]
    df = spark.createDataFrame([(n,) for n in [*names, None]], "player string")
    got = [r.name for r in m.suggestions(df, "player", "Kylian Mbape").collect()]
    assert got == difflib.get_close_matches("Kylian Mbape", names, n=5, cutoff=0.5)
    assert m.suggestions(df, "player", "qqqq").count() == 0


def test_manual_entry():
    assert m.entered({"poste": "Gardien", "age": 20})["pos_GK"] == 1 and m.entered({"age": 20})["age_sq"] == 400
    assert m.entered({"taille_cm": 190, "x": 1}) == {"height_in_cm": 190, "x": 1}


def test_one_position_is_not_encoded(spark):
    df = spark.createDataFrame([("ENG", 1, "GK", "UEFA"), (None, 999, "GK", "Inconnu")], "nation string, rank int, pos string, confederation string")
    out = lt.encoded(df)
    assert not [n for n in out.columns if n.startswith("pos")] and [r.est_anglais for r in out.collect()] == [1, 0]


def test_a_table_is_never_lost_while_replaced(spark, tmp_path):
    path = f"{tmp_path}/t"
    spark.range(3).write.parquet(path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # a run that died between the two renames
    files.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()


def test_stack_on_the_transform_chosen(spark, data):
    """The target grows with the logarithm's inverse, so log1p is chosen; on squares the root is, and its stack is better."""
    squares = data.withColumn("y", (F.col("a") * 3 + F.col("b")) ** 2)
    train, test = squares.where("id % 3 > 0"), squares.where("id % 3 = 0")
    stack, found = m.restacked(train, test, "y", ["a", "b"], ["id"], learner, {"ols": learner()}, folds=3)
    rows = found.collect()
    assert stack.transform == "sqrt" and [r.transform for r in rows] == ["sqrt", "log1p"]
    assert rows[0].mae < 0.2 * rows[1].mae and rows[0].n == test.count()
    stack, found = m.restacked(data.where("id % 3 > 0"), data.where("id % 3 = 0"), "y", ["a", "b"], ["id"], learner, {"ols": learner()}, folds=3)
    assert stack.transform == "log1p" and found.count() == 1


def test_stack_of_own_trees_is_saved_too(spark, data, tmp_path):
    from kestrel.plans.growth import DepthwiseTrees

    stack = m.Stack(["a", "b"], "y").fit(data, ["id"], 2, {"ols": learner(), "own": DepthwiseTrees(rounds=2, depth=2, rate=0.7)})
    stack.save(f"{tmp_path}/stack")
    again = m.Stack.load(spark, f"{tmp_path}/stack")
    one, two = ({r.id: r.predicted for r in s.predict(data).collect()} for s in (stack, again))
    assert one == pytest.approx(two)
    assert set(m.boosted_learners()) == {"depthwise", "leafwise", "symmetric"} and set(m.forest_learners(2)) == {"forest", "extra"}


def test_quartiles_and_scaling_are_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.lognormal(size=(1001, 2))
    df = spark.createDataFrame([(float(a), float(b) if i % 7 else None, None, 4.0) for i, (a, b) in enumerate(x)], "a double, b double, none double, same double").repartition(5)
    names = ["a", "b", "none", "same"]
    got = m.quartiles(df, names)
    assert got["a"] == pytest.approx(tuple(np.quantile(x[:, 0], [0.25, 0.5, 0.75])))
    assert got["b"] == pytest.approx(tuple(np.quantile(x[np.arange(1001) % 7 != 0, 1], [0.25, 0.5, 0.75])))
    assert got["none"] == (0.0, 0.0, 0.0) and got["same"] == (4.0, 4.0, 4.0)
    r = m.robust_scaled(m.imputed(df, names, got), names, got, names).agg(F.max("b").alias("b"), F.max("none").alias("none"), F.max("same").alias("same")).first()
    assert (r.none, r.same) == (0.0, 0.0) and r.b == pytest.approx((x[np.arange(1001) % 7 != 0, 1].max() - got["b"][1]) / (got["b"][2] - got["b"][0]))


def test_modes_count_before_they_compare(spark):
    from kestrel.operators.aggregates import modes, profile

    rows = [(10, "b", True, None), (-2, "a", True, None), (10, "a", False, None), (-2, "b", None, None), (3, None, False, None)]
    df = spark.createDataFrame(rows, "n int, s string, `a.b` boolean, none double")
    assert tuple(modes(df, ["n", "s", "a.b", "none"]).first()) == (-2, "a", False, None)
    plan = modes(df, ["n", "s"])._jdf.queryExecution().executedPlan().toString()
    assert "mode(" not in plan and "partial_count" in plan
    assert tuple(profile(df.withColumn("k", F.col("n") + 1), ["n"], ["k"]).first()) == (3.0, -1)
    assert tuple(profile(df.withColumn("k", F.col("n") + 1).limit(0), ["n"], ["k"]).first()) == (0.0, 0)
