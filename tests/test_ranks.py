"""Exact ranks and quantiles against the built-in functions, and their plans."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kestrel.operators import aggregates, impute, ranks, splits


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc") if rnd.random() < 0.9 else None, rnd.choice([None, 1.0, 2.5, rnd.uniform(-5, 5)])) for _ in range(400)]
    rows += [("a", 7.0)] * 300 + [("d", None), ("e", 1.0)]  # a hot key and value, a key without values, one of one value
    return spark.createDataFrame(rows, "k string, x double").withColumn("__v", F.lit("clash")).drop("__v")


@pytest.fixture(params=[ranks.ONE_TASK, 0], autouse=True)
def way(request, monkeypatch):
    """Every test by the window of few counts and by range partitions."""
    monkeypatch.setattr(ranks, "ONE_TASK", request.param)


def test_quantiles(spark, table):
    at = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r["__q"] for r in ranks.quantiles(table, ["k"], "x", at).collect()}
    want = {r.k: r.q for r in table.where("x IS NOT NULL").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, at))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    whole = ranks.quantiles(table, [], "x", at).first()[0]
    assert np.allclose(whole, table.agg(F.percentile("x", F.array(*map(F.lit, at)))).first()[0])
    assert ranks.quantiles(table.limit(0), [], "x", [0.5]).first()[0] == [None]
    assert ranks.quantiles(table.limit(0), ["k"], "x", [0.5]).count() == 0


def test_many_unordered_quantiles_and_medians(spark, table):
    at = [0.9, 0.1, 0.1, *(i / 40 for i in range(41))]
    got = {r.k: r["__q"] for r in ranks.quantiles(table, ["k"], "x", at).collect()}
    want = {r.k: r.q for r in table.where("x IS NOT NULL").groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, at))).alias("q")).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    got = {r.k: r["median"] for r in aggregates.median_by(table, ["k"], "x").collect()}
    assert got == {r.k: r.m for r in table.groupBy("k").agg(F.median("x").alias("m")).collect()} and got["d"] is None


def test_percent_ranks(spark, table):
    rows = table.withColumn("i", F.monotonically_increasing_id())
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    from pyspark.sql import Window

    want = {r.i: r.p for r in rows.withColumn("p", F.percent_rank().over(Window.partitionBy("k").orderBy("x"))).collect()}
    got = {r.i: r.p for r in ranks.percent_ranks(rows, ["k"], "x", "p").collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_no_task_holds_a_column(spark, table, monkeypatch):
    """Beyond few counts, quantiles and ranks use no percentile aggregate, and no window over all rows or over a caller's key."""
    monkeypatch.setattr(ranks, "ONE_TASK", 0)
    for df in (ranks.quantiles(table, [], "x", [0.5]), splits.iqr_limit(table, "x"), aggregates.describe(table, ["x"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan and "median(" not in plan
        assert all("[__p#" in line for line in plan.splitlines() if "Window [" in line)  # by range partition alone


def test_hot_key_look_up_can_be_split(spark):
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.0",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(30_000, numPartitions=8).select(F.when(F.col("id") < 20_000, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").cast("double").alias("x"))
        out = impute.hierarchical(df.withColumn("x", F.when(F.col("k") != 7, F.col("x"))), df, "x", [["k"]])
        assert out.count() == 30_000
        out.collect()
        assert "skew=true" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_medians_with_a_least_count(spark, table):
    got = {r.k for r in impute.learn_medians(table, ["k"], "x", least=2).collect()}
    assert got == {"a", "b", "c"} and pd.notna(impute.learn_medians(table, [], "x").first()[0])
