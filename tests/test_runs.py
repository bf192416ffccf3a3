"""Running values within hot keys against plain Python, and the plan that spreads them."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kestrel.operators import runs, windows


@pytest.fixture(scope="module")
def rows(spark):
    """One key holds two thirds of the rows and lies over all partitions; values have long gaps; null keys and orders."""
    rnd = random.Random(3)
    out = []
    for i in range(3000):
        key = "hot" if i % 3 else rnd.choice(["a", "b", None])
        out.append((i, key, None if i == 7 else rnd.random(), rnd.random() if rnd.random() < 0.01 else None, float(i % 5)))
    out += [(5000 + i, "unknown", float(i), None, None) for i in range(4)]
    df = spark.createDataFrame(out, "id long, k string, at double, v double, w double").repartition(5)
    by = defaultdict(list)
    for r in sorted(out, key=lambda r: (r[2] is not None, r[2] or 0.0)):
        by[r[1]].append(r)
    return df, by


def test_filled(rows):
    df, by = rows
    got = {r.id: r.v for r in runs.filled(df, ["k"], ["at"], ["v"]).collect()}
    ahead = {r.id: r.v for r in runs.filled(df, ["k"], ["at"], ["v"], both_ways=False).collect()}
    for own in by.values():
        last, known = None, [r[3] for r in own if r[3] is not None]
        for r in own:
            last = r[3] if r[3] is not None else last
            assert ahead[r[0]] == last
            assert got[r[0]] == (last if last is not None else (known or [None])[0])
    assert len(got) == sum(map(len, by.values()))


def test_running_sum_and_lag(rows):
    df, by = rows
    total = {r.id: (r.s, r.n) for r in runs.running_sum(df, ["k"], ["at"], {"s": "w", "n": F.lit(1)}).collect()}
    before = {r.id: (r.p, r.q) for r in runs.lagged(df, ["k"], ["at"], {"p": "id", "q": "v"}).collect()}
    for own in by.values():
        s, last = 0.0, (None, None)
        for k, r in enumerate(own):
            assert total[r[0]] == (s, k) and before[r[0]] == last
            s, last = s + (r[4] or 0.0), (r[0], r[3])


def test_several_keys_orders_and_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "x", 2, 1, None), (1, "x", 2, 2, 5), (1, "y", 1, 1, None), (2, "x", 1, 1, 7)], "`a.b` int, p string, o int, u int, value int")
    got = windows.fill_in_group(df, ["a.b"], ["o", "u"], ["value"])
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(1, "x", 2, 1, 5), (1, "x", 2, 2, 5), (1, "y", 1, 1, 5), (2, "x", 1, 1, 7)]
    assert runs.filled(df.limit(0), ["a.b"], ["o"], ["value"]).count() == 0


def test_no_window_holds_a_whole_key(rows):
    df, _ = rows
    told = windows.fill_in_group(df, ["k"], ["at"], ["v"])
    plan = told._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in plan.splitlines() if "Window [" in line and "FIRST" not in line.upper().split("[")[0]]
    # The windows over rows begin with the partition; that of the parts runs over one row a partition.
    assert over and all("[__p#" in line or "__b0" in line or "__parts" in line for line in over)
    runs_ = runs.Runs(df, ["k"], ["at"])
    sizes = [r["count"] for r in runs_.rows.where("k = 'hot'").groupBy("__p").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1500
    assert runs_.carried({"__l": F.max("v")}, {"__b": F.max("__l")}).count() <= 2 * 4


def test_lag_over_hot_keys_equals_the_window(spark):
    df = spark.createDataFrame([(i % 2, i // 2 + (i > 20), float(i)) for i in range(60)], "k int, period int, value double").repartition(3)
    key = lambda d: sorted(map(str, d.collect()))
    for consecutive in (True, False):
        assert key(windows.lagged(df, ["k"], "period", "value", "p", consecutive, spread=True)) == key(windows.lagged(df, ["k"], "period", "value", "p", consecutive))
    assert key(windows.delta(df, ["k"], "period", "value", "d", spread=True)) == key(windows.delta(df, ["k"], "period", "value", "d"))
