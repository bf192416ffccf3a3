"""Tables that are read again and again are written once; ties but for rounding are ordered by name."""

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from kestrel.plans import modelling as m
from kestrel.plans import tuning


class Watched:
    """A learner that notes what its tables are read from."""

    def __init__(self, files):
        self.files = files

    def fit(self, df):
        self.files.append(df.inputFiles())
        return LinearRegression(labelCol="label", weightCol="weight", solver="normal").fit(df)


def written(files):
    return files and all("/kestrel-" in f for f in files)


@pytest.fixture(scope="module")
def table(spark):
    x = F.pmod(F.xxhash64("id"), F.lit(1000)) / 100.0
    return spark.range(200).select("id", x.alias("x"), (F.exp(x / 3) * 100 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(50))).alias("y"))


def test_trials_read_written_tables(table):
    seen = []
    ready = m.prepare(table, "y", ["x"])
    tuning.tune(lambda p: Watched(seen), {"reg": [0.1, 0.2]}, ready.where("id % 2 = 0"), ready.where("id % 2 = 1"), trials=2)
    assert len(seen) == 2 and all(map(written, seen))


def test_shuffles_read_a_written_table(table):
    seen = []

    def score(df):
        seen.append(df.inputFiles())
        return df.withColumn("predicted", 3 * F.col("x"))

    got = {r.feature: r.importance for r in m.permutation_importance(score, table, ["x", "id"], "y", repeats=1).collect()}
    assert all(map(written, seen)) and got["id"] == pytest.approx(0)


def test_transforms_read_written_tables_and_tie_by_name(table):
    seen = []
    rows = m.best_transform(table.where("id % 2 = 0"), table.where("id % 2 = 1"), "y", ["x"], ["log1p", "log10", "raw", "sqrt"], lambda: Watched(seen)).collect()
    assert len(seen) == 4 and all(map(written, seen))
    place = [r.transform for r in rows]
    # log10 is log1p by a factor: the same predictions but for rounding.
    assert place.index("log1p") == place.index("log10") + 1 and [m_.mae for m_ in rows] == pytest.approx(sorted(m_.mae for m_ in rows))


def test_round_trips_place_the_prices_once(spark, monkeypatch):
    """Both ways of the quantile map read one grid."""
    from kestrel.operators import metrics
    from kestrel.queries import QUERIES

    calls, real = [], metrics.quantiles
    monkeypatch.setattr(metrics, "quantiles", lambda *a, **k: calls.append(a) or real(*a, **k))
    out = QUERIES["target_round_trips"](spark, "/root/testdata/sf0.001")
    assert len(calls) == 1
    assert out.where("min_max <> yeo_johnson OR quantile <> log10 OR min_max <> log10").count() == 0 < out.count()
