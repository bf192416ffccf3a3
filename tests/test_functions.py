"""Scalar functions against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from kestrel.functions import numbers, seasons, text
from kestrel.operators.linkage import accept_with_club, club_score


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row[:]
        for j, y in enumerate(b):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_set(a, b):
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, ra, rb = " ".join(sorted(x & y)), sorted(x - y), sorted(y - x)
    if x & y and (not ra or not rb):
        return 100.0
    wa, wb = " ".join([*sorted(x & y), *ra]), " ".join([*sorted(x & y), *rb])
    return max(ratio(wa, wb), *(ratio(common, w) if common else 0.0 for w in (wa, wb)))


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("x")).alias("y")).collect())]


def test_similarity_matches_plain_python(spark):
    rnd = random.Random(3)
    names = [" ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(rnd.randint(0, 3))) for _ in range(40)]
    pairs = [(rnd.choice(names), rnd.choice(names)) for _ in range(60)] + [("", ""), ("ab", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", text.indel_ratio(a, b).alias("r"), text.token_sort_ratio(a, b).alias("so"), text.token_set_ratio(a, b).alias("se")).collect()
    for r in rows:
        assert r.r == pytest.approx(ratio(r.a, r.b))
        assert r.so == pytest.approx(ratio(" ".join(sorted(r.a.split())), " ".join(sorted(r.b.split()))))
        assert r.se == pytest.approx(token_set(r.a, r.b))


def test_names(spark):
    values = ["José-María Callejón", "Mesut Ã\u0096zil", "Šeško", "Højlund  ", "Weiß", "Łukasz", None, ""]
    want = ["jose maria callejon", "mesut ozil", "sesko", "hojlund", "weiss", "lukasz", None, ""]
    assert column(spark, values, text.normalise_name) == want
    assert column(spark, ["Nott'm Forest", "St.-Étienne", "1. FC  Köln"], text.clean_club) == ["nottm forest", "st etienne", "1 fc koln"]
    assert column(spark, ["koln", "x", None], lambda x: text.map_or_self(x, text.CLUB_SYNONYMS)) == ["fc koln", "x", None]


def test_seasons(spark):
    days = ["2020-06-30", "2020-07-01", "2020-08-31", "2020-09-01"]
    assert column(spark, days, lambda x: seasons.season_year(F.to_date(x))) == [2019, 2020, 2020, 2020]
    assert column(spark, days, lambda x: seasons.season_year(F.to_date(x), 9)) == [2019, 2019, 2019, 2020]
    assert column(spark, ["2021", "23/24", "2020/2021", "2021.0", "x", None], seasons.season_from_code) == [2020, 2023, 2020, 2020, None, None]
    assert column(spark, [2021, 2022, None], lambda x: seasons.plays_international_cup(x, F.lit("AFC")), "int") == [1, 1, 0]


def test_numbers(spark):
    assert column(spark, [0.0, 5.0, 5.1, None], lambda x: numbers.band(x, (0, 5, 9), ("a", "b")), "double") == [None, "a", "b", None]
    assert column(spark, [0.0, 2.0, None], lambda x: numbers.ratio(F.lit(1.0), x), "double") == [None, 0.5, None]
    assert column(spark, [0.0, 2.0, None], lambda x: numbers.ratio_or(F.lit(1.0), x, 9.0), "double") == [9.0, 0.5, 9.0]
    assert column(spark, ["24 days", "-", None], numbers.first_int) == [24, None, None]
    assert column(spark, ["23-328", "x1", None], numbers.leading_int) == [23, None, None]
    assert column(spark, [float("nan"), float("inf"), 1.0], numbers.finite, "double") == [None, None, 1.0]


def test_club_rule(spark):
    rows = [(96.0, 0.0), (80.0, 64.0), (80.0, 65.0), (60.0, 79.0), (60.0, 80.0), (49.0, 100.0), (60.0, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s double, c double")
    got = [r[1] for r in sorted(df.select("i", accept_with_club(F.col("s"), F.col("c"))).collect())]
    assert got == [True, False, True, False, True, False, True]
    one = spark.createDataFrame([("psg", "paris saint germain")], "a string, b string")
    assert one.select(club_score(F.col("a"), F.col("b"))).first()[0] >= 90
