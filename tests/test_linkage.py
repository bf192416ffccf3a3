"""Fuzzy steps against every pair of names, in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kestrel.functions.text import letter_mask
from kestrel.operators import alignment, linkage, similarity
from kestrel.storage import scratch


def lcs(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def indel(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b))


def sort_ratio(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    s, t = set(a.split()), set(b.split())
    both, x, y = sorted(s & t), sorted(s - t), sorted(t - s)
    if both and (not x or not y):
        return 100.0
    base, p, q = " ".join(both), " ".join(both + x), " ".join(both + y)
    return max([indel(p, q)] + ([indel(base, p), indel(base, q)] if base else []))


@pytest.fixture(scope="module")
def names():
    """Misspelt names: letters lost, doubled or changed at any place, tokens swapped, repeated or added; accents and digits."""
    rnd = random.Random(11)
    heads, tails = ["thiago", "ronaldo", "anna", "josé", "li", "müller", "r2d2"], ["silva", "santos silva", "o", "öz", "van der berg", "aa aa"]
    known = sorted({f"{rnd.choice(heads)} {rnd.choice(tails)}" for _ in range(60)} | {"tiago", "onaldo", "a"})

    def spoil(n: str) -> str:
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(n))
            n = rnd.choice([n[:i] + n[i + 1 :], n[:i] + n[i] + n[i:], n[:i] + rnd.choice("aeéx7") + n[i + 1 :], n + " jr", " ".join(reversed(n.split()))])
            n = " ".join(n.split()) or "z"
        return n

    return sorted({spoil(rnd.choice(known)) for _ in range(70)} | {"qqqq"}), known


def frames(spark, names):
    left = spark.createDataFrame([(i, 1, n) for i, n in enumerate(names[0])], "row_id int, season int, name string")
    right = spark.createDataFrame([(i, 1, n) for i, n in enumerate(names[1])], "tm_id int, season int, name string")
    return left, right


def nearest(score, one, others, least):
    return min(((-score(one, o), o) for o in others if score(one, o) >= least), default=None)


def test_fuzzy_step_against_every_pair(spark, names):
    left, right = frames(spark, names)
    got = {names[0][r.row_id]: (names[1][r.tm_id], pytest.approx(r.score)) for r in linkage.fuzzy_step(left, right, ["season"], "name", "row_id", "m", ["tm_id"]).collect()}
    want = {n: nearest(set_ratio, n, names[1], 85) or nearest(sort_ratio, n, names[1], 75) for n in names[0]}
    assert {n: (b[1], -b[0]) for n, b in want.items() if b} == got
    assert 0 < len(got) < len(names[0])


def found(left, right, *bounds):
    with scratch(left.sparkSession) as out:
        sides = (similarity.distinct_names(df, ["season"], "name") for df in (left, right))
        return Counter((r.l, r.r) for r in similarity.candidates(*sides, ["season"], out, *bounds).collect())


@pytest.mark.parametrize("bounds", [(85, 75), (80, None), (None, 75), (50, 50), (25, 25), (1e-6, 1e-6)])
def test_candidates_lose_no_pair_and_leave_some_out(spark, names, bounds):
    left, right = frames(spark, names)
    got = found(left, right, *bounds)
    of_set, of_sort = (101 if b is None else b for b in bounds)
    want = {(a, b) for a in names[0] for b in names[1] if set_ratio(a, b) >= of_set or sort_ratio(a, b) >= of_sort}
    assert want <= set(got) and set(got.values()) == {1}
    assert len(got) < len(names[0]) * len(names[1])
    assert linkage.block_pairs(left, right, ["season"], "name").count() == len(names[0]) * len(names[1])


def test_candidates_are_few_among_many_names(spark):
    """Of 2,000 x 2,000 names that share frequent tokens and letters, few pairs are compared, and all that matter."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(rnd.randint(2, 4)))
    known = sorted({f"{word()} {rnd.choice(['de', 'van', 'silva', word()])} {word()}" for _ in range(2000)})
    spelt = sorted({n[:k] + n[k + 1 :] for n in known for k in [rnd.randrange(len(n))]})
    right = spark.createDataFrame([(1, n) for n in known], "season int, name string")
    left = spark.createDataFrame([(1, n) for n in spelt], "season int, name string")
    got = found(left, right, 85, 75)
    assert len(got) < len(known) * len(spelt) / 25
    sample = rnd.sample(spelt, 40)
    want = {(a, b) for a in sample for b in known if set_ratio(a, b) >= 85 or sort_ratio(a, b) >= 75}
    assert want <= set(got) and len(want) >= 40


def test_every_join_has_an_equality_on_content(spark, names):
    left, right = frames(spark, names)
    sides = [similarity.distinct_names(df, ["season"], "name") for df in (left, right)]
    with scratch(spark) as out:
        pairs = similarity.candidates(*sides, ["season"], out, 85, 75)
        plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert joins and all("gram" in line or "form" in line or "x#" in line for line in joins)
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_kept_apart(spark):
    left = spark.createDataFrame([(1, "ana silva"), (2, "ana silva")], "season int, name string")
    right = spark.createDataFrame([(1, "ana silvo"), (3, "ana silva")], "season int, name string")
    assert found(left, right, 85, 75) == Counter({("ana silva", "ana silvo"): 1})


def test_nearest_of_all_names(spark, names):
    left, right = (df.select(F.col("name").alias(n)) for df, n in zip(frames(spark, names), "lr", strict=True))
    got = {r.l: (r.r, r.score) for r in linkage.nearest(left, right).collect()}
    for n in names[0]:
        (s, a), (t, b) = nearest(set_ratio, n, names[1], 0), nearest(sort_ratio, n, names[1], 0)
        assert got[n] == ((b, pytest.approx(-t)) if t < s else (a, pytest.approx(-s)))
    assert len(got) == len(names[0])


def test_letter_masks_bound_the_cost(spark, names):
    every = sorted({*names[0], *names[1], "", "ab", "ba", "zzz"})
    mask = {r.x: r.m & (1 << 64) - 1 for r in spark.createDataFrame([(n,) for n in every], "x string").select("x", letter_mask(F.col("x")).alias("m")).collect()}
    assert mask["ab"] == mask["ba"] and mask[""] == 0
    for a in every:
        for b in every:
            assert (mask[a] ^ mask[b]).bit_count() <= len(a) + len(b) - 2 * lcs(a, b)


def test_empty_sides(spark, names):
    left, right = frames(spark, names)
    assert linkage.nearest(left.limit(0).select(F.col("name").alias("l")), right.select(F.col("name").alias("r"))).count() == 0
    assert linkage.nearest(left.select(F.col("name").alias("l")), right.limit(0).select(F.col("name").alias("r"))).count() == 0
    assert linkage.fuzzy_step(left, right.limit(0), ["season"], "name", "row_id", "m", ["tm_id"]).count() == 0


def test_cascade_and_diagnosis_against_plain_python(spark):
    """All four steps and the diagnosis of what they leave, on the misspelt names of the queries."""
    from kestrel.queries.joins import corrupted_names
    from kestrel.queries.registry import Tables

    tables = Tables(spark, "/root/testdata/sf0.001")
    players, mapping, clean = (df.cache() for df in corrupted_names(tables))
    known = clean.where("tm_id % 2 = 0")
    matched, orphans = linkage.cascade(players, mapping, known)
    rows, offered = players.collect(), {r.name_clean: r.tm_id for r in mapping.collect()}
    pool = [(r.season, r.name_clean, r.club_clean, r.tm_id) for r in known.collect()]
    seasonal = {s: {r.name_clean: offered[r.name_clean] for r in rows if r.season == s and r.name_clean in offered} for s in {r.season for r in rows}}
    want = {}
    for r in rows:
        names = seasonal[r.season]
        here = {}
        for s, n, club, i in pool:
            if s == r.season:
                here[n] = min(here.get(n, (i, club)), (i, club))
        own = r.name_clean
        if own in names:
            want[r.row_id] = (names[own], "exact_mapping")
            continue
        best = nearest(set_ratio, own, names, 85) or nearest(sort_ratio, own, names, 75)
        if best:
            want[r.row_id] = (names[best[1]], "fuzzy_mapping")
        elif own in here:
            want[r.row_id] = (here[own][0], "exact_valuation")
        elif best := nearest(lambda a, b: max(set_ratio(a, b), sort_ratio(a, b)), own, here, 50):
            i, club = here[best[1]]
            near = set_ratio(r.club_clean.lower(), club.lower()) if r.club_clean.lower() != club.lower() else 100.0
            if -best[0] >= 95 or (-best[0] >= 75 and near >= 65) or near >= 80:
                want[r.row_id] = (i, "fuzzy_valuation")
    assert {r.row_id: (r.tm_id, r.match_method) for r in matched.collect()} == want
    assert {r.row_id for r in orphans.collect()} == {r.row_id for r in rows} - set(want)
    assert Counter(m for _, m in want.values()).keys() >= {"exact_mapping", "fuzzy_mapping", "fuzzy_valuation"}
    told = linkage.diagnose(orphans, clean, "name_clean", "row_id", "club_clean").collect()
    every = sorted({r.name_clean for r in clean.collect()})
    for r in told:
        (s, a), (t, b) = nearest(set_ratio, r.name_clean, every, 0), nearest(sort_ratio, r.name_clean, every, 0)
        assert (r.nearest, r.score) == ((b, pytest.approx(-t)) if t < s else (a, pytest.approx(-s)))
    assert len(told) == len(rows) - len(want)


def test_best_partner_against_every_pair(spark, names):
    """Packs of few names, and the ratios alone for repeated tokens and for names over 63 letters."""
    left, right = frames(spark, names)
    long = [(900 + k, 1, " ".join([n] * 5) + " x" * k) for k, n in enumerate(["thiago silva santos", "anna van der berg"])]
    left, right = (df.unionByName(spark.createDataFrame(long, df.schema)) for df in (left, right))
    mine, others = ([*side, *(n for _, _, n in long)] for side in names)
    before = similarity.LEFT, similarity.RIGHT
    similarity.LEFT, similarity.RIGHT = 16, 8
    try:
        sides = [similarity.distinct_names(df, ["season"], "name") for df in (left, right)]
        for bounds, first in (((85, 75), True), ((50, 50), False), ((1e-6, 1e-6), False), ((80, None), False)):
            got = {r.l: (r.s, r.t) for r in similarity.best(*sides, ["season"], *bounds, first=first).collect()}
            for n in mine:
                s, t = nearest(set_ratio, n, others, bounds[0]), nearest(sort_ratio, n, others, bounds[1] or 101)
                want = (s or t) if first else min(x for x in (s, t, (0.0, "")) if x is not None)
                own = [tuple(x) for x in got.get(n, ()) if x is not None]
                if first and s:
                    own = [tuple(got[n][0])]
                assert (min(own, default=None) == (pytest.approx(want[0]), want[1])) if want and want[0] < 0 else not own, (n, bounds, own, want)
    finally:
        similarity.LEFT, similarity.RIGHT = before


def test_names_that_nest_are_found_by_a_token(spark):
    """Names that hold one another are found without comparing pairs, whatever else they share."""
    right = spark.createDataFrame([(1, f"red bolt {k:x}") for k in range(40)], "season int, name string")
    left = spark.createDataFrame([(1, f"{k:x} bolt jr red") for k in range(40)], "season int, name string")
    sides = [similarity.distinct_names(df, ["season"], "name") for df in (left, right)]
    got = {r.l: tuple(r.s) for r in similarity._nested(*sides, ["season"], similarity.Scratch(spark)).collect()}
    assert got == {f"{k:x} bolt jr red": (-100.0, f"red bolt {k:x}") for k in range(40)}


def test_partners_in_small_steps_against_every_pair(names, monkeypatch):
    """The walk down the tree in arrays of a few nodes, few names at once, and with bounds that are known before."""
    form = lambda n: " ".join(sorted(n.split()))
    for step, front, walkers in ((4.0, 1 << 19, 1 << 14), (1.0, 16, 5), (30.0, 64, 7)):
        for name, value in (("STEP", step), ("FRONT", front), ("WALKERS", walkers)):
            monkeypatch.setattr(alignment, name, value)
        right = [*names[1], "silva thiago", "thiago silva"]
        for known in (False, True):
            hints = [max(set_ratio(n, o) for o in right) if known else -1.0 for n in names[0]]
            found = {r[0]: r[1:] for r in alignment.partners((names[0], [form(n) for n in names[0]], hints), (right, [form(n) for n in right]), 60, 40, True)}
            for n in names[0]:
                s, t = nearest(set_ratio, n, right, 60), nearest(sort_ratio, n, right, 40)
                got = found.get(n, (None, None, None, None))
                assert (got[1], got[0]) == ((s[1], pytest.approx(-s[0])) if s else (None, None))
                assert s or (got[3], got[2]) == ((t[1], pytest.approx(-t[0])) if t else (None, None))


def test_comparisons_grow_far_slower_than_pairs():
    """Four times the names on both sides are sixteen times the pairs, and some eight times the work; no best partner is lost."""
    seen = []
    for n in (1500, 6000):
        right = [sorted(["bolt", ("red", "old", "hot")[k % 3], f"{k * 7919:x}"]) for k in range(n)]
        left = [sorted(["bolt", ("ed", "ld", "ot")[k % 3], f"{k * 7919:x}"]) for k in range(n)]
        best = alignment.Best(np.full(n, -1.0), 50, 50, False)
        seen.append(alignment._walked(left, right, np.arange(n), np.arange(n), best))
        assert (best.name["set"] == np.arange(n)).all()
    assert seen[1] < 10 * seen[0] and seen[1] < 6000 * 6000 / 4


def test_rare_tokens_give_bounds(spark):
    """The hint of a name is the score of one of the few names that hold its rarest token; frequent tokens give none."""
    right = spark.createDataFrame([(1, f"red bolt {k:x}") for k in range(40)], "season int, name string")
    left = spark.createDataFrame([(1, "ed bolt 1f"), (1, "ed bolt 99"), (2, "ed bolt 1f")], "season int, name string")
    sides = [similarity.distinct_names(df, ["season"], "name") for df in (left, right)]
    with scratch(spark) as own:
        got = {(r.season, r.x): r.hint for r in similarity._hints(*sides, ["season"], 50, own).collect()}
    assert got == {(1, "ed bolt 1f"): pytest.approx(set_ratio("ed bolt 1f", "red bolt 1f"))}
