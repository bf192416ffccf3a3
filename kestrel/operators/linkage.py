"""Record linkage: an exact-then-fuzzy cascade in which each step sees only what is still unmatched.

Fuzzy steps find the best partner of each distinct name of a block (the season): names that nest
by a join on tokens, the rest by comparing packs of names, each pair of packs in a task's batch
(:mod:`kestrel.operators.similarity`), which loses no match; an aggregation keeps the best.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import CLUB_ALIASES, map_or_self, token_set_ratio
from kestrel.operators import similarity
from kestrel.operators.columns import c
from kestrel.operators.similarity import distinct_names
from kestrel.storage import materialize, scratch


def block_pairs(left: DataFrame, right: DataFrame, block: Sequence[str], name: str) -> DataFrame:
    """(block, l, r): all pairs of distinct names of a block."""
    a, b = distinct_names(left, block, name), distinct_names(right, block, name)
    sides = (df.select(*(c(k) for k in block), F.col("x").alias(side)) for df, side in ((a, "l"), (b, "r")))
    return next(sides).join(next(sides), list(block))


def exact_step(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, method: str, take: Sequence[str]) -> DataFrame:
    """Matches by equal keys; of several right rows the smallest ``take`` wins."""
    one = right.groupBy(*(c(k) for k in keys)).agg(F.min(F.struct(*(c(t) for t in take))).alias("__t"))
    return left.join(one, list(keys)).select(
        c(row), *(F.col("__t").getField(t).alias(t) for t in take), F.lit(method).alias("match_method"), F.lit(100.0).alias("score")
    )


def fuzzy_step(
    left: DataFrame, right: DataFrame, block: Sequence[str], name: str, row: str, method: str, take: Sequence[str],
    score_min: float = 90, sort_min: float = 75,
) -> DataFrame:
    """Token-set ratio of at least ``score_min`` - 5, else token-sort ratio of at least ``sort_min``."""
    with scratch(left.sparkSession) as own:
        a, b = (own.write(distinct_names(df, block, name), "names") for df in (left, right))
        found = similarity.best(a, b, block, score_min - 5, sort_min, first=True).withColumn("b", F.coalesce("s", "t"))
    found = found.select(*(c(b) for b in block), "l", F.col("b.r").alias("r"), (-F.col("b.s")).alias("score"))
    one = right.groupBy(*(c(b) for b in block), c(name).alias("r")).agg(F.min(F.struct(*(c(t) for t in take))).alias("__t"))
    named = found.join(one, [*block, "r"]).withColumnRenamed("l", name)
    return left.join(named, [*block, name]).select(
        c(row), *(F.col("__t").getField(t).alias(t) for t in take), F.lit(method).alias("match_method"), "score"
    )


def club_score(a: Column, b: Column, aliases: dict[str, str] = CLUB_ALIASES) -> Column:
    """Token-set ratio of two clean club names; known aliases score at least 90."""
    score = token_set_ratio(a, b)
    same = (map_or_self(a, aliases) == b) | (map_or_self(b, aliases) == a)
    return F.when(F.coalesce(same, F.lit(False)), F.greatest(score, F.lit(90.0))).otherwise(score)


def accept_with_club(name_score: Column, club: Column) -> Column:
    """From 95 by name alone; from 75 with a club score of 65; from 50 with one of 80; no club: accepted from 50."""
    return (name_score >= 50) & (
        (name_score >= 95) | club.isNull() | ((name_score >= 75) & (club >= 65)) | ((name_score < 75) & (club >= 80))
    )


def fuzzy_club_step(
    left: DataFrame, right: DataFrame, block: Sequence[str], name: str, club: str, row: str, method: str,
    take: Sequence[str],
) -> DataFrame:
    """Best name by the better of set and sort ratio, accepted by the club rule."""
    with scratch(left.sparkSession) as own:
        a, b = (own.write(distinct_names(df, block, name), "names") for df in (left, right))
        found = similarity.best(a, b, block, 50, 50).withColumn("b", F.least("s", "t"))
    found = found.select(*(c(k) for k in block), "l", F.col("b.r").alias("r"), (-F.col("b.s")).alias("score"))
    one = right.groupBy(*(c(b) for b in block), c(name).alias("r")).agg(
        F.min(F.struct(*(c(t) for t in take), c(club).alias("__club"))).alias("__t")
    )
    named = found.join(one, [*block, "r"]).withColumnRenamed("l", name)
    both = left.join(named, [*block, name]).withColumn("__own", c(club))
    return both.where(accept_with_club(F.col("score"), club_score(F.col("__own"), F.col("__t.__club")))).select(
        c(row), *(F.col("__t").getField(t).alias(t) for t in take), F.lit(method).alias("match_method"), "score"
    )


def remaining(left: DataFrame, matched: DataFrame, row: str) -> DataFrame:
    return left.join(matched.select(c(row)), row, "left_anti")


def cascade(
    players: DataFrame, mapping: DataFrame, valuations: DataFrame, row: str = "row_id", season: str = "season",
    name: str = "name_clean", club: str = "club_clean", ident: str = "tm_id", score_min: float = 90,
) -> tuple[DataFrame, DataFrame]:
    """(matches, orphans): exact mapping, fuzzy mapping, exact valuations, fuzzy valuations checked by club.

    ``players(row, season, name, club)``; ``mapping(name, ident)``; ``valuations(season, name, club, ident)``.
    The mapping only offers names that occur among the players of that season.  Each
    step's matches are written, so later steps read them instead of computing them again;
    a step's names are prepared when it is reached, and none is once every player is matched.
    """
    # Written once: later steps read names that were normalised once.
    players, _ = materialize(players, "players")

    @cache
    def seasonal() -> DataFrame:
        return materialize(players.select(c(season), c(name)).distinct().join(mapping, name), "seasonal")[0]

    @cache
    def pool() -> DataFrame:
        return materialize(valuations.select(c(season), c(name), c(club), c(ident)), "pool")[0]

    left, out = players, None
    steps = (
        # A player's own name is offered in each of their seasons, so it is looked up by name alone.
        lambda rest: exact_step(rest.where(c(season).isNotNull()), mapping, [name], row, "exact_mapping", [ident]),
        lambda rest: fuzzy_step(rest, seasonal(), [season], name, row, "fuzzy_mapping", [ident], score_min),
        lambda rest: exact_step(rest, pool(), [season, name], row, "exact_valuation", [ident]),
        lambda rest: fuzzy_club_step(rest, pool(), [season], name, club, row, "fuzzy_valuation", [ident]),
    )
    for k, step in enumerate(steps):
        found, _ = materialize(step(left), f"match{k}")
        out = found if out is None else out.unionByName(found)
        left, _ = materialize(remaining(left, found, row), f"left{k}")
        if left.isEmpty():  # nobody is left to look for
            break
    return out, left


# Reasons for a rejection.
CLUB_TOO_WEAK, NAME_TOO_WEAK = "Score nom OK mais club trop faible", "Score nom trop faible"
TO_VERIFY, NO_CANDIDATE = "Score nom + club OK — à vérifier manuellement", "Aucun résultat fuzzy"


def nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r, score): the best of ``right``'s names ``r`` for each of ``left``'s names ``l``.

    By token-set ratio, or by token-sort ratio if that one scores higher; ties to the smaller name.
    A name that shares no letter with any scores 0 with all, so the smallest name is its nearest.
    """

    a, b = (materialize(distinct_names(df, [], n), "names")[0] for df, n in ((left, "l"), (right, "r")))
    # The smaller first field is the higher score; of equal ones the token-set ratio's name stays.
    chosen = F.when(F.col("s").isNull() | (F.col("t.s") < F.col("s.s")), F.col("t")).otherwise(F.col("s"))
    found = similarity.best(a, b, [], 1e-6, 1e-6).withColumn("b", chosen).select("l", F.col("b.r").alias("r"), (-F.col("b.s")).alias("score"))
    rest = a.select(F.col("x").alias("l")).join(found.select("l"), "l", "left_anti")
    smallest = b.agg(F.min("x").alias("r")).where("r IS NOT NULL")  # one row
    return found.unionByName(rest.join(F.broadcast(smallest)).select("l", "r", F.lit(0.0).alias("score")))


def diagnose(orphans: DataFrame, names: DataFrame, name: str, row: str, club: str | None = None) -> DataFrame:
    """Nearest known name of each orphan over all seasons, its name and club scores, and why it was not taken.

    Distinct orphan names are looked up among the distinct names, which no block narrows.
    """
    known = names.where((c(name) != "") & c(name).isNotNull())
    near = nearest(orphans.select(c(name).alias("l")), names.select(c(name).alias("r")))
    near = near.select(F.col("l").alias(name), F.col("r").alias("nearest"), "score")
    out = orphans.join(near, name, "left")
    if club is None:
        out = out.withColumn("club_score", F.lit(0.0))
    else:
        of = known.groupBy(c(name).alias("nearest")).agg(F.min(c(club)).alias("__of"))
        out = out.join(of, "nearest", "left").withColumn("club_score", F.coalesce(token_set_ratio(c(club), F.col("__of")), F.lit(0.0)))
    weak_club = (F.col("score") < 90) & (F.col("club_score") < 70)
    reason = (
        F.when(F.col("score").isNull(), NO_CANDIDATE).when(weak_club, CLUB_TOO_WEAK).when(F.col("score") < 50, NAME_TOO_WEAK).otherwise(TO_VERIFY)
    )
    return out.select(c(row), c(name), "nearest", "score", "club_score", reason.alias("reason"))


def reason_shares(diagnosed: DataFrame, digits: int = 2) -> DataFrame:
    """(reason, n, pct): how the orphans' reasons are distributed."""
    counts = diagnosed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n").alias("__all"))
    return counts.join(F.broadcast(whole)).select("reason", "n", F.round(F.col("n") * 100.0 / F.col("__all"), digits).alias("pct"))  # one row


def fuzzy_dimension(df: DataFrame, dim: DataFrame, block: Sequence[str], name: str, take: Sequence[str], least: float = 80) -> DataFrame:
    """Left join on (block, name); rows without an exact partner take the best similar name's values.

    Partners are looked up for the distinct names; the rows of ``df`` are joined once, with what was found.
    """
    keys = [*block, name]
    spark = df.sparkSession
    with scratch(spark) as own:
        # Written: what a dimension's names are cleaned from is read once, not for each of the steps below.
        exact = own.write(dim.select(*(c(k) for k in keys), *(c(t) for t in take)).dropDuplicates(keys), "dimension")
        asked = own.write(df.select(*(c(k) for k in keys)).distinct(), "asked")
        hit = asked.join(exact, keys)
        missed = own.write(distinct_names(asked.join(exact, keys, "left_anti"), block, name), "names")
        if not missed.isEmpty():
            best = similarity.best(missed, own.write(distinct_names(exact, block, name), "names"), block, least)
            best = best.select(*(c(b) for b in block), F.col("l"), F.col("s.r").alias(name))
            hit = hit.unionByName(best.join(exact, keys).drop(name).withColumnRenamed("l", name))
        found, _ = materialize(hit, "partners")
    return df.join(found, keys, "left")
