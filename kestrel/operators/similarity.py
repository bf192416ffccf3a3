"""Similarity join of names: an inverted index that loses no pair and compares few.

Scores are the token-sort and token-set ratios, both of an indel alignment: names of
lengths n and m score 200 * LCS / (n + m).  For a score of T, with s = n + m:

* length: |n - m| <= s * (1 - T / 100), so the other name has at least n * T / (200 - T) letters;
* letter pairs: with a space at either end a name of n letters has n + 1 pairs, in any order of
  its tokens the same ones.  A letter taken out destroys two pairs, one put in destroys one,
  and at most s * (1 - T / 100) are taken out or put in, so at least 1 + s * (1.5 * T / 100 - 1)
  pairs are common;
* letters, where that bound says nothing (T up to 66.7): at least s * T / 200 are common;
* tokens: the common tokens alone, c letters long, score 200 * c / (c + m) against the shorter
  name's m letters, so they hold m * T / (200 - T) letters of it.

A name is posted under its rarest pairs (letters, tokens) only: as many as it has more than
must be common, and one (of tokens: until the rest is shorter than must be common).  Two names
that reach T share one of these, so candidates come from an equi-join of postings; a pair is
emitted at the rarest thing both hold, hence once, and only if lengths, letters and the whole
count allow the score.  Names are distinct before they are indexed, postings of a common pair
are rare by construction, and what is left of them AQE can split.

Where only each name's best partner is asked for (:func:`best`), pairs are not listed: many names
may reach a score with many, and a name needs one.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import letter_mask, sorted_tokens
from kestrel.operators.alignment import compared, scored
from kestrel.operators.columns import c
from kestrel.storage import Scratch, materialize, scratch

#: Scores above this make letter pairs a bound.
PAIRS_FROM = 200 / 3
#: Names of a pack on either side at most: a task compares one pack with another.
LEFT, RIGHT, TASKS = 1 << 13, 1 << 15, 10_000
#: Left names are dealt over so many packs if these hold ``FEWEST`` names.
SPREAD, FEWEST = 64, 512
#: Holders of a token up to which a name is scored with all of them, for a score that its best partner reaches.
HOLDERS = 16
#: Rounding of the bounds.
EPS = 1e-6


def distinct_names(df: DataFrame, block: Sequence[str], name: str) -> DataFrame:
    """(block, x, tokens): the distinct names that are not empty."""
    one = df.where((c(name) != "") & c(name).isNotNull()).select(*(c(b) for b in block), c(name).alias("x")).distinct()
    return one.withColumn("tokens", sorted_tokens(F.col("x")))


def _numbered(parts: Column) -> Column:
    """Repeated parts told apart by their number: a, a, b -> a1, a2, b1."""
    ordered = F.array_sort(parts)
    return F.transform(ordered, lambda g, i: F.concat(g, (i + 2 - F.array_position(ordered, g)).cast("string")))


def _sliced(text: Column, size: int) -> Column:
    """All substrings of ``size`` letters."""
    return F.when(F.length(text) >= size, F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def forms(names: DataFrame, of_set: bool, of_sort: bool) -> DataFrame:
    """(block, x, form, n, mask): the texts that alignments compare; a name without repeated tokens has one."""
    texts = [F.array_join(t, " ") for asked, t in ((of_sort, F.col("tokens")), (of_set, F.array_distinct("tokens"))) if asked]
    rows = names.withColumn("form", F.explode(F.array_distinct(F.array(*texts)))).drop("tokens")
    return rows.withColumn("n", F.length("form")).withColumn("mask", letter_mask(F.col("form")))


def _letters(tokens: Column) -> Column:
    """Length of tokens joined by spaces."""
    return F.aggregate(tokens, F.lit(-1), lambda s, t: s + F.length(t) + 1)


def _index(names: DataFrame, of_set: bool, of_sort: bool, size: int) -> DataFrame:
    """(block, x, kind, form, n, mask, grams): the letters or letter pairs of every form, and the tokens if sets count."""
    text = F.concat(F.lit(" "), F.col("form"), F.lit(" ")) if size == 2 else F.col("form")
    rows = forms(names, of_set, of_sort).withColumns({"kind": F.lit("letters"), "grams": _numbered(_sliced(text, size))})
    if not of_set:
        return rows
    tokens = F.array_distinct("tokens")
    sets = names.withColumns({"kind": F.lit("tokens"), "form": F.lit(""), "n": _letters(tokens), "mask": F.lit(0).cast("long"), "grams": tokens})
    return rows.unionByName(sets.drop("tokens"))


def _rarest_first(rows: DataFrame, frequency: DataFrame) -> DataFrame:
    """``rows`` with their grams in the common order: by frequency, then by gram."""
    key = [c(k) for k in rows.columns if k != "grams"]
    told = rows.select(*key, F.explode("grams").alias("gram")).join(frequency, ["kind", "gram"])
    lists = told.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("f", "gram"))).alias("order"))
    return lists.select(*key, F.col("order.gram").alias("grams"))


def candidates(
    left: DataFrame, right: DataFrame, block: Sequence[str], out: Scratch, least_set: float | None = None, least_sort: float | None = None
) -> DataFrame:
    """(block, l, r): all pairs of ``distinct_names`` whose token-set ratio reaches ``least_set`` (above 0) or whose
    token-sort ratio reaches ``least_sort``, each once, and some that reach neither."""
    least = min(t for t in (least_set, least_sort) if t is not None)
    size = 2 if least > PAIRS_FROM else 1

    def common(s: Column) -> Column:
        """How many letters or letter pairs two forms of s letters in all must share."""
        most = s * (1.5 * least / 100 - 1) + 1 if size == 2 else s * (least / 200)
        return F.greatest(F.ceil(most - EPS), F.lit(1))

    sides = [_index(df, least_set is not None, least_sort is not None, size) for df in (left, right)]
    grams = sides[0].select("kind", "grams").unionByName(sides[1].select("kind", "grams")).select("kind", F.explode("grams").alias("gram"))
    frequency = out.write(grams.groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("f")), "frequency")
    # The other form has n * least / (200 - least) letters at least.
    fewest = common(F.col("n") * (200 / (200 - least)))
    rarest = F.slice("grams", F.lit(1), F.greatest(F.size("grams") - fewest + 1, F.lit(1)).cast("int"))
    share = least_set if least_set is not None else 0.0
    rare = F.filter("grams", lambda g, i: _letters(F.slice("grams", i + 1, F.size("grams"))) * (200 - share) >= F.col("n") * share - EPS)

    def posted(rows: DataFrame, label: str, short: str, long: str) -> DataFrame:
        """Rows under each gram of theirs by which they are looked up: rare tokens where they are the shorter name, all where the longer."""
        told = lambda way, of: F.transform(of, lambda g: F.struct(F.lit(way).alias("way"), g.alias("gram")))
        posts = F.when(F.col("kind") == "letters", told("=", rarest)).otherwise(F.concat(told(short, rare), told(long, F.col("grams"))))
        return out.write(_rarest_first(rows, frequency).select("*", F.inline(posts)), label)

    # Written on both sides, so that the postings of a frequent gram can be split.
    a, b = posted(sides[0], "left", "<", ">").alias("a"), posted(sides[1], "right", ">", "<").alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    shared = F.array_intersect("a.grams", "b.grams")
    differ = F.greatest(F.abs(n - m), F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask"))))
    by_letters = (differ * 100.0 <= (n + m) * (100.0 - least) + EPS) & (F.size(shared) >= common(n + m))
    held = _letters(shared)
    by_tokens = F.when(F.col("a.way") == "<", n <= m).otherwise(n > m) & (held * 200.0 + EPS >= (held + F.least(n, m)) * share)
    fits = F.when(F.col("a.way") == "=", by_letters).otherwise(by_tokens)
    same = reduce(Column.__and__, (F.col(f"a.`{k}`") == F.col(f"b.`{k}`") for k in (*block, "way", "gram")))
    first = F.element_at(shared, 1) == F.col("a.gram")
    met = a.join(b, same & fits & first)
    return met.select(*(F.col(f"a.`{k}`").alias(k) for k in block), F.col("a.x").alias("l"), F.col("b.x").alias("r")).distinct()


def _nested(left: DataFrame, right: DataFrame, block: Sequence[str], own: Scratch) -> DataFrame:
    """(block, l, s): of the names whose tokens hold or are held by a right name's, the smallest such name at -100, the best score there is.

    The inner name is looked up under its rarest token alone, the outer one under all of its tokens.
    """
    keys = [c(k) for k in block]
    sides = [df.select(*keys, "x", F.array_distinct("tokens").alias("tokens")).where(F.size("tokens") > 0) for df in (left, right)]
    told = [own.write(df.select(*keys, "x", "tokens", F.explode("tokens").alias("gram")), "tokens") for df in sides]
    held = told[0].select("gram").unionByName(told[1].select("gram"))
    frequency = own.write(held.groupBy("gram").agg(F.count(F.lit(1)).alias("f")), "frequency")
    rarest = [
        own.write(t.join(frequency, "gram").groupBy(*keys, "x", "tokens").agg(F.min(F.struct("f", "gram")).alias("g")).select(*keys, "x", "tokens", F.col("g.gram").alias("gram")), "rarest")
        for t in told
    ]
    out = None
    for a, b in ((rarest[0], told[1]), (told[0], rarest[1])):
        same = reduce(Column.__and__, (F.col(f"a.`{k}`") == F.col(f"b.`{k}`") for k in (*block, "gram")))
        inner, outer = ("a", "b") if a is rarest[0] else ("b", "a")
        nests = F.size(F.array_except(f"{inner}.tokens", f"{outer}.tokens")) == 0
        met = a.alias("a").join(b.alias("b"), same & nests)
        part = met.select(*(F.col(f"a.`{k}`").alias(k) for k in block), F.col("a.x").alias("l"), F.col("b.x").alias("r"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*keys, "l").agg(F.min(F.struct(F.lit(-100.0).alias("s"), "r")).alias("s"))


def _hints(rest: DataFrame, right: DataFrame, block: Sequence[str], least: float, own: Scratch) -> DataFrame:
    """(block, x, hint): the best token-set ratio, from ``least``, among the few right names that hold a name's rarest token."""
    keys = [c(k) for k in block]
    told = [df.select(*keys, "x", F.array_distinct("tokens").alias("tokens"), F.explode(F.array_distinct("tokens")).alias("gram")) for df in (rest, right)]
    few = own.write(told[1].groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("f")).where(F.col("f") <= HOLDERS), "holders")
    rarest = told[0].join(few, [*block, "gram"]).groupBy(*keys, "x", "tokens").agg(F.min(F.struct("f", "gram")).alias("g"))
    rarest = own.write(rarest.select(*keys, "x", "tokens", F.col("g.gram").alias("gram")), "rarest")
    held = told[1].select(*keys, "gram", F.col("tokens").alias("others"))
    met = rarest.join(held, [*block, "gram"]).select(*keys, "x", "tokens", "others")
    kinds = [f"`{k}` {rest.schema[k].dataType.simpleString()}" for k in block]
    scores = met.mapInArrow(partial(scored, block=len(block), least=least), ", ".join([*kinds, "x string", "hint double"]))
    return scores.groupBy(*keys, "x").agg(F.max("hint").alias("hint"))


def _packed(names: DataFrame, block: Sequence[str], size: int, id_: str, as_: str) -> DataFrame:
    """(block, id, names, forms, hints): up to ``size`` names of a block in a row, those of like letters together."""
    keys = [c(k) for k in block]
    # Partitions of several packs: a pack lies within one, and small packs would be compared with many.
    parts = max(1, min(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), names.count() // (4 * size)))
    told = names.select(*keys, F.col("x"), F.array_join("tokens", " ").alias("form"), "hint")
    told = told.repartitionByRange(parts, *keys, F.reverse("form"), "x").sortWithinPartitions(*keys, F.reverse("form"), "x")
    lists = told.withColumn("__p", F.spark_partition_id()).withColumn("__n", F.floor(F.monotonically_increasing_id() % (1 << 33) / size))
    one = F.collect_list(F.struct("x", "form", "hint")).alias("one")
    lists = lists.groupBy(*keys, "__p", "__n").agg(one)
    lists = lists.select(*keys, "__p", "__n", *(F.col(f"one.{k}").alias(f"{as_}_{n}") for k, n in (("x", "names"), ("form", "forms"), ("hint", "hints"))))
    return lists.withColumn(id_, F.concat_ws(" ", "__p", "__n")).drop("__p", "__n")


def best(left: DataFrame, right: DataFrame, block: Sequence[str], least_set: float, least_sort: float | None = None, first: bool = False) -> DataFrame:
    """(block, l, s, t): the best pair (-score, r) of each name ``l`` by token-set ratio from ``least_set`` and by token-sort ratio
    from ``least_sort``, ties to the smaller name; rows with neither are left out.

    The better of the two is exact, and the other one only where it is as good; with ``first`` the token-sort ratio counts
    where no token-set ratio reaches its bound.  Names that nest are joined by a token.  The rest of the names are compared
    in packed rows of a block (:mod:`kestrel.operators.alignment`), every pair of packs a row of its own; a name with a rare
    token comes with the score that it gives, below which no pack looks for more.
    """
    keys = [c(k) for k in block]
    with scratch(left.sparkSession) as own:
        nested, _ = materialize(_nested(left, right, block, own), "nested")
        rest = own.write(left.join(nested.select(*keys, F.col("l").alias("x")), [*block, "x"], "left_anti"), "rest")
        rest = own.write(rest.join(_hints(rest, right, block, least_set, own), [*block, "x"], "left").withColumn("hint", F.coalesce("hint", F.lit(-1.0))), "hinted")
        size = min(LEFT, max(FEWEST, rest.count() // SPREAD))
        a = own.write(_packed(rest, block, size, "__a", "l"), "packs")
        b = own.write(_packed(right.withColumn("hint", F.lit(-1.0)), block, RIGHT, "__b", "r").drop("r_hints"), "packs")
        ids = a.select(*keys, "__a"), b.select(*keys, "__b")
        pairs = ids[0].join(ids[1], list(block)) if block else ids[0].crossJoin(ids[1])  # packs, not names
        pairs = own.write(pairs, "pairs")
        # A pair or a few in a task: packs of names are large rows.
        tasks = max(1, min(pairs.count(), TASKS))
        both = pairs.join(a, [*block, "__a"]).join(b, [*block, "__b"]).repartition(tasks, *keys, "__a", "__b")
        kinds = [f"`{k}` {rest.schema[k].dataType.simpleString()}" for k in block]
        run = partial(compared, block=len(block), least_set=least_set, least_sort=least_sort, first=first)
        told = both.select(*keys, "l_names", "l_forms", "l_hints", "r_names", "r_forms").mapInArrow(
            run, ", ".join([*kinds, "l string", "set double", "set_r string", "sort double", "sort_r string"])
        )
        pick = lambda k: F.min(F.when(F.col(k).isNotNull(), F.struct((-F.col(k)).alias("s"), F.col(f"{k}_r").alias("r"))))
        found, _ = materialize(told.groupBy(*keys, "l").agg(pick("set").alias("s"), pick("sort").alias("t")), "best")
    return nested.select(*keys, "l", "s", F.lit(None).cast(found.schema["t"].dataType).alias("t")).unionByName(found)
