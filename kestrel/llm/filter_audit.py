"""Filter interaction audit: every order of the quality filters replayed over every document.

A document fails each filter or not, whatever ran before; an order decides which of its
failures removes it.  So the texts are read once, into one bit a filter, and the flags
are crossed with the broadcast table of orders (n! rows for n filters: 120 for five).
Each pair of document and order has its first failure; its steps are exploded and counted
by (part, order, step) with conditional aggregates, combined on the map side, so a part
with most of the documents costs no more than any other.

Filters are failure conditions on the text, in ``FILTERS``; the last letter of an audit is
the one table-wide filter: the text stands in a row of smaller id as well.

Defined results: a null text is empty; an empty text has no words (few words, no
repetition, no letters); a null part is the empty string; a row of null id repeats
nothing, and repeated rows (equal id) do not repeat each other; a document with several
label rows has a label if one of them gives it, without any none; an empty table has no
parts, hence no rows; very long texts are read whole, by one row's word array; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.llm.rows import WORD
from kestrel.storage import Scratch, materialize, scratch

#: Fewest words, least percentage of distinct words, highest percentage of capital letters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
SYMBOLS = r"[#$%&*|]"
#: Name of the table-wide filter.
REPEATED = "E"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def few_words(text: Column, words: Column) -> Column:
    return F.size(words) < LEAST_WORDS


def repetitive(text: Column, words: Column) -> Column:
    distinct = F.size(F.array_distinct(words)).cast("long")
    return 100 * distinct < LEAST_DISTINCT * F.size(words).cast("long")


def shouting(text: Column, words: Column) -> Column:
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return 100 * capitals > MOST_CAPITALS * F.length(text).cast("long")


def symbols(text: Column, words: Column) -> Column:
    return text.rlike(SYMBOLS)


#: Failure conditions of a text and its words, by letter.
FILTERS: dict[str, Callable[[Column, Column], Column]] = {"A": few_words, "B": repetitive, "C": shouting, "D": symbols}


def flags(
    docs: DataFrame,
    out: Scratch,
    filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """__id, part and fails (bit k: the k-th filter fails; the last bit: a repeated text) for every row."""
    given = docs.select(
        F.col(id_col).alias("__id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    split = given.withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    bits = F.lit(0)
    for k, fails in enumerate(filters.values()):
        bits = bits + F.when(fails(F.col("text"), F.col("words")), 1 << k).otherwise(0)
    # Both sides of the join are written: the rows of a text that many share can be split.
    own = out.write(split.select("__id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("own")), "flags")
    first = out.write(own.groupBy("digest").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "first")
    again = F.when(F.col("__id") > F.col("first"), 1 << len(filters)).otherwise(0)
    return own.join(first, "digest", "left").select("__id", "part", (F.col("own") + again).alias("fails"))


def labelled(flagged: DataFrame, labels: DataFrame, out: Scratch, id_col: str = "doc_id") -> DataFrame:
    """``flagged`` with good and toxic (never null) of ``labels(doc_id, quality, toxic)``."""
    by_id = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    known = out.write(flagged, "repeats").join(out.write(by_id, "labels"), "__id", "left")
    return known.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})


def orders(spark: SparkSession, letters: str) -> DataFrame:
    """at, filter_order and the bit of each step (s1, s2, ...) for every order of ``letters``."""
    rows = [(at, "".join(p), *(1 << letters.index(x) for x in p)) for at, p in enumerate(permutations(letters))]
    steps = ", ".join(f"s{k + 1} int" for k in range(len(letters)))
    return spark.createDataFrame(rows, f"at int, filter_order string, {steps}")


def replay(flagged: DataFrame, letters: str) -> DataFrame:
    """The counts of ``flagged(part, fails, good, toxic)`` for every part, order of ``letters`` and step."""
    every = orders(flagged.sparkSession, letters)
    bits = [F.col(f"s{k + 1}") for k in range(len(letters))]
    first = F.lit(len(bits) + 1)
    for k, bit in reversed(list(enumerate(bits))):
        first = F.when(F.col("fails").bitwiseAND(bit) != 0, k + 1).otherwise(first)
    crossed = flagged.crossJoin(F.broadcast(every.drop("filter_order")))
    steps = crossed.select(
        "part", "at", "fails", "good", "toxic", first.alias("first"), F.posexplode(F.array(*bits)).alias("k", "bit")
    )
    failing, step = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("k") + 1
    removed = F.col("first") == step
    counts = steps.groupBy("part", "at", "k").agg(
        F.count_if(F.col("first") > step).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(failing & (F.col("first") < step)).alias("redundant"),
        F.count_if(failing & (F.bit_count("fails") == 1)).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    named = counts.join(F.broadcast(every.select("at", "filter_order")), "at")
    return named.select("part", "filter_order", (F.col("k") + 1).alias("step"), *COUNTS)


def audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, Callable[[Column, Column], Column]] = FILTERS,
    repeated: str = REPEATED,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """part, filter_order, step, the counts, and shapley: the step's filter's removals over all orders."""
    letters = "".join(filters) + repeated
    with scratch(docs.sparkSession) as out:
        flagged = labelled(flags(docs, out, filters, id_col, text_col, part_col), labels, out, id_col)
        counts, _ = materialize(replay(flagged, letters), "audit")
    # A filter has one step in an order, so a window holds n! rows.
    same = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return counts.withColumn("shapley", F.sum("removed").over(same))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``documents``, one row per lang, order and step."""
    return audit(docs, labels)
