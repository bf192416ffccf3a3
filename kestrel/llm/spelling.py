r"""Spelling variants: words one edit apart, found by merging the subtrees of an errata trie.

The trie of all words has a node for each prefix; the end of a word is an edge of its own
(``END``).  The heavy path of a node goes on to the child with most words beneath; its
other children are light.  Merging is small-to-large: only the words of a light subtree
move, so a word moves once for each light edge on its path, log2(words) times at most.

Two words part at their longest common prefix v, into different children of v, of which
one at least is light.  A word x of a light child, x = v c s, is merged with the rest

* under another light child, one character replaced: both terminals are v * s;
* under the heavy child h, one character replaced: the terminal v h s is a word;
* with its own character skipped: the terminal v s is a word (and s does not begin with
  c, else the two part further down);
* with the heavy child's character skipped: the terminal v h c s is a word.

Coinciding terminals are exactly the pairs at one inserted, deleted or replaced code
point, and each pair is found at one node and in one way.

As Spark jobs: prefixes are told apart by 128-bit digests (all prefixes of a word in one
pass, so a very long word costs its length), sizes and heavy children are aggregations
with map-side combining, and only nodes that branch are joined with the words that pass
them.  The root and short prefixes hold most words: both sides of those joins are written
tables, whose crowded keys AQE splits.  Terminals meet by equi-joins of strings; words that
share a light terminal v * s differ in one character of the alphabet, so that group is
bounded by it (118 letters here), and every pair of it is a result.

Defined results: a null text has no words; a null id counts as the empty string in the
digest that deletes a code point; rows of one id are separate rows, whose equal runs are all
changed alike; an empty table has no words; ties take the smallest word in code-point
order; a very long text is one row's array of runs; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.rolling import BASES, runs
from kestrel.storage import Scratch, materialize, scratch

#: Letters of a word.
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of so many runs one loses a code point; shorter and rarer words are no words.
DAMAGED, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: A form is so many times as frequent as the word.
MORE = 2
#: The edge that ends a word, below every letter.
END = ""


def folded(run: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    ascii_only = F.octet_length(run) == F.length(run)
    return F.when(ascii_only, F.lower(run)).otherwise(F.translate(run, UPPER, LOWER))


def damaged(run: Column, id_col: Column) -> Column:
    """``run`` without one code point where its digest says so."""
    h = F.crc32(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(DAMAGED)) == 0, cut).otherwise(run)


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the words of all texts that are long and frequent enough."""
    runs_of = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(RUN), F.lit(0))
    each = docs.select(F.col(id_col).alias("__id"), F.explode(runs_of).alias("run"))
    words = each.select("__id", folded(F.col("run")).alias("run")).select(damaged(F.col("run"), F.col("__id")).alias("word"))
    n = words.where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= LEAST_COUNT)


def edges(words: DataFrame) -> DataFrame:
    """(id, depth, x, y, c) for every edge of the path of each of ``words(id, word)``: it leaves the node (x, y) by letter c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            whole = "".join(texts)
            codes = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
            letters = np.array([*whole, END], dtype=object)
            first = np.cumsum(lengths) - lengths
            depth = np.concatenate([np.arange(n + 1) for n in lengths])
            start = np.repeat(first, lengths + 1)
            x, y = (runs(codes, start, start + depth, base).view(np.int64) for base in BASES)
            last = depth == np.repeat(lengths, lengths + 1)
            letter = letters[np.where(last, -1, start + depth)]
            ids = np.repeat(batch.column(0).to_numpy(), lengths + 1)
            columns = [pa.array(ids), pa.array(depth.astype(np.int32)), pa.array(x), pa.array(y), pa.array(letter, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "depth", "x", "y", "c"])

    return words.select("id", "word").mapInArrow(run, "id long, depth int, x long, y long, c string")


def light(paths: DataFrame, out: Scratch) -> DataFrame:
    """(id, depth, c, heavy): the light edges of ``paths``, with the letter of their node's heavy child."""
    sizes = paths.groupBy("x", "y", "c").agg(F.count(F.lit(1)).alias("size"))
    # Of equal children the one of the largest letter is heavy, so the end of a word is heavy only where it is alone.
    most = F.max_by("c", F.struct("size", "c")).alias("heavy")
    branching = sizes.groupBy("x", "y").agg(most, F.count(F.lit(1)).alias("children")).where("children > 1")
    branching = out.write(branching.select("x", "y", "heavy"), "branching")
    return paths.join(branching, ["x", "y"]).where("c <> heavy").select("id", "depth", "c", "heavy")


def pairs(words: DataFrame, out: Scratch) -> DataFrame:
    """(a, b): every pair of ``words(id, word)`` at one edit, once, by their ids."""
    paths = out.write(edges(words), "paths")
    moved = out.write(light(paths, out), "light")
    moved = out.write(moved.join(words, "id"), "moved")
    before = F.substring("word", F.lit(1), F.col("depth"))
    rest = F.substring("word", F.col("depth") + 2, F.length("word"))
    heavy, inner, under = F.col("heavy"), F.col("c") != END, F.col("heavy") != END
    parts_here = ~F.startswith(rest, F.col("c"))
    terminals = F.array_compact(
        F.array(
            F.when(inner & under, F.concat(before, heavy, rest)),
            F.when(inner & parts_here, F.concat(before, rest)),
            F.when(under, F.concat(before, heavy, F.substring("word", F.col("depth") + 1, F.length("word")))),
        )
    )
    probes = out.write(moved.select("id", F.explode(terminals).alias("word")), "terminals")
    met = probes.join(words.withColumnRenamed("id", "b"), "word").select(F.col("id").alias("a"), "b")
    replaced = out.write(moved.where(inner).select("id", F.concat(before, F.lit("*"), rest).alias("word")), "replaced")
    same = (F.col("a.word") == F.col("b.word")) & (F.col("a.id") < F.col("b.id"))
    siblings = replaced.alias("a").join(replaced.alias("b"), same).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))
    return met.unionByName(siblings)


def followed(forms: DataFrame, out: Scratch) -> DataFrame:
    """(id, root) of the words of ``forms(id, form)`` that have a form: where following forms ends.

    A form is more frequent than its word, so there is no cycle; every round halves the way.
    """
    chain = out.write(forms.where("form IS NOT NULL").select("id", F.col("form").alias("root")), "forms")
    while True:
        on = chain.select(F.col("id").alias("root"), F.col("root").alias("next"))
        joined = out.write(chain.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("more")), "roots")
        chain = joined.select("id", "root")
        if joined.where("more").isEmpty():
            return chain


def group(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``words(word, n)``, distinct words."""
    with scratch(words.sparkSession) as out:
        # Written, so that the ids stay.
        table = out.write(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
        found = out.write(pairs(table.select("id", "word"), out), "near")
        both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
        names = table.select(F.col("id").alias("b"), F.col("word").alias("other"), F.col("n").alias("other_n"))
        sided = out.write(both.join(names, "b"), "sided")
        # Largest n, then smallest word, by aggregates that combine before the shuffle.
        near = sided.groupBy(F.col("a").alias("id")).agg(
            F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("least"), "other", "b")).alias("best")
        )
        enough = -F.col("best.least") >= MORE * F.col("n")
        known = table.join(near, "id", "left").select(
            "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            *(F.when(enough, value).alias(name) for name, value in (("form_id", F.col("best.b")), ("form", F.col("best.other")), ("form_n", -F.col("best.least")))),
        )
        known = out.write(known, "known")
        roots = out.write(followed(known.select("id", F.col("form_id").alias("form")), out), "followed")
        last = table.select(F.col("id").alias("root_id"), F.col("word").alias("root"))
        named = out.write(roots.withColumnRenamed("root", "root_id").join(last, "root_id").select("id", "root"), "named")
        result = known.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
        return materialize(result, "spellings")[0]


def report(docs: DataFrame) -> DataFrame:
    """One row for each word of the texts: its form, root, count, near words and the form's count."""
    with scratch(docs.sparkSession) as out:
        return group(out.write(counted(docs), "counted"))
