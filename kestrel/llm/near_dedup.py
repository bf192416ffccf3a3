"""Near-duplicates by word shingles: Jaccard similarity of at least 0.8 over five words.

Links are exactly the pairs of shingle sets (64-bit hashes) whose Jaccard similarity is
at least ``NUM / DEN``; a class is a connected component of links.

Candidates.  In any fixed order of all shingles, two sets that similar share one of the
first n - ceil(0.8 n) + 1 shingles of each, and at the first shared one, at places i and
j, no more than min(n - i, m - j) can be shared in all.  Of two such beginnings the one
that ends first in the order shows all that is shared up to there, so with k shared
there are at most k + max(ceil(0.8 n), ceil(0.8 m)) - 1.  All conditions are necessary,
so no link is missed.  The order puts shingles often met in a sample of the texts last
(a better or worse sample changes the time, never the result).  Shared sets are
intersected before a pair counts as a link.

Fingerprints first.  Texts whose SimHash fingerprints (of the same five-word shingles)
are within two bits are found by the pigeonring filter of :mod:`simhash` and linked if
their sets are similar; only pairs that these links leave apart go through the beginnings.
Fingerprints alone cannot give right results here: at similarity 0.8 some ten of 64 bits
differ.

Dense blocks.  Groups of near copies crowd a shingle's block, where pairs would be
quadratic.  First each member is compared with one pivot of its block - the member with
the fewest rarer shingles, which stands nearest to all others; after ``STARS`` such
rounds only pairs from different components are left.  Of those the join emits the ones
that a parity bitmap lets through: each shingle flips one of 256 bits, so two sets differ
in at least as many shingles as their bitmaps in bits, and a ninth of both is the most.

Defined results: null and word-less texts have the empty set and are alike; fewer words
than a shingle make one shingle; equal sets are one node, named by a 64-bit digest;
repeated rows and ties (equal ids) are one row per text; a very long text is read whole,
and a task holds its set of shingles; other columns are carried along unread.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kestrel.llm import simhash
from kestrel.llm.components import components
from kestrel.llm.rows import BROADCAST_ROWS, drop_rows, small_batches, text_key
from kestrel.llm.simhash import SEED, shingle_hashes, voted
from kestrel.storage import Scratch, materialize, release, scratch

WORDS = 5
#: Least similarity, as a fraction.
NUM, DEN = 4, 5
#: One text in so many is sampled for the order; shingles of so many sampled texts go last, at most so many shingles.
SAMPLE, OFTEN, LAST = 16, 3, 1 << 20
STARS = 2
BITS = ("b0", "b1", "b2", "b3")


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    parts = list(shingle_hashes(text or b"", width))
    return np.unique(np.concatenate(parts).view(np.int64)) if parts else np.empty(0, np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(a) for a in arrays], dtype=np.int64))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def _digest(s: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))


def sets(texts: DataFrame, width: int) -> DataFrame:
    """node and its shingles for each row of ``texts(__text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.int64()), _lists(found)], names=["node", "s"])

    return texts.select("__text").mapInArrow(run, "node long, s array<long>")


def often(given: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, ascending, of ``OFTEN`` or more sampled texts, and in how many they are; at most ``LAST``."""
    some = given.where(F.pmod(F.xxhash64("__key"), F.lit(SAMPLE)) == 0)
    n = sets(some, width).select(F.explode("s").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    t = n.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(LAST).toArrow()
    h, n = t["h"].to_numpy(), t["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(given: DataFrame, width: int, last: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """__id, __key, node, fp, n (its shingles), bitmap and the first of them in the common order, for every row."""
    hashes = given.sparkSession.sparkContext.broadcast(last)

    def first(s: np.ndarray) -> np.ndarray:
        h, n = hashes.value
        rank = np.zeros(len(s), np.int64)
        if len(h):
            at = np.minimum(np.searchsorted(h, s), len(h) - 1)
            rank = np.where(h[at] == s, n[at], 0)
        return s[np.lexsort((s, rank))][: len(s) - -(-NUM * len(s) // DEN) + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fp, n, head, bits = [], [], [], [], []
            for t in batch.column(2):
                parts = list(shingle_hashes(t.as_py() or b"", width))
                s = np.unique(np.concatenate(parts).view(np.int64)) if parts else np.empty(0, np.int64)
                node.append(_digest(s))
                fp.append(voted(parts))
                n.append(len(s))
                head.append(first(s))
                bits.append(np.packbits(np.bincount(s & 255, minlength=256) & 1).view(np.int64))
            fps = pa.array(np.array(fp, dtype=np.uint64).view(np.int64))
            maps = [pa.array(b) for b in np.array(bits, dtype=np.int64).reshape(-1, 4).T.copy()]
            columns = [batch.column(0), batch.column(1), pa.array(node, pa.int64()), fps, pa.array(n, pa.int32()), *maps, _lists(head)]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "__key", "node", "fp", "n", *BITS, "head"])

    kind = given.schema["__id"].dataType.simpleString()
    return given.mapInArrow(run, f"__id {kind}, __key binary, node long, fp long, n int, {', '.join(f'{b} long' for b in BITS)}, head array<long>")


def _fits(a: str, b: str) -> Column:
    """The sizes of the two sets allow enough similarity."""
    return F.least(f"{a}.n", f"{b}.n") * (NUM + DEN) >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * NUM


def _near(a: str, b: str) -> Column:
    """The bitmaps of the two sets allow enough similarity."""
    differ = F.lit(0)
    for x in BITS:
        differ = differ + F.bit_count(F.col(f"{a}.{x}").bitwiseXOR(F.col(f"{b}.{x}")))
    return differ * (NUM + DEN) <= (F.col(f"{a}.n") + F.col(f"{b}.n")) * (DEN - NUM)


def _pairs(joined: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of ``joined`` - one row for each shingle that both have first - that can be similar enough."""
    na, nb = F.col("a.n"), F.col("b.n")
    most = F.max(F.least(na - F.col("a.pos"), nb - F.col("b.pos")))
    met = joined.groupBy(
        F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"),
        (na + nb).alias("both"), F.greatest(na, nb).alias("larger"),
    ).agg(F.count(F.lit(1)).alias("k"), most.alias("most"))
    rest = F.ceil(F.col("larger") * NUM / DEN) - 1
    enough = F.col("both") * NUM
    return met.where((F.col("most") * (NUM + DEN) >= enough) & ((F.col("k") + rest) * (NUM + DEN) >= enough)).select("a", "b")


def similar(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs (a, b) of ``whole(node, s)`` that are similar enough."""
    one = pairs.join(whole.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    both = one.join(whole.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared * (NUM + DEN) >= (F.size("sa") + F.size("sb")) * NUM).select("a", "b")


def same_prints(rows: DataFrame, out: Scratch) -> DataFrame:
    """Pairs (a, b) that connect the nodes of ``rows(node, fp)`` whose fingerprints are within two bits."""
    nodes = out.write(rows.select("node", "fp").distinct(), "prints")
    least = out.write(nodes.groupBy("fp").agg(F.min("node").alias("least")), "least")
    alike = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    linked = out.write(simhash.links(least.select("fp")), "linked")
    one = linked.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a")
    both = one.join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
    return alike.unionByName(both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()


def links(
    blocks: DataFrame, whole: Callable[[DataFrame], DataFrame], out: Scratch, first: DataFrame | None = None
) -> DataFrame:
    """(node, root) of the components of similar sets.

    ``blocks(h, node, n, pos, bitmap)`` by shared shingle; ``whole`` gives (node, s) of the
    nodes of a table; ``first(a, b)`` are pairs to look at before.
    """
    spark, found, roots, mixed_at = blocks.sparkSession, None, None, None

    def linked(pairs: DataFrame) -> DataFrame:
        """Components after the pairs (a, b) that are similar have been linked as well."""
        nonlocal found
        with scratch(spark) as own:
            pairs = own.write(pairs, "pairs")
            nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            new = out.write(similar(pairs, own.write(whole(nodes), "sets")), "similar")
        found = new if found is None else found.unionByName(new)
        return out.write(components(found), "roots")

    if first is not None:
        roots = linked(first)
    for r in range(STARS + 1):
        if roots is not None:
            with scratch(spark) as own:
                # All are written, so that a crowded block can be split in the joins.
                named = own.write(blocks.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
                mixed = named.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h")
                blocks, at = materialize(named.join(own.write(mixed, "mixed"), "h"), "blocks")
                release(spark, *([mixed_at] if mixed_at else []))
                mixed_at = at
        else:
            blocks = blocks.withColumn("root", F.col("node"))
        if r < STARS:
            pivot = F.min(F.struct("pos", F.xxhash64("node", F.lit(r)), "node", "n", "root", *BITS)).alias("p")
            pivots = out.write(blocks.groupBy("h").agg(pivot).select("h", "p.node", "p.n", "p.root", *(f"p.{b}" for b in BITS)), "pivots")
            apart = F.col("a.root") != F.col("b.root")
            joined = blocks.alias("a").join(pivots.alias("b"), (F.col("a.h") == F.col("b.h")) & apart & _fits("a", "b") & _near("a", "b"))
            pairs = joined.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
        else:
            apart = F.col("a.root") < F.col("b.root")
            joined = blocks.alias("a").join(blocks.alias("b"), (F.col("a.h") == F.col("b.h")) & apart & _fits("a", "b") & _near("a", "b"))
            pairs = _pairs(joined)
        roots = linked(pairs)
    release(spark, *([mixed_at] if mixed_at else []))
    return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """__id, __key and root (the same for all of a class) for every row of ``docs``."""
    small_batches(docs.sparkSession)
    given = docs.select(
        F.col(id_col).alias("__id"),
        text_key(text_col).alias("__key"),
        F.col(text_col).cast("string").cast("binary").alias("__text"),
    )
    with scratch(docs.sparkSession) as out:
        rows = out.write(prefixes(given, width, often(given, width)), "heads")
        with scratch(docs.sparkSession) as own:
            nodes = rows.select("node", "n", "head").dropDuplicates(["node"])
            tokens = own.write(nodes.select("node", "n", F.posexplode("head").alias("pos", "h")), "tokens")
            met = own.write(tokens.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1").select("h"), "met")
            maps = own.write(rows.select("node", *BITS).dropDuplicates(["node"]), "maps")
            blocks = out.write(tokens.join(met, "h").join(maps, "node"), "blocks")

        def whole(some: DataFrame) -> DataFrame:
            keys = out.write(rows.join(some, "node").groupBy("node").agg(F.min("__key").alias("__key")).select("__key"), "keys")
            if keys.count() <= BROADCAST_ROWS:  # then the texts need not move
                keys = F.broadcast(keys)
            return sets(given.join(keys, "__key", "left_semi"), width).dropDuplicates(["node"])

        roots = links(blocks, whole, out, same_prints(rows, out))
        named = rows.join(roots, "node", "left").select("__id", "__key", F.coalesce("root", "node").alias("root"))
        return materialize(named, "classes")[0]


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """Rows of ``docs`` that stay - each class's smallest id - with all columns.

    Rows of a class without any non-null id are one row per text.
    """
    rows = classes(docs, id_col, text_col, width)
    least = rows.where("__id IS NOT NULL").groupBy("root").agg(F.min(F.struct("__id", "__key")).alias("k"))
    nameless = rows.where("__id IS NULL").join(least, "root", "left_anti").select("__id", "__key").distinct()
    kept, _ = materialize(least.select("k.__id", "k.__key").unionByName(nameless), "kept")
    n = rows.join(kept.where("__id IS NOT NULL"), ["__id", "__key"], "left_semi").count()
    on = F.col("d.__id").eqNullSafe(F.col("k.__id")) & (F.col("d.__key") == F.col("k.__key"))
    dropped = rows.alias("d").join(kept.alias("k"), on, "left_anti").select("__id", "__key")
    unique = n == kept.count()
    return drop_rows(docs, kept, dropped, id_col, text_key(text_col), unique=unique)
