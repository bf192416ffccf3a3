"""MinHash near-duplicates with sequential Bayesian verification.

A text's set holds its distinct four-word shingles (64-bit hashes).  Two texts are linked
if the Jaccard similarity of their sets is at least ``NUM / DEN``; a class is a connected
component of links.

Candidates.  ``HASHES`` minima of a set, 16 bits each, make its signature; ``BAND`` of them
in a row make a band, and sets that agree in a band are candidates.  A pair at 0.8 meets
in none of the 32 bands with probability (1 - 0.8 ** 4) ** 32 = 5e-8.

Verification.  The signatures of a candidate pair are compared in batches.  After n minima
of which m agree, the similarity has (with a uniform prior) the posterior Beta(m + 1,
n - m + 1), whose mass at or above 0.8 is the chance that a binomial of n + 1 draws at 0.8
is at most m.  Where that mass is below ``MISS`` the pair is pruned; survivors of all
batches are compared by their full sets, so no pair is linked wrongly.  The chance that a
link is lost is below 2e-7 at similarity 0.8 and falls quickly above it.

Crowded bands.  Near copies crowd a band's bucket, where pairs would be quadratic.  First
each member is compared with one pivot - the set that meets most others - then with a
second one; what is connected by then need not be compared again, and only pairs of
different components are left.  The join emits those whose sizes and parity bitmaps (see
:mod:`near_dedup`; both are necessary conditions) allow a link.  The last join, of all pairs
that are left, also compares the signatures, eight bits of each minimum, bit-parallel: it
emits no pair that the batches are sure to prune, and each at one of its common bands only.

Defined results: fewer words than a shingle make one shingle; null, empty and word-less
texts have the empty set and are linked with nothing, repeated rows of one id included;
equal sets are one node, named by a 128-bit digest, so exact copies of any number cost one
row each; null ids take part, and a class's id is its smallest non-null id (null if it has
none); a very long text is read whole, a task holds its set of hashes; other columns are
not read, and those of ``docs`` with the names used here do not clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from kestrel.llm.components import components
from kestrel.llm.near_dedup import BITS, DEN, NUM, _fits, _lists, _near, shingles, similar
from kestrel.llm.rows import BROADCAST_ROWS, drop_rows, small_batches, text_key
from kestrel.storage import Scratch, materialize, scratch

WORDS = 4
#: Minima of a signature, those of a band, and those compared at once.
HASHES, BAND, BATCH = 128, 4, 16
#: Posterior chance of a link below which a pair is pruned.
MISS = 1e-8
#: Rounds of comparison with one pivot a bucket.
STARS = 2
#: Bits of each minimum that the last join compares, and the words that hold one bit of all minima.
PLANES, HALVES = 8, HASHES // 64
#: Shingles hashed at once, so that a very long text needs bounded memory.
CHUNK = 1 << 12


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    """A mask and an odd multiplier for each hash function."""
    x = np.random.Generator(np.random.PCG64(42)).integers(0, 1 << 32, (2, HASHES, 1), dtype=np.uint32)
    return x[0], x[1] | np.uint32(1)


MASKS, FACTORS = _parameters()


def signature(s: np.ndarray) -> np.ndarray:
    """16 bits of each minimum of the hashed set ``s`` (64-bit hashes)."""
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    x = (s.view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), CHUNK):
        low = np.minimum(low, ((x[at : at + CHUNK] ^ MASKS) * FACTORS).min(axis=1))
    return (low ^ (low >> np.uint32(16))).astype(np.uint16)


def least_matches(n: int) -> int:
    """Fewest agreeing minima of ``n`` that leave a link a posterior chance of ``MISS`` or more."""
    t, mass = NUM / DEN, 0.0
    for m in range(n + 1):
        mass += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if mass >= MISS:
            return m
    return n


def signed(given: DataFrame, width: int) -> DataFrame:
    """__id, __key, node, n (shingles), parity bitmap and signature of every row of ``given(__id, __key, __text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, sig, bits = [], [], [], []
            for t in batch.column(2):
                s = shingles(t.as_py(), width)
                node.append(xxh3_128_digest(s.tobytes()))
                n.append(len(s))
                sig.append(signature(s).tobytes())
                bits.append(np.packbits(np.bincount(s & 255, minlength=256) & 1).view(np.int64))
            maps = [pa.array(b) for b in np.array(bits, dtype=np.int64).reshape(-1, len(BITS)).T.copy()]
            columns = [batch.column(0), batch.column(1), pa.array(node, pa.binary()), pa.array(n, pa.int64()), *maps, pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["__id", "__key", "node", "n", *BITS, "sig"])

    kind = given.schema["__id"].dataType.simpleString()
    return given.mapInArrow(run, f"__id {kind}, __key binary, node binary, n long, {', '.join(f'{b} long' for b in BITS)}, sig binary")


def gathered(nodes: DataFrame, out: Scratch) -> tuple[DataFrame, DataFrame]:
    """(h, node, n, f, weight, bitmap): each band value that f > 1 nodes share; a node's weight is the sum of its f.

    And those nodes with their signatures: the others, most of clean texts, are compared with nobody.
    """
    size = 2 * BAND
    bands = [F.xxhash64(F.lit(k), F.substring("sig", size * k + 1, size)) for k in range(HASHES // BAND)]
    with scratch(nodes.sparkSession) as own:
        # Tables are written before each join, so that a crowded band value can be split.
        keys = own.write(nodes.select("node", F.explode(F.array(*bands)).alias("h")), "bands")
        met = own.write(keys.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1"), "met")
        shared = own.write(keys.join(met, "h"), "shared")
        weights = shared.groupBy("node").agg(F.sum("f").alias("weight"))
        about = out.write(weights.join(nodes.select("node", "n", *BITS, "sig"), "node"), "about")
        return out.write(shared.join(about.drop("sig"), "node"), "buckets"), about.select("node", "sig")


def buckets(nodes: DataFrame, out: Scratch) -> DataFrame:
    """The first table of :func:`gathered`."""
    return gathered(nodes, out)[0]


def plausible(pairs: DataFrame, nodes: DataFrame, out: Scratch) -> DataFrame:
    """The pairs (a, b) whose signatures in the written table ``nodes``, compared batch by batch, leave a link some chance."""
    steps = [(at, least_matches(at + BATCH)) for at in range(0, HASHES, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), dtype=np.uint16).reshape(-1, HASHES) for k in (2, 3))
            alive, agree = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
            for at, least in steps:
                agree += (x[alive, at : at + BATCH] == y[alive, at : at + BATCH]).sum(axis=1)
                alive, agree = alive[agree >= least], agree[agree >= least]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(alive)) for c in batch.columns[:2]], names=["a", "b"])

    sigs = nodes.select("node", "sig")
    one = out.write(pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a"), "sided")
    both = one.join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a binary, b binary")


def _planes(sigs: list[bytes]) -> list[np.ndarray]:
    """``PLANES * HALVES`` words of each signature: a bit of every minimum, then the next bit."""
    x = np.frombuffer(b"".join(sigs), dtype=np.uint16).reshape(-1, HASHES)
    return [w for p in range(PLANES) for w in np.packbits((x >> p & 1).astype(np.uint8), axis=1).view(np.int64).T.copy()]


def _agree(a: str, b: str) -> Column:
    """So many minima agree in the bits compared that the batches may leave the pair."""
    differ = F.lit(0)
    for k in range(HALVES):
        words = (F.col(f"{a}.s{p * HALVES + k}").bitwiseXOR(F.col(f"{b}.s{p * HALVES + k}")) for p in range(PLANES))
        differ = differ + F.bit_count(reduce(Column.bitwiseOR, words))
    return differ <= HASHES - least_matches(HASHES)


def told(blocks: DataFrame, nodes: DataFrame, out: Scratch) -> DataFrame:
    """``blocks`` with the words of each node's signature and ``hs``, all the band values under which it is there."""
    words = [f"s{k}" for k in range(PLANES * HALVES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(0), *(pa.array(w) for w in _planes(batch.column(1).to_pylist())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["node", *words, "hs"])

    held = out.write(blocks.groupBy("node").agg(F.sort_array(F.collect_set("h")).alias("hs")), "held")  # a node has as many as bands
    some = held.join(nodes.select("node", "sig"), "node").select("node", "sig", "hs")
    known = out.write(some.mapInArrow(run, f"node binary, {', '.join(f'{w} long' for w in words)}, hs array<long>"), "words")
    return out.write(blocks.join(known, "node"), "told")


def left_pairs(blocks: DataFrame, nodes: DataFrame, out: Scratch) -> DataFrame:
    """The pairs (a, b) of different components that share a band value of ``blocks`` and may be linked, each once."""
    known = told(blocks, nodes, out)
    first = F.array_min(F.array_intersect("a.hs", "b.hs")) == F.col("a.h")
    fits = _fits("a", "b") & _near("a", "b") & (F.col("a.root") < F.col("b.root")) & _agree("a", "b") & first
    joined = known.alias("a").join(known.alias("b"), (F.col("a.h") == F.col("b.h")) & fits)
    return joined.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))


def links(nodes: DataFrame, whole: Callable[[DataFrame], DataFrame], out: Scratch) -> DataFrame:
    """(node, root) of the components of similar sets; ``whole`` gives (node, s) of the nodes of a table."""
    spark, found, roots = nodes.sparkSession, None, None
    blocks, met = gathered(nodes, out)
    blocks = blocks.withColumn("root", F.col("node"))
    for r in range(STARS + 1):
        if roots is not None:
            with scratch(spark) as own:
                named = own.write(blocks.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
                mixed = named.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h")
                blocks = out.write(named.join(own.write(mixed, "mixed"), "h"), "mixed")
        if r < STARS:
            rank = F.col("weight") if r == 0 else F.xxhash64("node", F.lit(r))
            pivot = F.max(F.struct(rank.alias("rank"), "node", "n", "root", *BITS)).alias("p")
            pivots = out.write(blocks.groupBy("h").agg(pivot).select("h", "p.node", "p.n", "p.root", *(f"p.{b}" for b in BITS)), "pivots")
            fits = (F.col("a.root") != F.col("b.root")) & _fits("a", "b") & _near("a", "b")
            joined = blocks.alias("a").join(pivots.alias("b"), (F.col("a.h") == F.col("b.h")) & fits)
            pairs = joined.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
        else:
            pairs = left_pairs(blocks, met, out)
        with scratch(spark) as own:
            likely = own.write(plausible(own.write(pairs, "pairs"), met, own), "likely")
            ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            new = out.write(similar(likely, own.write(whole(ends), "sets")), "similar")
        found = new if found is None else found.unionByName(new)
        roots = out.write(components(found), "roots")
    return roots


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """__id, __key, n_shingles and component_id for every row of ``docs``."""
    small_batches(docs.sparkSession)
    given = docs.select(
        F.col(id_col).alias("__id"),
        text_key(text_col).alias("__key"),
        F.col(text_col).cast("string").cast("binary").alias("__text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(s.tobytes()) for s in found], pa.binary()), _lists(found)], names=["node", "s"])

    with scratch(docs.sparkSession) as out:
        rows = out.write(signed(given, width), "signed")
        nodes = out.write(rows.where("n > 0").select("node", "n", *BITS, "sig").dropDuplicates(["node"]), "nodes")

        # One text for each node, chosen before any join, so that a set of many copies is combined first.
        texts_of = out.write(rows.where("n > 0").groupBy("node").agg(F.min("__key").alias("__key")), "texts")

        def whole(some: DataFrame) -> DataFrame:
            keys = out.write(texts_of.join(some, "node").select("__key"), "keys")
            if keys.count() <= BROADCAST_ROWS:  # then the texts need not move
                keys = F.broadcast(keys)
            texts = given.join(keys, "__key", "left_semi").select("__text")
            return texts.mapInArrow(run, "node binary, s array<long>").dropDuplicates(["node"])

        roots = links(nodes, whole, out)
        named = out.write(rows.where("n > 0").join(roots, "node", "left").select("__id", "__key", "n", F.coalesce("root", "node").alias("root")), "rooted")
        least = out.write(named.groupBy("root").agg(F.min("__id").alias("component_id")), "least")
        linked = named.join(least, "root").select("__id", "__key", F.col("n").alias("n_shingles"), "component_id")
        alone = rows.where("n = 0").select("__id", "__key", F.col("n").alias("n_shingles"), F.col("__id").alias("component_id"))
        return materialize(linked.unionByName(alone), "classes")[0]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    kept = F.col("__id").eqNullSafe(F.col("component_id"))
    return classes(docs).select(F.col("__id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS) -> DataFrame:
    """Rows of ``docs`` that stay - each class's smallest id - with all columns.

    Texts without words all stay, a row for each id; rows of a class without any non-null id are one row a text.
    """
    rows = classes(docs, id_col, text_col, width)
    stays = F.col("__id").eqNullSafe(F.col("component_id"))
    least = rows.where(stays & F.col("__id").isNotNull()).groupBy("component_id").agg(F.min("__key").alias("__key"))
    nameless = rows.where(stays & F.col("__id").isNull()).select("__id", "__key").distinct()
    kept, _ = materialize(least.select(F.col("component_id").alias("__id"), "__key").unionByName(nameless), "kept")
    n = rows.where(stays).count()
    on = F.col("d.__id").eqNullSafe(F.col("k.__id")) & (F.col("d.__key") == F.col("k.__key"))
    dropped = rows.alias("d").join(kept.alias("k"), on, "left_anti").select("__id", "__key")
    return drop_rows(docs, kept, dropped, id_col, text_key(text_col), unique=n == kept.count())
