"""SimHash near-duplicates with pigeonring filtering.

A text's fingerprint takes the majority of the XXH64 bits of its word shingles
(repeats included).  Links are pairs of fingerprints within ``DISTANCE`` (2) bits.

Candidates.  The 64 bits form a ring of six segments.  If two fingerprints differ in
at most 2 bits, some segment starts a chain whose first l segments differ in at most
l*2/6 bits for every l: budgets 0, 0, 1, 1, 1.  So five segments in a row hold at most
one differing bit, and four of them are equal: the 15 choices of four segments are
the join keys, of some 42 bits each.  Pairs meeting at a key are pruned by the chain
of five segments (shorter than the ring), and the full Hamming check comes last.

Dense blocks.  Groups of near copies crowd one block, where pairs would be
quadratic.  Blocks above ``dense`` fingerprints are connected exactly another way:
within a block 22 bits are free at most, and two fingerprints are within two bits
exactly if they share a neighbour at one bit from both; each emits itself and its
flips, and fingerprints meeting at a value are linked to the smallest (23 at most
meet).  No pair list is made, and no link between components is lost.

Defined results: null and word-less texts have fingerprint 0 and link like any
other; fewer words than a shingle make one shingle; repeated rows have one
fingerprint; null ids take part, and a component's id is its smallest non-null id
(null if it has none).  A very long text is voted on in runs of shingles; besides
the runs a task holds one text and its word boundaries.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from kestrel.llm.components import components
from kestrel.llm.rows import drop_rows, small_batches, text_key
from kestrel.storage import materialize

SEED = 42
DISTANCE, SEGMENTS = 2, 6
#: Bit at which each segment of the ring begins, and the end.
EDGES = tuple(-(-64 * k // SEGMENTS) for k in range(SEGMENTS + 1))
#: Budgets of chains of 1, 2, ... segments, short of the whole ring.
BUDGETS = tuple(length * DISTANCE // SEGMENTS for length in range(1, SEGMENTS))
#: Segments that two linked fingerprints may differ in.
FREE = tuple((i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS))
#: Hashes voted on at once, so that a very long text needs bounded memory.
VOTES = 1 << 16


def shingle_hashes(text: bytes, width: int) -> Iterator[np.ndarray]:
    words = text.lower().split()  # bytes.lower() changes A-Z alone
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    w = min(width, len(words))
    first, last = starts[: len(words) - w + 1], ends[w - 1 :]
    for i in range(0, len(first), VOTES):
        a, b = first[i : i + VOTES].tolist(), last[i : i + VOTES].tolist()
        shingles = map(joined.__getitem__, map(slice, a, b))
        yield np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=len(a))


def voted(parts: Iterable[np.ndarray]) -> int:
    """Unsigned 64-bit majority of the hashes of all ``parts``."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for h in parts:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: bytes | None, width: int = 3) -> int:
    return voted(shingle_hashes(text or b"", width))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """__id, __key (text digest) and fp (signed long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], names=["__id", "__key", "fp"]
            )

    small_batches(docs.sparkSession)
    given = docs.select(
        F.col(id_col).alias("__id"),
        text_key(text_col).alias("__key"),
        F.col(text_col).cast("string").cast("binary").alias("__text"),
    )
    return given.mapInArrow(run, f"__id {given.schema['__id'].dataType.simpleString()}, __key binary, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(segments: tuple[int, ...]) -> int:
    return sum((1 << b) for s in segments for b in range(EDGES[s], EDGES[s + 1]))


def chained(a: Column, b: Column) -> Column:
    """Some chain of the ring, one segment short of the whole, stays within its budgets."""
    diff = a.bitwiseXOR(b)
    d = [F.bit_count(diff.bitwiseAND(F.lit(_signed(_mask((i,)))))) for i in range(SEGMENTS)]
    ring = F.lit(False)
    for start in range(SEGMENTS):
        total, ok = F.lit(0), F.lit(True)
        for length, budget in enumerate(BUDGETS):
            total = total + d[(start + length) % SEGMENTS]
            ok = ok & (total <= budget)
        ring = ring | ok
    return ring


def blocks(fps: DataFrame) -> DataFrame:
    """(t, key, fp, n) for every key that n > 1 fingerprints of ``fps(fp)`` share: all but the segments FREE[t] are equal."""
    fp = F.col("fp")
    keys = fps.select(
        "fp",
        F.posexplode(F.array(*(fp.bitwiseAND(F.lit(_signed(~_mask(free) & (1 << 64) - 1))) for free in FREE))).alias("t", "key"),
    )
    # Both sides of the join are written, so that a crowded key's rows can be split.
    crowded, _ = materialize(
        keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "crowded"
    )
    return keys.join(crowded, ["t", "key"])


def met(table: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of fingerprints that share a key; a pair once for each key."""
    a, b = table.alias("a"), table.alias("b")
    same = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, same).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def links(fps: DataFrame, dense: int = 32) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints of ``fps(fp)``, distinct, within two bits."""
    table, _ = materialize(blocks(fps), "prints")
    sparse, thick = table.where(F.col("n") <= dense), table.where(F.col("n") > dense)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = met(sparse).where(chained(F.col("a"), F.col("b"))).where(near)
    flips = F.lit(None)
    for t, free in enumerate(FREE):
        at = [b for s in free for b in range(EDGES[s], EDGES[s + 1])]
        flips = F.when(F.col("t") == t, F.array(*(F.lit(x) for x in (0, *(_signed(1 << b) for b in at))))).otherwise(flips)
    mids = thick.select("t", "key", "fp", F.explode(flips).alias("flip")).select(
        "t", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")
    )
    # At most 23 fingerprints meet at a (t, key, mid), so the list is bounded.
    stars = mids.groupBy("t", "key", "mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return pairs.unionByName(stars)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """__id, __key, fp, component_id for every row of ``docs``."""
    rows, _ = materialize(fingerprints(docs, id_col, text_col, width), "fps")
    nodes, _ = materialize(rows.groupBy("fp").agg(F.min("__id").alias("least")), "nodes")
    roots, _ = materialize(components(links(nodes.select("fp"))), "roots")
    labelled = nodes.join(roots, nodes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp, _ = materialize(labelled.join(named, "root").select("fp", "component_id"), "classes")
    return rows.join(by_fp, "fp").select("__id", "__key", "fp", "component_id")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return classes(docs).select(
        F.col("__id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """Rows of ``docs`` that stay - each class's smallest id - with all columns.

    Rows of a class without any non-null id are one row per text.
    """
    rows, _ = materialize(classes(docs, id_col, text_col, width), "classes")
    stays = F.col("__id").eqNullSafe(F.col("component_id"))
    kept = rows.where(stays)
    n, distinct = kept.agg(F.count(F.lit(1)), F.countDistinct("component_id")).first()
    one = kept.groupBy("component_id").agg(F.min(F.struct("__id", "__key")).alias("k")).select("k.__id", "k.__key")
    nameless = kept.where("component_id IS NULL").groupBy("__id", "__key").count().drop("count")
    kept_rows = one.where("__id IS NOT NULL").unionByName(nameless)
    dropped = rows.where(~stays).select("__id", "__key")
    return drop_rows(docs, kept_rows, dropped, id_col, text_key(text_col), unique=n == distinct)
