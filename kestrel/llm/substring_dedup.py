"""Substring dedup: every word covered by a repeated window of ``window`` words goes.

Level-wise doubling.  Level 1 counts short windows (9 words); a window counted once
is dropped, and only those that repeat are extended to twice their length (18) and
counted again, and so on until the window's own length (35) or until no candidates
survive: a level that leaves no candidate is the last.  A level never sees text that the level before found unique.

* Level 1 does not count every start: of each run of short windows that fit into
  one full window, the least hash represents it.  Two equal full windows choose
  equal representatives, so none is lost, while about 7 % of the starts are shuffled.
* A survivor is extended to the right and to the left (of a full window around it,
  one of the two always fits inside); at the last level to every full window that
  contains it.
* Counting is a partial aggregation; survivors come back by a join of two written
  tables, so that a passage shared by a third of all documents is split as skew.

Texts are reduced first: equal texts become one row with a count (aggregated before
the shuffle), stored in a table bucketed by text key, which every level then joins
without moving text again.  A text with copies has all its windows repeated.

Hashes: short levels use 64 bits and only choose candidates; the last level uses
two independent 64-bit hashes.

Defined results: null or word-less text has no words; fewer words than a window
stay; repeated rows are copies of one another, whatever their ids; a very long text
is a run of its own, of which a task holds a few numbers a word; equal hashes count as
equal windows (128 bits decide); null ids are answered; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.rolling import BASES, Words, winnow
from kestrel.llm.rows import small_batches, text_key
from kestrel.storage import Scratch, materialize, release, scratch

WINDOW, FIRST = 35, 9
#: Texts are handled in runs of about this many bytes (a longer text: alone).
RUN_BYTES = 2 << 20


def ladder(window: int, first: int) -> list[int]:
    """Lengths of the levels, doubling up to the window's.

    Short of the last level, a length is such that a survivor extended to the right
    or else to the left fits into any full window around it.
    """
    out = [min(first, window)]
    while out[-1] < window:
        double = 2 * out[-1]
        out.append(window if window <= double else min(double, (window + out[-1] + 1) // 2))
    return out


def _by_size(batch: pa.RecordBatch, column: str, run_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``run_bytes`` of text."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], dtype=np.int64)
    run, at = np.cumsum(size) // run_bytes, 0
    for end in [*(np.flatnonzero(np.diff(run)) + 1), batch.num_rows]:
        if end > at:
            yield batch.slice(at, end - at)
        at = end


def distinct_texts(docs: DataFrame, text_col: str, out: Scratch, parts: int) -> DataFrame:
    """Table (rid, tag, text, copies) bucketed by rid, and the key of each."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    one = (
        docs.select(text_key(text_col).alias("key"), text.alias("text"))
        .groupBy("key")
        .agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    )
    keyed = one.select(*_rid(F.col("key")), "text", "copies")
    return out.table(keyed.repartition(parts, "rid"), "rid", parts, "texts")


def _rid(key):
    """Row id of a text: 64 bits to join and bucket by, 32 more that are compared besides."""
    return (
        F.conv(F.hex(F.substring(key, 1, 8)), 16, -10).cast("long").alias("rid"),
        (F.conv(F.hex(F.substring(key, 9, 4)), 16, 10).cast("long") - (1 << 31)).cast("int").alias("tag"),
    )


SURVIVORS = "rid long, tag int, pos array<int>"


def _emit(batch, rows, doc, pos, *hashes) -> pa.RecordBatch:
    rid, tag = batch.column("rid").to_numpy()[rows][doc], batch.column("tag").to_numpy()[rows][doc]
    cols = [pa.array(h.view(np.int64)) for h in hashes]
    names = ["h", "g"][: len(cols)]
    return pa.RecordBatch.from_arrays(
        [pa.array(rid), pa.array(tag), pa.array(pos.astype(np.int32)), *cols], names=["rid", "tag", "pos", *names]
    )


def _level(window: int, lengths: list[int], level: int):
    """Windows of one level, from texts (level 0) or texts with the survivors of the level before."""
    length = lengths[level]
    last = length == window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _by_size(whole, "text", RUN_BYTES):
                words = Words([t.as_py() for t in batch.column("text")])
                if len(words) < window:
                    continue
                if level == 0:
                    at = np.arange(len(words) - length + 1)
                    if not last:
                        at = winnow(words.windows(length), window - length + 1)
                else:
                    before = lengths[level - 1]
                    own = batch.column("pos")
                    n = np.asarray(own.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)
                    p = own.flatten().to_numpy() + np.repeat(words.first[:-1], n)
                    if last:
                        at = np.unique((p[:, None] - np.arange(window - before + 1)[None, :]).ravel())
                    else:
                        at = np.unique(np.concatenate((p, p - (length - before))))
                at = at[words.inside(at, length)]
                k = words.owner(at)
                fits = words.count[k] >= window
                at, k = at[fits], k[fits]
                if not len(at):
                    continue
                bases = BASES if last else BASES[:1]
                yield _emit(batch, slice(None), k, at - words.first[k], *(words.windows(length, b, at) for b in bases))

    return run, last


def repeated(texts: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """SURVIVORS: starts of the windows of each distinct text that start anywhere else too (copies apart)."""
    lengths = ladder(window, first)
    spark, state, state_at = texts.sparkSession, None, None
    for level in range(len(lengths)):
        run, last = _level(window, lengths, level)
        source = texts.select("rid", "tag", "text")
        if state is not None:
            s = state.select(F.col("rid").alias("r"), F.col("tag").alias("t"), "pos")
            # rid alone is the join key, for the table's buckets; tag is a residual condition.
            source = source.join(s, (F.col("rid") == F.col("r")) & (F.col("tag") - F.col("t") == 0)).select(
                "rid", "tag", "text", "pos"
            )
        keys = ["h", "g"] if last else ["h"]
        found = source.mapInArrow(run, "rid long, tag int, pos int, " + ", ".join(f"{k} long" for k in keys))
        found, found_at = materialize(found, f"level{level}")
        twice = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        twice, twice_at = materialize(twice, f"twice{level}")
        survivors = found.join(twice, keys).groupBy("rid", "tag").agg(F.collect_list("pos").alias("pos"))
        new, new_at = materialize(survivors, f"survivors{level}")
        release(spark, found_at, twice_at, *([state_at] if state_at else []))
        state, state_at = new, new_at
        if not state.limit(1).count():  # no candidate survives
            return state
    return state


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def judged(docs: DataFrame, text_col: str = "text", window: int = WINDOW, first: int = FIRST, keep_text: bool = False):
    """One row per distinct text: rid, tag, n_words, n_removed, kept_sha256 (and kept, the text left)."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, pos in zip(*(batch.column(c) for c in ("text", "copies", "pos")), strict=True):
                data = text.as_py()
                words = data.split()
                n = len(words)
                removed = 0
                if copies.as_py() > 1 and n >= window:
                    words, removed = [], n
                elif pos.is_valid:
                    hit = _covered(n, np.asarray(pos.values.to_numpy(), dtype=np.int64), window)
                    removed = int(hit.sum())
                    words = [w for w, h in zip(words, hit.tolist(), strict=True) if not h]
                kept = b" ".join(words)
                left = (data if not removed else kept).decode() if keep_text else None
                out.append((n, removed, hashlib.sha256(kept).hexdigest(), left))
            n, removed, sha, left = zip(*out, strict=True) if out else ((), (), (), ())
            cols = [batch.column("rid"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(removed, pa.int64())]
            names = ["rid", "tag", "n_words", "n_removed", "kept_sha256"]
            cols.append(pa.array(sha, pa.string()))
            if keep_text:
                cols, names = [*cols, pa.array(left, pa.string())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    with scratch(spark) as out:
        texts = distinct_texts(docs, text_col, out, parts)
        found = repeated(texts, window, first)
        gone = found.select(F.col("rid").alias("r"), F.col("tag").alias("t"), "pos")
        given = texts.join(gone, (F.col("rid") == F.col("r")) & (F.col("tag") - F.col("t") == 0), "left").select(
            "rid", "tag", "text", "copies", "pos"
        )
        schema = "rid long, tag int, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
        return materialize(given.mapInArrow(apply, schema), "judged")[0]


def report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs``."""
    texts = judged(docs, window=window)
    ids, _ = materialize(docs.select("doc_id", *_rid(text_key("text"))), "ids")
    return ids.join(texts, ["rid", "tag"]).select("doc_id", "n_words", "n_removed", "kept_sha256")


def clean(docs: DataFrame, text_col: str = "text", window: int = WINDOW, drop_emptied: bool = True) -> DataFrame:
    """``docs`` with the repeated words taken out of the text, all columns.

    Rows that lose nothing keep their text as it is; from others the words left are
    joined by one space.  Rows that lose every word go if ``drop_emptied``.
    """
    texts = judged(docs, text_col, window, keep_text=True)
    changed = texts.where("n_removed > 0").select(
        F.col("rid").alias("__r"),
        F.col("tag").alias("__t"),
        F.col("kept").alias("__kept"),
        (F.col("n_removed") == F.col("n_words")).alias("__emptied"),
    )
    rid, tag = _rid(text_key(text_col))
    own = docs.withColumn("__rid", rid).withColumn("__tag", tag)
    out = own.join(changed, (F.col("__rid") == F.col("__r")) & (F.col("__tag") == F.col("__t")), "left")
    if drop_emptied:
        out = out.where(~F.coalesce("__emptied", F.lit(False)))
    return out.withColumn(text_col, F.coalesce("__kept", F.col(text_col))).select(*docs.columns)
