"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by SHA-256 digest.  It belongs to its folder, not
to a session's catalog: a small file there names its present files, so that any later
session, with a metastore or without, opens the same index.  It has one writer at a time
(a second one could append the same digest); readers are free.

A new batch is reduced to one row per digest (partial aggregation before the shuffle,
so a text with very many copies costs one row per task), compared with the index by
a sort-merge anti-join - the index side is read by bucket, without a shuffle - and
the digests not yet known are appended.  A batch that is ingested again under its own
name (after a failure, say) is answered as it was the first time.

One table is deduplicated as ``BATCHES`` batches in the order of its ids, so that the
owner that the index knows already has the smaller id.  (Ids that are neither numbers nor
strings pass as one batch, which changes no result.)

Defined results: null text counts as empty; texts are equal when identical after
each run of white space becomes one space (edges are not trimmed); of equal texts
the row with the smallest id stays (null ids last; of ties, which are exact repeats,
one arbitrary row); an earlier batch's owner always stays; an empty batch changes
nothing; very long texts are one value of a row, hashed whole; columns other than id
and text are never read, whatever their names.
"""

from __future__ import annotations

import json
import uuid
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from kestrel.llm.rows import SPACE, drop_rows
from kestrel.storage import Scratch, materialize, release, scratch, shared_root

#: Batches that one table is dealt into.
BATCHES = 2


def normalised(text: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE, " ")


def digest(text: str) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def digests(docs: DataFrame, out: Scratch, id_col: str, text_col: str) -> DataFrame:
    """__id, digest and uid of every row, written: each text is read and hashed once."""
    uid = F.monotonically_increasing_id().alias("uid")
    return out.write(docs.select(F.col(id_col).alias("__id"), digest(text_col).alias("digest"), uid), "digests")


class DigestIndex:
    """Append-only table (digest, keep_id, batch), bucketed and sorted by digest, in the folder ``path``.

    ``path`` is by default a folder of the table's name in the shared folder.  What the folder
    holds is the index; ``table`` is only the name under which this session reads it.
    """

    def __init__(self, spark: SparkSession, table: str, buckets: int = 64, path: str | None = None):
        self.spark, self.table, self.buckets = spark, table, buckets
        self.path = (path or f"{shared_root(spark)}/{table}").rstrip("/")
        if state := self._state():
            self._register(self.table, state)

    def _file(self, name: str) -> tuple:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _state(self) -> dict | None:
        """The present state, or that of a change which died between taking the old file away and naming the new one."""
        for name in ("index.json", "next.json"):
            fs, at = self._file(name)
            if fs.exists(at):
                return json.loads(self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0])
        return None

    def _set_state(self, state: dict) -> None:
        fs, new = self._file("next.json")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        _, present = self._file("index.json")
        fs.delete(present, False)
        if not fs.rename(new, present):
            raise RuntimeError(f"the index state of {self.path} could not be written")

    def _register(self, table: str, state: dict) -> None:
        self.buckets = state["buckets"]
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")  # an external table: its files stay
        at = f"{self.path}/{state['folder']}".replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE {table} (digest BINARY, keep_id {state['id']}, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{at}'"
        )

    def _write(self, rows: DataFrame, table: str) -> None:
        dealt = rows.repartition(self.buckets, "digest").write.mode("append").format("parquet")
        dealt.bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(table)

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)  # another session may have appended
        return self.spark.table(self.table)

    def compact(self) -> None:
        """One sorted file for each bucket again, after many appends."""
        old = self._state()
        state = old | {"folder": f"g{int(old['folder'][1:]) + 1}"}
        release(self.spark, f"{self.path}/{state['folder']}")  # of a compaction that died
        new = f"{self.table}_new"
        self._register(new, state)
        self._write(self.read(), new)
        self._set_state(state)
        self.spark.sql(f"DROP TABLE {new}")
        self._register(self.table, state)
        release(self.spark, f"{self.path}/{old['folder']}")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
        release(self.spark, self.path)

    def ingest(self, docs: DataFrame, out: Scratch, id_col: str, text_col: str, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Add a batch of documents; return (its digests, its texts), see :func:`digests` and :meth:`add`."""
        seen = digests(docs, out, id_col, text_col)
        return seen, self.add(seen, out, batch)

    def add(self, seen: DataFrame, out: Scratch, batch: str | None = None) -> DataFrame:
        """Add the batch ``seen(__id, digest, uid)`` under the name ``batch``.

        Returns one row per distinct text: digest, keep_id, keep_uid, n (the batch's rows), fresh.
        """
        batch = batch or uuid.uuid4().hex
        first = F.min(F.struct(F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("uid").alias("u")))
        if not self._state():
            state = {"folder": "g0", "buckets": self.buckets, "id": seen.schema["__id"].dataType.simpleString()}
            self._set_state(state)
            self._register(self.table, state)
        with scratch(self.spark) as own:
            new = own.write(
                seen.groupBy("digest")
                .agg(first.alias("f"), F.count(F.lit(1)).alias("n"))
                .select("digest", F.col("f.i").alias("keep_id"), F.col("f.u").alias("keep_uid"), "n"),
                "batch",
            )
            fresh = new.join(self.read().hint("merge"), "digest", "left_anti")
            fresh = own.write(fresh.select("digest", "keep_id", F.lit(batch).alias("batch")), "fresh")
            self._write(fresh, self.table)
            return out.write(
                new.drop("keep_id")
                .join(self.read().hint("merge"), "digest")
                .select("digest", "keep_id", "keep_uid", "n", (F.col("batch") == batch).alias("fresh")),
                "texts",
            )


def scratch_index(spark: SparkSession) -> DigestIndex:
    """An index for one run, sized from the session's shuffle partitions."""
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return DigestIndex(spark, f"kestrel_digests_{uuid.uuid4().hex}", buckets)


def _in_order(seen: DataFrame, batches: int) -> list[DataFrame]:
    """``seen`` in parts of about equal size, every __id of one below those of the next; null ids last."""
    kind, place = seen.schema["__id"].dataType, F.col("__id")
    if isinstance(kind, StringType):
        # The seven bytes after what all ids begin with, as a number: equal or in the strings' order.
        low, high = seen.agg(F.min("__id"), F.max("__id")).first()
        skip = len(commonprefix([(low or "").encode(), (high or "").encode()]))
        place = F.conv(F.rpad(F.hex(F.substring(F.col("__id").cast("binary"), skip + 1, 7)), 14, "0"), 16, 10).cast("long")
    elif not isinstance(kind, NumericType):
        return [seen]
    if batches < 2:
        return [seen]
    cuts = seen.agg(F.percentile_approx(place, [k / batches for k in range(1, batches)])).first()[0]
    part = F.lit(0)
    for cut in cuts or []:
        part = part + F.coalesce((place > F.lit(cut)).cast("int"), F.lit(1))
    return [seen.where(part == k) for k in range(len(cuts or []) + 1)]


def judged(
    docs: DataFrame, id_col: str, text_col: str, index: DigestIndex | None = None, batch: str | None = None, batches: int = BATCHES
) -> DataFrame:
    """__id, digest, keep_id, group_size, kept, fresh for every row.

    With an ``index`` the rows are its next batch, else they pass a fresh index in
    ``batches``.  ``group_size`` counts rows of ``docs`` alone; ``fresh`` says that the text was new.
    """
    spark = docs.sparkSession
    own = index or scratch_index(spark)
    with scratch(spark) as out:
        try:
            seen = digests(docs, out, id_col, text_col)
            texts = None
            for part in [seen] if index else _in_order(seen, batches):
                more = own.add(part, out, batch)
                texts = more if texts is None else texts.unionByName(more)
        finally:
            if index is None:
                own.drop()
        # At most one batch finds a text fresh, and its first row is the owner.
        owner = F.max(F.when(F.col("fresh"), F.col("keep_uid"))).alias("owner")
        whole = out.write(
            texts.groupBy("digest").agg(F.first("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), owner), "groups"
        )
        # Both sides are plain scans under their exchanges: a hot text is split by skew-join handling.
        rows = seen.join(whole, "digest")
        mine = F.col("uid") == F.col("owner")
        return materialize(
            rows.select(
                "__id", "digest", "keep_id", "group_size", F.coalesce(mine, F.lit(False)).alias("kept"), F.col("owner").isNotNull().alias("fresh")
            ),
            "exact",
        )[0]


def deduplicate(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batch: str | None = None
) -> DataFrame:
    """Rows of ``docs`` that stay, all columns."""
    rows = judged(docs, id_col, text_col, index, batch)
    stays = rows.where("kept").select("__id", F.col("digest").alias("__key"))
    goes = rows.where("NOT kept").select("__id", F.col("digest").alias("__key"))
    repeats = rows.where(F.col("__id").eqNullSafe(F.col("keep_id")) & F.col("fresh") & ~F.col("kept")).limit(1).count()
    return drop_rows(docs, stays, goes, id_col, digest(text_col), unique=not repeats)


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    return judged(docs, id_col, text_col).select(
        F.col("__id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
