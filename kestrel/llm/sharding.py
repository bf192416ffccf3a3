"""Contiguous shards of nearly equal bytes from a global prefix sum.

Rows are range-partitioned in key order and sorted; each partition sums its own sizes
as it is written, so every row holds its start within its partition.  One small job
gives each partition's total; prefix sums over those totals (one row per partition,
never per document) place every partition in the global byte range, and a row's shard
follows from its global start.  A row goes to the shard in which the middle of its
bytes falls: shards are contiguous in key order, and each differs from the equal
target by less than the largest row.

Defined results: null text has no bytes (size = the per-row overhead alone, CRC 0);
rows with equal or null keys are ordered by CRC and size, and equal rows are
interchangeable; an empty table gives no rows; a row larger than the target leaves
neighbouring shards empty; other columns are never read.

Groups of equal texts: the law here is equal bytes and rows stand in key order, so a
group is not held together - it may be larger than a shard - and its rows lie wherever
their ids put them.  :func:`spread` tells over how many shards a group goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.rows import text_key
from kestrel.storage import materialize, release


def sizes(docs: DataFrame, id_col: str, text_col: str, overhead: int) -> DataFrame:
    text = F.col(text_col).cast("string").cast("binary")
    return docs.select(
        F.col(id_col).alias("__id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
        *(["__uid"] if "__uid" in docs.columns else []),
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds where each row starts in its partition: bytes and rows before it."""
    start = at = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        ends = start + np.cumsum(size)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(ends - size), pa.array(at + np.arange(len(size), dtype=np.int64))],
            names=[*batch.schema.names, "start", "at"],
        )
        start, at = int(ends[-1]) if len(size) else start, at + len(size)


def assign(
    docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16
) -> DataFrame:
    """__id, size, crc, shard, slot for every row of ``docs`` (and __uid, if it has such a column)."""
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["__id", "crc", "size"]
    # Written first: range partitioning reads its rows twice, texts are read once.
    own, own_at = materialize(sizes(docs, id_col, text_col, overhead), "rows")
    ranged = own.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema)
    # Written once, so partition numbers and order are settled.
    placed, _ = materialize(ranged.mapInArrow(_running, f"{fields}, start long, at long"), "sizes")
    release(spark, own_at)
    # One row per partition reaches the driver, as a task's status does.
    totals = sorted(placed.groupBy("part").agg(F.sum("size"), F.count(F.lit(1))).collect())
    before, n = [], [0, 0]
    for part, size, rows in totals:
        before.append((part, *n))
        n = [n[0] + size, n[1] + rows]
    offsets = spark.createDataFrame(before, "part int, bytes long, rows long")
    # The middle of a row is 2 * start + size in half bytes; shard k begins at 2 * k * whole / shards.
    middle = "CAST((start + bytes) * 2 + size AS decimal(24, 0))"
    shard = F.least(F.expr(f"({middle} * {shards}) div CAST({max(1, 2 * n[0])} AS decimal(24, 0))"), F.lit(shards - 1))
    cut = placed.join(F.broadcast(offsets), "part").select(
        *[c for c in placed.columns if c not in ("part", "start", "at")],
        shard.cast("int").alias("shard"),
        (F.col("at") + F.col("rows")).alias("at"),
    )
    # At most one row per shard, a parameter.
    starts = cut.groupBy("shard").agg(F.min("at").alias("first_at"))
    return cut.join(F.broadcast(starts), "shard").withColumn("slot", F.col("at") - F.col("first_at")).drop("at", "first_at")


def report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document with its shard and slot."""
    return assign(docs.select("doc_id", "text"), shards).select(
        F.col("__id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def spread(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(copies, shards) of every group of equal texts: over how many shards its rows go."""
    held, _ = materialize(docs.select(id_col, text_col).withColumn("__uid", F.monotonically_increasing_id()), "held")
    plan = assign(held, shards, id_col, text_col).select("__uid", "shard")
    keyed = held.select("__uid", text_key(text_col).alias("key")).join(plan, "__uid")
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.countDistinct("shard").alias("shards")).drop("key")


def write_shards(
    docs: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None
) -> DataFrame:
    """Write whole rows of ``docs`` as ``shard=K`` folders; return the plan (__id, size, crc, shard, slot).

    Any ids will do, null and repeated ones too.  A shard is written by as many tasks as
    its share of ``files`` (default: the session's shuffle partitions) in order of slots.
    The folders are named ``shard``, or ``shard_`` (and so on) if ``docs`` has such a column.
    """
    name = "shard"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    held, _ = materialize(docs.withColumn("__uid", F.monotonically_increasing_id()), "held")
    plan, _ = materialize(assign(held, shards, id_col, text_col), "plan")
    own = plan.select(F.col("__uid").alias("__plan"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    files = files or max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    (
        held.join(own, F.col("__uid") == F.col("__plan"))
        .drop("__plan", "__uid")
        .repartitionByRange(files, "__shard", "__slot")
        .sortWithinPartitions("__shard", "__slot")
        .drop("__slot")
        .withColumnRenamed("__shard", name)
        .write.partitionBy(name)
        .parquet(path)
    )
    return plan.drop("__uid")
