"""Row identity and white space shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.storage import materialize

#: White space of every operator here: space and U+0009 to U+000D.  ``bytes.split()``
#: separates at exactly these bytes, unlike ``str.split()``.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts sent to a Python worker at once.
BATCH_ROWS = 1_000
#: Dropped rows (id and digest, some 50 bytes each) broadcast at most; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def small_batches(spark: SparkSession) -> None:
    """Send whole texts to Python in small batches, so that neither the JVM's buffers nor a worker grow with them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def text_key(text: str) -> Column:
    """128-bit digest of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def drop_rows(docs: DataFrame, kept: DataFrame, dropped: DataFrame, id_col: str, key: Column, unique: bool) -> DataFrame:
    """``docs`` without the rows whose (id, key) is in ``dropped(__id, __key)``; all columns stay.

    Only a few rows go as a rule, so they are sent to the texts if they are counted to
    be few; else the texts are joined with ``kept(__id, __key)``.  ``unique`` says that no
    other row shares (id, key) with one to be kept; else one of each set of repeats stays.
    """
    d = docs.withColumn("__k_key", key)
    on = F.col("k.__id").eqNullSafe(F.col(f"d.`{id_col}`")) & (F.col("k.__key") == F.col("d.__k_key"))
    if unique:
        gone, _ = materialize(dropped.distinct(), "dropped")
        if gone.count() <= BROADCAST_ROWS:
            return d.alias("d").join(F.broadcast(gone).alias("k"), on, "left_anti").drop("__k_key")
    out = d.alias("d").join(kept.alias("k"), on, "left_semi")
    if not unique:
        out = out.dropDuplicates([id_col, "__k_key"])
    return out.drop("__k_key")
