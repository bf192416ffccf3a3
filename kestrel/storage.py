"""Cutting lineage through the folder that the driver and all executors share.

A written table survives the loss of any executor, unlike cached blocks.  The
folder is the one that the cluster names in ``spark.checkpoint.dir``; where that is
unset a local session (tests, a laptop) makes a temporary folder, and any other
raises: executors would each write to a disk of their own.

Operators release what only they read.  What a returned table still reads stays: when no
job needs older results any more, :func:`sweep` clears them away.
"""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not (master := spark.sparkContext.master).startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="kestrel-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, label: str = "step") -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder; return the re-read table and its path."""
    path = f"{shared_root(df.sparkSession)}/kestrel-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bucketed(df: DataFrame, column: str, buckets: int, label: str, sort: bool = False) -> tuple[DataFrame, str]:
    """Write ``df`` bucketed by ``column`` under the shared folder; return the table and its name."""
    name = f"kestrel_{label}_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").bucketBy(buckets, column)
    if sort:
        writer = writer.sortBy(column)
    writer.saveAsTable(name, path=f"{shared_root(df.sparkSession)}/{name}")
    return df.sparkSession.table(name), name


def drop(spark: SparkSession, *tables: str) -> None:
    """Drop tables written by :func:`bucketed`, with their files."""
    for name in tables:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        release(spark, f"{shared_root(spark)}/{name}")


class Scratch:
    """What one operator has written for itself."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.tables = spark, [], []

    def write(self, df: DataFrame, label: str) -> DataFrame:
        out, path = materialize(df, label)
        self.paths.append(path)
        return out

    def table(self, df: DataFrame, column: str, buckets: int, label: str) -> DataFrame:
        out, name = bucketed(df, column, buckets, label)
        self.tables.append(name)
        return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables released at the end, whether the operator succeeds or fails; its result must not read them."""
    own = Scratch(spark)
    try:
        yield own
    finally:
        release(spark, *own.paths)
        drop(spark, *own.tables)


def release(spark: SparkSession, *paths: str) -> None:
    """Delete tables written by :func:`materialize` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def sweep(spark: SparkSession, hours: float) -> int:
    """Delete this package's intermediates in the shared folder that have not changed for ``hours``; how many.

    Tables that results still read must be younger: choose more hours than any job takes.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    before = (time.time() - hours * 3600) * 1000
    old = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith(("kestrel-", "kestrel_")) and f.getModificationTime() < before]
    for path in old:
        fs.delete(path, True)
    return len(old)
