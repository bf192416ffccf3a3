"""Landed files taken in once each: a manifest of files, and data that counts only when the manifest names it.

A run lists the files of a source (path, size, time of change), takes those that the manifest does
not hold in this version, writes their rows under a batch of their own, and then appends the files to
the manifest, which is the commit: one small file that appears whole or not at all.  A run that dies
before leaves rows that no manifest names; the next one takes the same files again and clears them
away.  A file that changed is taken again, and its newer rows stand in place of the older ones.  Files
that disappear from the source keep their rows.  One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.storage import release

FILES = "path string, size long, changed timestamp, source string, batch string, batch_number int"


class Landing:
    """Rows and manifest of landed sources under the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, name: str) -> bool:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def manifest(self) -> DataFrame:
        """Every version of every file taken in."""
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.root}/manifest")

    def current(self) -> DataFrame:
        """The newest version of each file."""
        newest = self.manifest().groupBy("path").agg(F.max(F.struct("batch_number", "size", "changed", "source", "batch")).alias("v"))
        return newest.select("path", "v.*")

    def listed(self, folder: str, glob: str = "*") -> DataFrame:
        """path, size, changed of the files under ``folder``; their contents are not read."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
        return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))

    def pending(self, folder: str, glob: str = "*") -> DataFrame:
        """Files that are new or have changed since they were taken in."""
        return self.listed(folder, glob).join(self.current().select("path", "size", "changed"), ["path", "size", "changed"], "left_anti")

    def take(self, source: str, folder: str, read: Callable[[list[str]], DataFrame], glob: str = "*") -> int:
        """Take in what is pending of ``folder`` by ``read(paths)``, a scan of files, as rows of ``source``; how many files that were."""
        self.clear()
        # Spark lists the files of a scan on the driver too.
        files = [tuple(r) for r in self.pending(folder, glob).collect()]
        if not files:
            return 0
        batch = uuid.uuid4().hex
        number = (self.manifest().agg(F.max("batch_number")).first()[0] or 0) + 1
        rows = read([path for path, _, _ in files])
        rows.select("*", F.col("_metadata.file_path").alias("__path")).write.parquet(f"{self.root}/rows/source={source}/batch={batch}")
        told = [(path, size, changed, source, batch, number) for path, size, changed in files]
        self.spark.createDataFrame(told, FILES).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")
        return len(files)

    def clear(self) -> None:
        """Remove rows of batches that were never committed, or whose files have all been replaced."""
        if not self._exists("rows"):
            return
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        live = {r.batch for r in self.current().select("batch").distinct().collect()}  # a name a batch
        top = jvm.org.apache.hadoop.fs.Path(f"{self.root}/rows")
        fs = top.getFileSystem(conf)
        for source in fs.listStatus(top):
            for batch in fs.listStatus(source.getPath()):
                if batch.getPath().getName().removeprefix("batch=") not in live:
                    release(self.spark, batch.getPath().toString())

    def rows(self, source: str) -> DataFrame:
        """Rows of the newest version of every file of ``source``, with ``batch_number``; parts that lack columns have nulls there."""
        own = self.current().where(F.col("source") == source).select(F.col("path").alias("__path"), "batch", "batch_number")
        batches = [r.batch for r in own.select("batch").distinct().collect()]  # a name a batch
        if not batches:
            raise ValueError(f"nothing of {source} has landed")
        at = [f"{self.root}/rows/source={source}/batch={b}" for b in batches]
        data = self.spark.read.option("mergeSchema", True).option("basePath", f"{self.root}/rows").parquet(*at).drop("source")
        return data.join(own, ["__path", "batch"]).drop("__path", "batch")

    def freshness(self) -> DataFrame:
        """source, files, bytes, last change and runs of what is current."""
        return self.current().groupBy("source").agg(
            F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("changed").alias("last_modified"), F.max("batch_number").alias("last_run")
        )
