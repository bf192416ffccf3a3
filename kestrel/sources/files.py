"""Readers and writers: CSV variants, nested JSON, landed partitions, parameters.

Fetching (HTTP, APIs, archives, git) is a landing step outside the engine; these
functions read what has landed, with declared schemas.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, FloatType, NumericType, StructType

from kestrel.functions.numbers import finite


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, encoding: str = "UTF-8", sep: str = ",",
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """CSV with a header; a byte-order mark is dropped, NaN becomes null."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", encoding)
        .option("sep", sep)
        .option("mode", mode)
        .option("enforceSchema", True)
        .csv(path)
    )
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value in the sources; aggregates must not see it."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.withColumns({c: finite(F.col(f"`{c}`")) for c in floats}) if floats else df


def read_records(
    spark: SparkSession, path: str, schema: StructType | str, record: str | None = None, meta: Iterable[str] = (),
    recursive: bool = True, key: str | None = None,
) -> DataFrame:
    """JSON array files, one row per element - or per element of the list ``record``, carrying ``meta``.

    ``key`` names a column for the file's stem as a number (sources that keep an id only
    in the file name).  Nested fields are flattened to ``a.b`` names.
    """
    df = (
        spark.read.schema(schema)
        .option("multiLine", True)
        .option("recursiveFileLookup", recursive)
        .option("pathGlobFilter", "*.json")
        .json(path)
    )
    extra = []
    if key:
        stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
        df = df.withColumn(key, stem.try_cast("long"))
        extra = [key]
    if record:
        df = df.select(*extra, *meta, F.explode(record).alias("__r")).select(*extra, *meta, "__r.*")
    return flatten(df)


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as columns named ``outer.inner``, to any depth; lists stay lists."""

    def walk(schema: StructType, prefix: tuple[str, ...]):
        for f in schema:
            if isinstance(f.dataType, StructType):
                yield from walk(f.dataType, (*prefix, f.name))
            else:
                yield (*prefix, f.name)

    return df.select(
        *(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in walk(df.schema, ()))
    )


def union_landed(parts: dict[str, DataFrame], column: str) -> DataFrame:
    """UNION ALL of parts that may lack columns, each tagged with its name; absent parts are simply not given."""
    if not parts:
        raise ValueError("nothing has landed")
    tagged = [df.withColumn(column, F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def write_csv(df: DataFrame, path: str, bom: bool = False, decimal_comma: bool = False) -> None:
    """CSV with a header.  ``decimal_comma`` writes numbers as "1,5" (fields then separated by ``;``).

    ``bom`` names the first column with a leading byte-order mark, as spreadsheet tools expect.
    """
    if decimal_comma:
        fractional = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType, DecimalType))]
        df = df.withColumns({c: F.translate(F.col(f"`{c}`").cast("string"), ".", ",") for c in fractional})
    if bom:
        first = df.columns[0]
        df = df.withColumnRenamed(first, "﻿" + first)
    df.write.mode("overwrite").option("header", True).option("sep", ";" if decimal_comma else ",").csv(path)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Read-modify-overwrite of one path: the new version is written beside it, then takes its place."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, now, old = (fs_path(path + end) for end in (".new", "", ".old"))
    fs = now.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(now) and fs.exists(old):  # a run that died between the two renames
        fs.rename(old, now)
    fs.delete(new, True)
    df.write.parquet(path + ".new")
    fs.delete(old, True)
    if fs.exists(now):
        fs.rename(now, old)
    if not fs.rename(new, now):
        raise OSError(f"{path} could not be replaced; its last version is in {path}.old")
    fs.delete(old, True)
    return spark.read.parquet(path)


def write_params(spark: SparkSession, params: dict, path: str) -> None:
    """Parameters as one JSON document, on any store Spark reads."""
    spark.createDataFrame([(json.dumps(params, ensure_ascii=False),)], "value string").coalesce(1).write.mode(
        "overwrite"
    ).text(path)


def read_params(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def freshness(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Newest modification time and bytes of the files under ``path``."""
    files = spark.read.format(fmt).load(path).select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    return files.agg(
        F.max("file_modification_time").alias("last_modified"), F.count(F.lit(1)).alias("files"), F.sum("file_size").alias("bytes")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
