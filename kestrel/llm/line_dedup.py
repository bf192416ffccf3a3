"""Site-relative line dedup: drop lines that too large a share of a host's pages holds.

For every host: the pages holding a line, divided by the host's pages.  Lines above
``ratio`` are boilerplate, if more than one page holds them: a line of one page alone
repeats nothing.  Counts are partial aggregations over (host, line digest), so a host
with a third of all pages is spread over its lines.

A host has at most (lines per page) / ratio boilerplate lines, but hosts are not
bounded.  So the boilerplate table is broadcast only up to ``broadcast_rows`` rows,
which is counted; beyond that, pages are salted and joined by (host, salt).

Defined results: lines end at U+000A, and are compared with edge white space removed;
blank lines are neither counted nor dropped; a line counts once a page; a null host
is a host of its own; null text has no lines and stays null; an empty table gives none;
a share equal to the ratio stays (only above it is boilerplate); repeated rows are pages
of their own; null ids are answered; a very long text is one array of lines in its row;
other columns are carried along unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.storage import materialize

#: Spaces that edges lose, as in SQL's trim(text, chars).
EDGE = " \t\n\x0b\x0c\r"
RATIO, MIN_PAGES = 0.1, 2


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(EDGE))


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(_trimmed(line).cast("binary")))


def boilerplate(
    docs: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, min_pages: int = MIN_PAGES
) -> DataFrame:
    """(host, lines): each host's boilerplate lines, as digests."""
    host = F.col(host_col).cast("string").alias("host")
    text = F.col(text_col).cast("string")
    # Only trimmed non-blank lines, once a page.
    lines = F.array_distinct(F.filter(F.transform(F.split(text, "\n"), _trimmed), lambda x: x != ""))
    seen = docs.select(host, F.explode(lines).alias("line")).select("host", F.unhex(F.md5(F.col("line").cast("binary"))).alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    pages = docs.groupBy(host).agg(F.count(F.lit(1)).alias("pages")).withColumnRenamed("host", "__host")
    common = counts.join(pages, F.col("host").eqNullSafe(F.col("__host"))).where(F.col("n") > F.col("pages") * ratio)
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def clean(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_rows: int = 100_000,
    salts: int = 32,
) -> DataFrame:
    """``docs`` with __n_lines, __n_dropped and the text left as __kept."""
    found, _ = materialize(boilerplate(docs, host_col, text_col, ratio, min_pages), "boilerplate")
    size = found.agg(F.coalesce(F.sum(F.size("lines")), F.lit(0))).first()[0]
    same = F.col("__host").eqNullSafe(F.col("__own"))
    table = found.select(F.col("host").alias("__host"), F.col("lines").alias("__lines"))
    own = docs.withColumn("__own", F.col(host_col).cast("string"))
    if size <= broadcast_rows:
        joined = own.join(F.broadcast(table), same, "left")
    else:
        table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        own = own.withColumn("__pick", F.pmod(F.xxhash64(text_col), F.lit(salts)).cast("int"))
        joined = own.join(table, same & (F.col("__salt") == F.col("__pick")), "left").drop("__salt", "__pick")
    lines = F.split(F.col(text_col).cast("string"), "\n")
    # The page's own boilerplate by a hash of both lists, then a look-up in that short list.
    joined = joined.withColumn("__gone", F.array_intersect(F.transform(lines, _digest), "__lines"))
    kept = F.when(F.coalesce(F.size("__gone"), F.lit(0)) <= 0, lines).otherwise(
        F.filter(lines, lambda x: (_trimmed(x) == "") | ~F.array_contains("__gone", _digest(x)))
    )
    return (
        joined.withColumn("__left", kept)
        .withColumn("__n_lines", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long"))
        .withColumn("__n_dropped", F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines) - F.size("__left")).cast("long"))
        .withColumn("__kept", F.array_join("__left", "\n"))
        .drop("__left", "__lines", "__gone", "__host", "__own")
    )


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for every row of ``docs``; the host is ``source``."""
    return clean(docs.select("doc_id", "source", "text")).select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("__kept", F.lit("")), 256).alias("kept_sha256"),
    )
