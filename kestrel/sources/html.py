"""Rows out of HTML that is already in a column; no Python, no parser library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_of(fragment: Column) -> Column:
    """Text of a fragment: tags out, common entities resolved, white space squeezed."""
    x = F.regexp_replace(fragment, r"<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def links(df: DataFrame, html_col: str, *keep: str) -> DataFrame:
    """(keep..., pos, href): every anchor's target in order of appearance."""
    found = F.regexp_extract_all(F.col(html_col), F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return df.select(*keep, F.posexplode(found).alias("pos", "href"))


def table_rows(df: DataFrame, html_col: str, *keep: str) -> DataFrame:
    """(keep..., row, cells): every table row as an array of cell texts."""
    rows = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    out = df.select(*keep, F.posexplode(rows).alias("row", "__tr"))
    cells = F.regexp_extract_all(F.col("__tr"), F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1))
    return out.withColumn("cells", F.transform(cells, text_of)).where(F.size("cells") > 0).drop("__tr")
