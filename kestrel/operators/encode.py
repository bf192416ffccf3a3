"""Encodings with an explicit, storable category list, so that a schema never depends on a split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions.text import map_or_self
from kestrel.operators.columns import c

# Country codes of each football confederation.
CONFEDERATIONS = {
    "UEFA": (
        "ALB", "ARM", "AUT", "BEL", "BIH", "BUL", "CRO", "CYP", "CZE", "DEN", "ENG", "ESP", "EST", "FIN", "FRA",
        "FRO", "GEO", "GER", "GRE", "HUN", "IRL", "ISL", "ISR", "ITA", "KVX", "LTU", "LUX", "LVA", "MDA", "MKD",
        "MLT", "MNE", "NED", "NIR", "NOR", "POL", "POR", "ROU", "RUS", "SCO", "SRB", "SUI", "SVK", "SVN", "SWE",
        "TUR", "UKR", "WAL",
    ),
    "CONMEBOL": ("ARG", "BOL", "BRA", "CHI", "COL", "ECU", "PAR", "PER", "URU", "VEN", "GUF", "SUR"),
    "CONCACAF": (
        "CAN", "CRC", "CUW", "DOM", "GLP", "GRN", "HAI", "HON", "JAM", "MEX", "MSR", "MTQ", "PAN", "PUR", "SKN", "USA",
    ),
    "CAF": (
        "ALG", "ANG", "BDI", "BEN", "BFA", "CGO", "CHA", "CIV", "CMR", "COD", "COM", "CPV", "CTA", "EGY", "EQG", "GAB",
        "GAM", "GHA", "GNB", "GUI", "KEN", "LBY", "MAD", "MAR", "MLI", "MOZ", "MTN", "NGA", "RSA", "SEN", "SLE", "TAN",
        "TOG", "TUN", "UGA", "ZAM", "ZIM",
    ),
    "AFC": ("AUS", "BAN", "CHN", "IDN", "IRN", "IRQ", "JOR", "JPN", "KOR", "KSA", "MAS", "PHI", "SYR", "UAE", "UZB"),
    "OFC": ("NCL", "NZL"),
}


def confederation(code: Column) -> Column:
    table = {k: name for name, codes in CONFEDERATIONS.items() for k in codes}
    return map_or_self(code, table, F.lit("Inconnu"))


def categories(df: DataFrame, name: str, most: int = 1000) -> list[str]:
    """Distinct values, sorted.  More than ``most`` is an error: such a column is no category."""
    found = [r[0] for r in df.select(c(name)).where(c(name).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{name} has more than {most} values")
    return sorted(found)


def one_hot(df: DataFrame, name: str, values: Sequence, prefix: str | None = None) -> DataFrame:
    """A 0/1 column per listed value; null and unlisted values are 0 everywhere."""
    p = name if prefix is None else prefix
    return df.withColumns({f"{p}_{v}": F.coalesce(c(name) == v, F.lit(False)).cast("int") for v in values})


def multi_label(df: DataFrame, name: str, labels: Sequence[str], prefix: str, sep: str = ",") -> DataFrame:
    """A 0/1 column per label of a separated list."""
    items = F.transform(F.split(c(name), sep), lambda x: F.trim(x))
    return df.withColumns(
        {f"{prefix}_{v}": F.coalesce(F.array_contains(items, v), F.lit(False)).cast("int") for v in labels}
    )


def rank_dummies(df: DataFrame, rank: str, most: int, prefix: str) -> DataFrame:
    return df.withColumns(
        {f"{prefix}_{i}": F.coalesce(c(rank) == i, F.lit(False)).cast("int") for i in range(1, most + 1)}
    )


def from_one_hot(columns: Sequence[str], prefix: str, otherwise: str | None = None) -> Column:
    """Name of the first column of a family that holds 1."""
    out = F.lit(otherwise).cast("string")
    for name in reversed(columns):
        out = F.when(c(name) == 1, name[len(prefix) + 1 :]).otherwise(out)
    return out
