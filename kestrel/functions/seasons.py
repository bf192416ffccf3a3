"""Business seasons.  Every rule is one parameter: the month in which a season starts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

JULY, SEPTEMBER = 7, 9


def season_year(date: Column, start_month: int = JULY) -> Column:
    """First calendar year of the season that ``date`` falls in."""
    return F.year(date) - (F.month(date) < start_month).cast("int")


# Labels of the twelve months.
MONTHS = ("Jan", "Fév", "Mar", "Avr", "Mai", "Juin", "Juil", "Août", "Sep", "Oct", "Nov", "Déc")


def month_label(date: Column) -> Column:
    return F.element_at(F.array(*(F.lit(m) for m in MONTHS)), F.month(date))


def age_at(birth_year: Column, reference_year: Column | int) -> Column:
    """Full years by calendar year; the reference is given, never the clock's."""
    return (reference_year if isinstance(reference_year, Column) else F.lit(reference_year)) - birth_year


def season_label(year: Column) -> Column:
    """2020 -> "2020/2021"."""
    return F.concat_ws("/", year.cast("string"), (year + 1).cast("string"))


def season_from_code(code: Column) -> Column:
    """First year of "2021", "20/21" or "2020/2021"; null for anything else."""
    s = F.regexp_replace(F.trim(code.cast("string")), r"\.0$", "")
    return (
        F.when(s.rlike(r"^\d{4}$"), F.concat(F.lit("20"), s.substr(1, 2)))
        .when(s.rlike(r"^\d{2}/\d{2}$"), F.concat(F.lit("20"), s.substr(1, 2)))
        .when(s.rlike(r"^\d{4}/\d{2,4}$"), s.substr(1, 4))
        .cast("int")
    )


# Seasons (first year) with a continental cup, by confederation.
CONTINENTAL_SEASONS = {
    "CAF": (2020, 2022, 2024),
    "UEFA": (2020, 2023),
    "CONMEBOL": (2020, 2023),
    "CONCACAF": (2020, 2022, 2024),
    "AFC": (2022,),
    "OFC": (2023,),
}


def is_world_cup_season(year: Column) -> Column:
    return F.pmod(year + 1, F.lit(4)) == 2


def plays_international_cup(year: Column, confederation: Column) -> Column:
    """1 in a World-Cup season or one with a cup of the player's confederation, else 0."""
    cup = is_world_cup_season(year)
    for name, years in CONTINENTAL_SEASONS.items():
        cup = cup | ((confederation == name) & year.isin(*years))
    return F.coalesce(cup, F.lit(False)).cast("int")
