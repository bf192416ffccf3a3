"""Name normalisation as JVM expressions; string similarity with an Arrow-batched alignment."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Transliterations that canonical decomposition does not give.
LETTERS = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L",
    "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "þ": "th", "Þ": "Th", "ı": "i", "ħ": "h", "Ħ": "H",
}

# Club names and the short form that stands for them.
CLUB_SYNONYMS = {
    "manchester utd": "man united",
    "manchester united": "man united",
    "manchester city": "man city",
    "newcastle united": "newcastle",
    "newcastle utd": "newcastle",
    "tottenham hotspur": "tottenham",
    "west ham united": "west ham",
    "wolverhampton wanderers": "wolves",
    "sheffield utd": "sheffield united",
    "brighton hove albion": "brighton",
    "leicester city": "leicester",
    "norwich city": "norwich",
    "leeds united": "leeds",
    "nottingham forest": "nottm forest",
    "nott m forest": "nottm forest",
    "ipswich town": "ipswich",
    "luton town": "luton",
    "deportivo alaves": "alaves",
    "atletico madrid": "ath madrid",
    "athletic club": "ath bilbao",
    "athletic bilbao": "ath bilbao",
    "real betis": "betis",
    "celta vigo": "celta",
    "espanyol": "espanol",
    "rayo vallecano": "vallecano",
    "real sociedad": "sociedad",
    "cadiz": "cadiz",
    "almeria": "almeria",
    "leganes": "leganes",
    "paris saint germain": "paris sg",
    "paris s g": "paris sg",
    "saint etienne": "st etienne",
    "clermont foot": "clermont",
    "nimes": "nimes",
    "borussia monchengladbach": "mgladbach",
    "borussia m gladbach": "mgladbach",
    "gladbach": "mgladbach",
    "m gladbach": "mgladbach",
    "eintracht frankfurt": "ein frankfurt",
    "koln": "fc koln",
    "mainz 05": "mainz",
    "arminia bielefeld": "bielefeld",
    "arminia": "bielefeld",
    "hertha bsc": "hertha",
    "darmstadt 98": "darmstadt",
    "greuther furth": "greuther furth",
    "inter milan": "inter",
    "ac milan": "milan",
    "as roma": "roma",
    "hellas verona": "verona",
}

# Pairs of club names accepted as the same club when players are linked.
CLUB_ALIASES = {
    "gladbach": "borussia monchengladbach",
    "stade rennais": "rennes",
    "paris sg": "paris saint germain",
    "psg": "paris saint germain",
    "man united": "manchester united",
    "man city": "manchester city",
}


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Accented letters up to U+024F and U+1E00-1EFF with their base letters, from decomposition."""
    source, target = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            source.append(chr(code))
            target.append(base)
    return "".join(source), "".join(target)


def strip_accents(x: Column) -> Column:
    """Base letters; other letters stay, combining marks go."""
    return F.regexp_replace(F.translate(x, *_accents()), r"\p{Mn}", "")


def transliterate(x: Column) -> Column:
    """ASCII spelling: accents stripped and letters like ø, ß, ł spelt out; ASCII text is left alone."""
    source, target = _accents()
    single = {a: b for a, b in LETTERS.items() if len(b) == 1}
    y = F.translate(x, source + "".join(single), target + "".join(single.values()))
    for letter, ascii_ in LETTERS.items():
        if letter not in single:
            y = F.replace(y, F.lit(letter), F.lit(ascii_))
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.regexp_replace(y, r"\p{Mn}", "")).otherwise(x)


def squeeze(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def repair_mojibake(x: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again; any other text stays as it is."""
    bytes_ = F.encode(x, "ISO-8859-1")
    twice = x.rlike(r"^[\x00-\xFF]*$") & x.rlike(r"[\xC2-\xF4][\x80-\xBF]")
    return F.when(twice & F.is_valid_utf8(bytes_.cast("string")), F.decode(bytes_, "UTF-8")).otherwise(x)


def normalise_name(x: Column) -> Column:
    """Join key of a name: repaired, ASCII, lower case, letters, digits and single spaces."""
    ascii_ = F.when(x.rlike(r"[^\x00-\x7F]"), transliterate(repair_mojibake(x))).otherwise(x)
    return F.trim(F.regexp_replace(F.lower(ascii_), r"[^a-z0-9]+", " "))


def clean_text(x: Column) -> Column:
    return F.trim(F.lower(transliterate(x)))


def clean_club(x: Column) -> Column:
    """Join key of a club: ASCII, lower case, no dots or apostrophes, dashes as spaces."""
    return squeeze(F.translate(F.regexp_replace(clean_text(x), r"[.'’]", ""), "-", " "))


def map_or_self(x: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """table[x], or ``default`` (x itself if not given); null stays null."""
    pairs = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))
    return F.when(x.isNotNull(), F.coalesce(F.try_element_at(pairs, x), x if default is None else default))


def contains_any(x: Column, keywords: list[str]) -> Column:
    """Whether lower-cased x holds any keyword; null counts as not."""
    low = F.lower(x)
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(low, F.lit(word.lower()))
    return F.coalesce(hit, F.lit(False))


def thousands(x: Column, sep: str = " ", unit: str = "") -> Column:
    """12345.6 -> "12 346" (half-even), with a unit behind."""
    return F.concat(F.replace(F.format_number(x, 0), F.lit(","), F.lit(sep)), F.lit(unit))


def per_cent(share: Column, digits: int = 2) -> Column:
    """0.1234 -> "12.34%"."""
    return F.when(share.isNotNull(), F.format_string(f"%.{digits}f%%", share.cast("double") * 100))


def strip_parentheses(x: Column) -> Column:
    return squeeze(F.regexp_replace(x, r"\([^)]*\)", " "))


def _indel(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if not a or not b:
        return 0.0 if a or b else 100.0
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:  # one machine operation a letter: row i is the bits of the alignment
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@lru_cache(maxsize=1)
def _indel_udf():
    @F.pandas_udf("double")
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_indel(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return udf


def indel_ratio(a: Column, b: Column) -> Column:
    """100 * 2 * LCS / (|a| + |b|); 100 for two empty strings, null for a null one.

    The longest common subsequence is found bit-parallel in an Arrow batch: as a JVM
    expression it takes nested folds over arrays, which are far slower.
    """
    return _indel_udf()(a, b)


def sorted_tokens(x: Column) -> Column:
    return F.array_sort(F.filter(F.split(x, r"\s+"), lambda t: t != ""))


def letter_mask(x: Column) -> Column:
    """64 bits: which of a-z occur, which occur twice or more, and which of twelve classes the other characters fall in.

    Two texts' masks differ in no more bits than letters must be put in or taken out to turn one into the other.
    """
    letters = F.split(x, "")
    again = F.array_distinct(F.filter(letters, lambda a: F.size(F.filter(letters, lambda b: b == a)) > 1))
    latin = lambda a: (a >= "a") & (a <= "z") & (F.octet_length(a) == 1)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    first = F.transform(F.array_distinct(F.filter(letters, lambda a: a != "")), lambda a: bit(F.when(latin(a), F.ascii(a) - 97).otherwise(52 + F.pmod(F.ascii(a), F.lit(12)))))
    second = F.transform(F.filter(again, latin), lambda a: bit(F.ascii(a) - 97 + 26))
    return F.aggregate(F.concat(first, second), F.lit(0).cast("long"), lambda m, b: m.bitwiseOR(b))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return indel_ratio(F.array_join(sorted_tokens(a), " "), F.array_join(sorted_tokens(b), " "))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best ratio among the common tokens and the common with either side's rest.

    100 if one token set holds the other (and they share any); 0 if either is empty.
    """
    ta, tb = F.array_distinct(sorted_tokens(a)), F.array_distinct(sorted_tokens(b))
    common, rest_a, rest_b = F.array_intersect(ta, tb), F.array_except(ta, tb), F.array_except(tb, ta)
    base = F.array_join(common, " ")
    with_a = F.array_join(F.concat(common, rest_a), " ")
    with_b = F.array_join(F.concat(common, rest_b), " ")
    n, na, nb = F.length(base), F.length(with_a), F.length(with_b)
    # base is a prefix of both, so its ratio with each needs no alignment.
    of_a, of_b = 200.0 * n / F.nullif(n + na, F.lit(0)), 200.0 * n / F.nullif(n + nb, F.lit(0))
    return (
        F.when((F.size(ta) == 0) | (F.size(tb) == 0), 0.0)
        .when((F.size(common) > 0) & ((F.size(rest_a) == 0) | (F.size(rest_b) == 0)), 100.0)
        .otherwise(F.greatest(indel_ratio(with_a, with_b), F.when(n > 0, F.greatest(of_a, of_b)).otherwise(0.0)))
    )
