"""Dates and years from codes, names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months and seasons by the names that sources use; a season stands for its first month.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10,
    "november": 11, "december": 12, "janvier": 1, "février": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6, "juillet": 7, "août": 8,
    "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12,
}
SEASONS = {"spring": 3, "summer": 6, "autumn": 9, "fall": 9, "winter": 12}


def date_of_code(code: Column) -> Column:
    """``YY-MMDD`` with an optional letter after it: years from 30 on are 19YY, others 20YY; an impossible date is null."""
    part = lambda i: F.regexp_extract(code, r"^(\d{2})-(\d{2})(\d{2})[A-Za-z]?$", i)
    year = F.concat(F.when(part(1) >= "30", "19").otherwise("20"), part(1))
    return F.when(part(1) != "", F.try_to_date(F.concat_ws("-", year, part(2), part(3)), "yyyy-MM-dd"))


def month_of(word: Column) -> Column:
    """Number of a month, or of the first month of a season; null for other words."""
    low = F.lower(F.trim(word))
    out = None
    for name, n in {**MONTHS, **SEASONS}.items():
        out = F.when(low == name, n) if out is None else out.when(low == name, n)
    return out.cast("int")


def month_range(text: Column) -> Column:
    """``March-April 1998``, ``Summer 1998``, ``March 1998`` or ``1998-03``: struct of year, first and last month."""
    two = r"(?i)^\s*(\p{L}+)\s*[-/]\s*(\p{L}+)\s+(\d{4})\s*$"
    one = r"(?i)^\s*(\p{L}+)\s+(\d{4})\s*$"
    iso = r"^\s*(\d{4})-(\d{2})\s*$"
    g = lambda p, i: F.regexp_extract(text, p, i)
    is_two, is_one, is_iso = g(two, 3) != "", g(one, 2) != "", g(iso, 1) != ""
    year = F.when(is_two, g(two, 3)).when(is_one, g(one, 2)).when(is_iso, g(iso, 1)).try_cast("int")
    first = F.when(is_two, month_of(g(two, 1))).when(is_one, month_of(g(one, 1))).when(is_iso, g(iso, 2).try_cast("int"))
    season = F.lower(g(one, 1)).isin(list(SEASONS))
    last = F.when(is_two, month_of(g(two, 2))).when(is_one & season, (first + 1) % 12 + 1).otherwise(first)
    good = year.isNotNull() & first.between(1, 12) & last.between(1, 12)
    return F.when(good, F.struct(year.alias("year"), first.alias("first"), last.cast("int").alias("last")))


def year_of_path(path: Column) -> Column:
    """The first part of a path that is a year from 1800 to 2200; else one that opens or ends the file name."""
    parts = F.split(path, r"[/\\]")
    folder = F.get(F.filter(parts, lambda x: x.rlike(r"^\d{4}$") & x.between("1800", "2200")), F.lit(0)).try_cast("int")
    name = F.element_at(parts, -1)
    found = F.coalesce(F.nullif(F.regexp_extract(name, r"^(\d{4})\D", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"\D(\d{4})(?:\.[A-Za-z0-9]+)?$", 1), F.lit(""))).try_cast("int")
    return F.coalesce(folder, F.when(found.between(1800, 2200), found))
