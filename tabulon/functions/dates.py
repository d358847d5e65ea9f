"""Dates, times and academic years in text, as Column expressions. Dates are ISO strings, not checked against the calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LEFT, latin_search_text, or_null

MONTHS = "jan feb mar apr maj jun jul avg sep okt nov dec".split()
ONE, FOUR = "[0-9]{1,2}", "[0-9]{4}"  # a day or month, a year
DOTTED = "[.]".join((ONE, ONE, FOUR, ""))
CENTURY = "20[0-9]{2}"
YEAR_RANGE = f"({CENTURY})\\s*[-/–]\\s*({CENTURY}|[0-9]{{2}})"
NUMERIC = "[.]".join((f"({ONE})", f"({ONE})", f"({FOUR})", ""))


def iso_date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))


def month_number(name: Column) -> Column:
    """By the first three letters, in either script; NULL for no month."""
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(latin_search_text(name), 1, 3))
    return F.when(at > 0, at.cast("int"))


def textual_date(c: Column) -> Column:
    """The first date such as "5. mart 2026"; NULL without one or for an unknown month."""
    pattern = f"({ONE})[.]\\s*(\\p{{L}}+)[.,]?\\s*({CENTURY})"
    part = [F.regexp_extract(c, pattern, k) for k in (1, 2, 3)]
    month = month_number(part[1])
    return F.when((part[0] != "") & month.isNotNull(), iso_date(part[2], month, part[0]))


def numeric_dates(c: Column) -> Column:
    """All dates such as "5.3.2026.", the last point included."""
    found = F.regexp_extract_all(c, F.lit(f"({DOTTED})"), 1)
    return F.transform(found, lambda d: iso_date(*(F.regexp_extract(d, NUMERIC, k) for k in (3, 2, 1))))


def period(c: Column) -> Column:
    """(od, do, raw): the range "od A. do B.", else the first and the last date."""
    pattern = f"{LEFT}od\\s+({DOTTED})\\s*do\\s+({DOTTED})"
    folded, dates = latin_search_text(c), numeric_dates(c)
    ends = [numeric_dates(F.regexp_extract(folded, pattern, k)) for k in (1, 2)]
    ranged = F.size(ends[0]) > 0
    return F.struct(F.when(ranged, F.get(ends[0], F.lit(0))).otherwise(F.get(dates, F.lit(0))).alias("od"), F.when(ranged, F.get(ends[1], F.lit(0))).otherwise(F.try_element_at(dates, F.lit(-1))).alias("do"), c.alias("raw"))


def parse_time(c: Column) -> Column:
    """Hours with two digits and minutes; seconds go, NULL stays."""
    part = F.split(or_null(c), ":")
    return F.concat(F.lpad(F.get(part, F.lit(0)), F.greatest(F.length(F.get(part, F.lit(0))), F.lit(2)), "0"), F.lit(":"), F.get(part, F.lit(1)))


def _span(c: Column) -> Column:
    start = F.regexp_extract(c, YEAR_RANGE, 1)
    end = F.regexp_extract(c, YEAR_RANGE, 2)
    whole = F.when(F.length(end) == 2, F.concat(F.lit("20"), end)).otherwise(end)
    return F.when(whole.try_cast("int") == start.try_cast("int") + 1, F.concat_ws("/", start, whole))


def academic_year(c: Column) -> Column:
    """The first range of years as "2025/2026"; NULL if it isn't two years that follow each other."""
    return _span(c)


def academic_years(c: Column) -> Column:
    """All valid academic years, each once, in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({YEAR_RANGE})"), 1), _span)
    return F.array_distinct(F.array_compact(found))


def calendar_years(c: Column) -> Column:
    """All years outside academic ranges, each once, in order."""
    rest = F.regexp_replace(c, YEAR_RANGE, " ")
    return F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(f"(?<![0-9])({CENTURY})(?![0-9])"), 1), lambda y: y.cast("int")))


def academic_year_of(day: Column) -> Column:
    """The academic year of a date: it begins in October."""
    start = F.year(day) - F.when(F.month(day) >= 10, 0).otherwise(1)
    return F.concat_ws("/", start.cast("string"), (start + 1).cast("string"))


def window_of(academic: Column) -> Column:
    """(first, last) day of an academic year."""
    start = F.substring(academic, 1, 4).cast("int")
    return F.struct(F.concat(start.cast("string"), F.lit("-10-01")).alias("first"), F.concat((start + 1).cast("string"), F.lit("-09-30")).alias("last"))


def belongs_to_year(text: Column, published: Column, academic: str) -> Column:
    """Whether academic years in text name this one; without any, whether the day of publication lies in it."""
    years, w = academic_years(text), window_of(F.lit(academic))
    return F.when(F.size(years) > 0, F.array_contains(years, academic)).otherwise(published.between(w["first"], w["last"]))


def require_academic_year(value: str | None) -> str:
    """value, if it is an academic year such as 2025/2026."""
    start, _, end = (value or "").partition("/")
    if not (len(start) == len(end) == 4 and start.isdecimal() and end.isdecimal() and int(end) == int(start) + 1):
        raise ValueError(f"not an academic year: {value!r}")
    return value


def study_year(level: Column, semester: Column) -> Column:
    return F.when(level == "master_akademske", 1).otherwise(F.ceil(semester / 2).cast("int"))
