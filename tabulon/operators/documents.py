"""Candidates of the documentation listing to records: years, temporal scope, the manifest of a run, and sorted output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions.dates import academic_years, calendar_years


def candidate_years(title: Column, url: Column, summary: Column) -> Column:
    """(academic_year, calendar_year): the first academic year of the title, the last part of the URL, or the summary; and the title's first year outside academic ones."""
    slug = F.element_at(F.split(url, "/"), -1)
    first = [F.get(academic_years(F.coalesce(c, F.lit(""))), F.lit(0)) for c in (title, slug, summary)]
    return F.struct(F.coalesce(*first).alias("academic_year"), F.get(calendar_years(F.coalesce(title, F.lit(""))), F.lit(0)).alias("calendar_year"))


def worth_fetching(academic: Column, calendar: Column, wanted: str, this_year: int) -> Column:
    """Whether a candidate's own years allow it: no other academic year, and without one no other calendar year."""
    return F.when(academic.isNotNull(), academic == wanted).otherwise(F.coalesce(calendar == this_year, F.lit(True)))


def resolved_years(academic: Column, calendar: Column, body: Column, wanted: str, this_year: int) -> Column:
    """(keep, academic_year, calendar_year) after the body was read: a candidate without an academic year takes the wanted one if the body names it, and goes if the body names only others; one without any year does so with this year."""
    years, plain = academic_years(F.coalesce(body, F.lit(""))), calendar_years(F.coalesce(body, F.lit("")))
    by_academic = academic.isNull() & (F.size(years) > 0)
    drops_academic = by_academic & ~F.array_contains(years, wanted)
    new = F.when(by_academic, F.lit(wanted)).otherwise(academic)
    by_calendar = new.isNull() & calendar.isNull() & (F.size(plain) > 0)
    drops_calendar = by_calendar & ~F.array_contains(plain, this_year)
    return F.struct((~drops_academic & ~drops_calendar).alias("keep"), new.alias("academic_year"), F.when(by_calendar, F.lit(this_year)).otherwise(calendar).alias("calendar_year"))


def temporal_scope(academic: Column, calendar: Column) -> Column:
    """An empty year counts as none, and so does the year 0."""
    return F.when(F.coalesce(F.length(academic), F.lit(0)) > 0, "skolska_godina").when(F.coalesce(calendar, F.lit(0)) != 0, "kalendarska_godina").otherwise("opste")


def classified(df: DataFrame, labels: Column, name: str) -> DataFrame:
    """df with its labels; rows without any go."""
    return df.withColumn(name, labels).filter(F.size(name) > 0)


def collated(c: Column, locale: str = "sr") -> Column:
    """A key to sort by as the language does; letters of equal rank but for case or marks are told apart after all others."""
    return F.collate(c, locale)


def newest_first(published: str, title: str) -> list[Column]:
    return [F.desc(published), collated(F.col(title)).asc()]


def timetable_order(day: Column, days: list[str]) -> Column:
    """The place of a day among a timetable's columns, -1 for others."""
    return F.array_position(F.array(*map(F.lit, days)), day).cast("int") - 1


def manifest(results: DataFrame) -> DataFrame:
    """One row of results (url, file, entries, message): counts of successes and failures, what was written and what failed, in the order of URLs. A task that fails has a message and no file; it doesn't stop the others."""
    failed = F.col("message").isNotNull()
    ok = F.struct("url", "file", "entries")
    bad = F.struct("url", "message")
    return results.agg(
        F.count("*").alias("total"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"),
        F.array_sort(F.collect_list(F.when(~failed, ok))).alias("schedules"), F.array_sort(F.collect_list(F.when(failed, bad))).alias("failures"),
    )


def header_warnings(semester: Column, academic: Column, source_semester: Column, source_academic: Column) -> Column:
    """What a timetable's header says otherwise than its source; an array, empty if nothing."""
    one = F.when(semester.isNotNull() & (semester != source_semester), F.concat(F.lit("semester "), semester.cast("string"), F.lit(" in the header, "), source_semester.cast("string"), F.lit(" in the name")))
    two = F.when((F.length(academic) > 0) & (academic != source_academic), F.concat(F.lit("academic year "), academic, F.lit(" in the header, "), source_academic, F.lit(" expected")))
    return F.array_compact(F.array(one, two))


def contains_all(row: Column, wanted: Column) -> Column:
    """Whether a map of filters holds all entries of another."""
    return F.forall(F.map_entries(wanted), lambda e: F.coalesce(F.try_element_at(row, e["key"]) == e["value"], F.lit(False)))


def lookup(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal all values given; None asks for NULL."""
    for name, value in wanted.items():
        df = df.filter(F.col(name).eqNullSafe(F.lit(value)))
    return df


def user_message(question: Column) -> Column:
    return F.trim(F.coalesce(question, F.lit("")))


def output_name(kind: str, academic: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), F.replace(academic, F.lit("/"), F.lit("-")), F.lit(".json"))
