"""The activity calendar: lines are classified, then states are carried forward over the lines of a document.

Rules are tried in order and the first that applies counts; three apply in a state alone (holidays begun, an exam
period under way, none yet), which is the last event of its kind before the line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.functions.dates import numeric_dates, period
from tabulon.functions.text import latin_search_text, note_in_parens, slugify

NOTES = "|".join(("svecana dodela", "dodela indeksa", "upis godine", "pocetak nastave", "organizuje se nastava"))


def classified(lines: DataFrame) -> DataFrame:
    """lines (doc, ord, line) with kind, period_id (the ord of the line that opened the exam period) and sitting_id."""
    n = latin_search_text(F.col("line"))
    early = (
        F.when(n.contains("jesenji semestar") & n.contains("pocinje"), "autumn")
        .when(n.contains("prolecni semestar") & n.contains("pocinje"), "spring")
        .when(n.contains("raspust"), "recess").when(n.startswith("overa"), "certification").when(n.contains("je radna"), "working_day")
        .when(n.contains("drzavni praznici i neradni dani"), "holidays").when(n.rlike("^\\S+\\s+ispitni rok odrzava se\\s"), "exam_period")
    )
    so_far = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    events = lines.withColumns({"n": n, "early": early}).withColumns({
        "period_id": F.last(F.when(F.col("early") == "exam_period", F.col("ord")), ignorenulls=True).over(so_far),
        "in_holidays": F.coalesce(F.last(F.when(F.col("early") == "holidays", True).when(F.col("early").isin("working_day", "exam_period"), False), ignorenulls=True).over(so_far), F.lit(False)),
    })
    running = F.col("period_id").isNotNull()
    kind = (
        F.when(F.col("early").isNotNull(), F.col("early"))
        .when(running & F.col("n").rlike("^(prvo|drugo) polaganje"), "sitting").when(running & F.col("n").contains("prijava ispita"), "application")
        .when(F.col("in_holidays") & F.col("line").rlike("^[0-9]"), "holiday").when(~running & F.col("n").rlike(NOTES), "note")
    )
    inside = Window.partitionBy("doc", "period_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    told = events.withColumn("kind", kind)
    return told.withColumn("sitting_id", F.last(F.when(F.col("kind") == "sitting", F.col("ord")), ignorenulls=True).over(inside)).drop("early", "in_holidays")


def calendar_facts(lines: DataFrame) -> DataFrame:
    """One row for each line that says something: (doc, ord, kind, period, dates, note, period_id, sitting_id); an application belongs to the latest sitting of its exam period, else to the period."""
    c = F.col("line")
    note = F.when(F.col("kind") == "working_day", note_in_parens(c)).when(F.col("kind").isin("holiday", "note", "certification"), c)
    return classified(lines).filter("kind IS NOT NULL AND kind <> 'holidays'").select("doc", "ord", "kind", period(c).alias("period"), numeric_dates(c).alias("dates"), note.alias("note"), "period_id", "sitting_id")


def exam_periods(lines: DataFrame) -> DataFrame:
    """A row for each sitting of each exam period, or for the period where it has none: (doc, name, label, sitting, held_from, held_to, apply_from, apply_to)."""
    own = classified(lines).withColumn("p", period(F.col("line")))
    periods = own.filter("kind = 'exam_period'").select("doc", "period_id", F.split("line", "\\s+")[0].alias("label"), F.col("p.od").alias("p_from"), F.col("p.do").alias("p_to"))
    sittings = own.filter("kind = 'sitting'").select("doc", "period_id", "sitting_id", F.when(F.col("n").startswith("prvo"), "prvo_polaganje").otherwise("drugo_polaganje").alias("sitting"), F.col("p.od").alias("s_from"), F.col("p.do").alias("s_to"))
    latest = Window.partitionBy("doc", "period_id", "sitting_id").orderBy(F.desc("ord"))
    applied = own.filter("kind = 'application'").withColumn("__r", F.row_number().over(latest)).filter("__r = 1").select("doc", "period_id", F.coalesce("sitting_id", F.lit(-1)).alias("at"), F.col("p.od").alias("apply_from"), F.col("p.do").alias("apply_to"))
    whole = periods.join(sittings, ["doc", "period_id"], "left").withColumn("at", F.coalesce("sitting_id", F.lit(-1)))
    return whole.join(applied, ["doc", "period_id", "at"], "left").select("doc", slugify(F.col("label")).alias("name"), "label", "sitting", F.coalesce("s_from", "p_from").alias("held_from"), F.coalesce("s_to", "p_to").alias("held_to"), "apply_from", "apply_to")


def completeness(lines: DataFrame) -> DataFrame:
    """(doc, missing): what a calendar must have and hasn't: exam periods, a semester, holidays."""
    seen = classified(lines).groupBy("doc").agg(F.collect_set("kind").alias("kinds"))
    lacks = lambda name, *kinds: F.when(~F.arrays_overlap("kinds", F.array(*map(F.lit, kinds))), F.lit(name))
    return seen.select("doc", F.array_compact(F.array(lacks("exam_periods", "exam_period"), lacks("semesters", "autumn", "spring"), lacks("holidays", "holiday"))).alias("missing"))


