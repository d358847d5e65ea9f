"""Range, containment, overlap and fuzzy joins. Range joins go by buckets of the range's width, so that they are hash joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def range_lookup(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: int) -> DataFrame:
    """Rows of points with each range that holds them, both ends included. A range lies in every bucket that it touches."""
    cell = lambda c: F.floor(F.col(c) / width)
    spread = ranges.filter(F.col(low) <= F.col(high)).withColumn("__cell", F.explode(F.sequence(cell(low), cell(high))))
    return points.withColumn("__cell", cell(at)).join(spread, "__cell").filter((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop("__cell")


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length of the common part of two intervals."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


#: Rows that one task sorts of a table, at any size of the whole.
PART_ROWS = 250_000


def parts(*tables: DataFrame) -> int:
    """How many parts of PART_ROWS rows the largest of the tables makes, one a core at least; 0 for tables that are one part. It counts the tables' rows."""
    n = max(t.count() for t in tables)
    return 0 if n <= PART_ROWS else max(tables[0].sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))


def by_parts(table: DataFrame, n: int, *by: str) -> DataFrame:
    """The table in n parts by its keys, as parts() gave them; the session's number of parts and its merging of small ones don't count. 0 leaves it."""
    return table.repartition(n, *by) if n else table


def best_overlap(rows: DataFrame, regions: DataFrame, by: list[str], key: str, share: float) -> DataFrame:
    """For each row (y0, y1) the region (r0, r1, rid) of the largest overlap, if it is more than the share of the row; the first of equal ones. Joined and ranked in parts of bounded size."""
    n = parts(rows, regions)
    amount = overlap(F.col("y0"), F.col("y1"), F.col("r0"), F.col("r1"))
    w = Window.partitionBy(*by, key).orderBy(F.desc("amount"), "rid")
    return by_parts(rows, n, *by).join(by_parts(regions, n, *by), by).withColumn("amount", amount).filter(F.col("amount") > share * (F.col("y1") - F.col("y0"))).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def region_at(points: DataFrame, regions: DataFrame, by: list[str], key: str) -> DataFrame:
    """For each point (x, y) the narrowest region (x0..y1, rid) that holds it, one unit to either side allowed; the first of equal ones."""
    inside = (F.col("x") >= F.col("x0") - 1) & (F.col("x") <= F.col("x1") + 1) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1"))
    w = Window.partitionBy(*by, key).orderBy(F.col("x1") - F.col("x0"), "rid")
    return points.join(regions, by).filter(inside).withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def snap_to_lexicon(names: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(name, snapped): the nearest entry (name, ord) of the lexicon by edit distance in upper case, among those with the same digits, if it is near enough (an eighth of its length, 1 at least); the first of equal ones. Blocked by digits and length."""
    d = lambda c: F.regexp_replace(c, "[^0-9]", "")
    left = names.select("name").distinct().withColumns({"__d": d(F.col("name")), "__u": F.upper("name")})
    right = lexicon.select(F.col("name").alias("candidate"), "ord").withColumns({"__d": d(F.col("candidate")), "__v": F.upper("candidate")})
    tolerance = F.greatest(F.lit(1), F.floor(F.length("candidate") / 8))
    near = left.join(right, "__d").filter(F.abs(F.length("__u") - F.length("__v")) <= tolerance).withColumn("distance", F.levenshtein("__u", "__v"))
    w = Window.partitionBy("name").orderBy("distance", "ord")
    best = near.withColumn("__r", F.row_number().over(w)).filter((F.col("__r") == 1) & (F.col("distance") <= tolerance)).select("name", F.col("candidate").alias("snapped"))
    return names.join(best, "name", "left").withColumn("snapped", F.coalesce("snapped", "name"))


def unify_names(entries: DataFrame, by: list[str]) -> DataFrame:
    """(by.., name, unified) from entries (by.., name, from_ocr, ord): each name becomes the heaviest one within a quarter of its length, 2 at least, that has the same digits and more weight. Read text weighs 10, recognised text 1. One step only: the name taken may itself become another."""
    d = lambda c: F.regexp_replace(c, "[^0-9]", "")
    weights = entries.groupBy(*by, "name").agg(F.sum(F.when(F.col("from_ocr"), 1).otherwise(10)).alias("weight"), F.min("ord").alias("ord")).withColumn("__d", d(F.col("name")))
    other = weights.select(*by, "__d", F.col("name").alias("unified"), F.col("weight").alias("__w"), F.col("ord").alias("__o"))
    tolerance = F.greatest(F.lit(2), F.floor(F.length("unified") * 0.25))
    near = weights.join(other, [*by, "__d"]).filter((F.col("__w") > F.col("weight")) & (F.abs(F.length("name") - F.length("unified")) <= tolerance) & (F.levenshtein(F.upper("name"), F.upper("unified")) <= tolerance))
    w = Window.partitionBy(*by, "name").orderBy(F.desc("__w"), "__o")
    best = near.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(*by, "name", "unified")
    return weights.select(*by, "name").join(best, [*by, "name"], "left").withColumn("unified", F.coalesce("unified", "name"))
