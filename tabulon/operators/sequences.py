"""Folds over ordered rows as windows: runs, gap clusters, carried values, first seen, latest wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, by: list[str], order: list[str], value: str, first: str, last: str) -> DataFrame:
    """Rows that follow each other with the same value as one: (by.., value, run, started, ended, n)."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__new", new).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "run", value).agg(F.min(first).alias("started"), F.max(last).alias("ended"), F.count("*").alias("n"))


def gap_clusters(df: DataFrame, by: list[str], value: str, tolerance: float) -> DataFrame:
    """Values in order, cut where the gap is larger than the tolerance: (by.., cluster, mean, n). The mean is exact for decimals."""
    w = Window.partitionBy(*by).orderBy(value)
    new = F.when(F.col(value) - F.lag(value).over(w) > tolerance, 1).otherwise(0)
    marked = df.filter(F.col(value).isNotNull()).withColumn("__new", new).withColumn("cluster", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "cluster").agg((F.sum(value).cast("double") / F.count("*")).alias("mean"), F.count("*").alias("n"))


def carried(value: Column, by: list[str], order: list[str]) -> Column:
    """The last value that isn't NULL, up to this row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def first_seen(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key; NULL keys are a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """old with new rows put in: for each key the row of the latest order, but only where its content is another."""
    latest = first_seen(new, [key], [F.desc(order)])
    changed = latest.join(old.select(key, F.col(content).alias("__was")), key, "left").filter(~F.col("__was").eqNullSafe(F.col(content)) | F.col("__was").isNull()).drop("__was")
    return old.join(changed.select(key), key, "left_anti").unionByName(changed.select(old.columns))
