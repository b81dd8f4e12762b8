"""Intervals: unions, and overlaps without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_intervals(rows: DataFrame, key: str) -> DataFrame:
    """key, start, stop of the unions of half-open intervals that overlap or touch."""
    order = Window.partitionBy(key).orderBy("start", "stop")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = rows.withColumn("new", (F.col("start") > F.coalesce(reach, F.col("start") - 1)).cast("int"))
    named = islands.withColumn("island", F.sum("new").over(order))
    return named.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def overlapping(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """key, a, b of intervals (key, id, start, stop) that overlap. Both sides are dealt to cells of ``width``, so the join is by equality; a pair is kept in the first cell that it shares."""
    cells = lambda r: r.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    a, b = cells(left.where("stop > start")).alias("a"), cells(right.where("stop > start")).alias("b")
    met = a.join(b, (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.start") < F.col("b.stop")) & (F.col("b.start") < F.col("a.stop")))
    first = F.floor(F.greatest("a.start", "b.start") / width)
    return met.where(F.col("a.cell") == first).select(F.col(f"a.{key}").alias(key), F.col("a.id").alias("a"), F.col("b.id").alias("b"))
