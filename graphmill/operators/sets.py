"""Set operations on arrays, tables and page ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.partitioning import dealt


def ordered_union(*lists: Column) -> Column:
    """Distinct elements of the lists, first occurrence first, nulls and blanks left out."""
    return F.array_distinct(F.filter(F.flatten(F.array(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists))), lambda x: x.isNotNull() & (F.trim(x) != "")))


def known_union(known: list[str], *lists: Column) -> Column:
    """The same, of known elements only."""
    return F.filter(ordered_union(*lists), lambda x: x.isin(known))


def difference(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """key, side: keys of one table that the other lacks."""
    missing = expected.select(key).distinct().join(actual.select(key), key, "left_anti").withColumn("side", F.lit("missing"))
    extra = actual.select(key).distinct().join(expected.select(key), key, "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def merged_ranges(ranges: DataFrame, key: str, start: str = "start", end: str = "end") -> DataFrame:
    """Unions of ranges that overlap or touch (next start <= end + 1), by gaps and islands.

    One sort serves both windows: rows that open an island stay first among equal ones.
    """
    own = Window.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)
    island = F.sum("_opens").over(own.rowsBetween(Window.unboundedPreceding, 0))
    rows = dealt(ranges.select(key, start, end), key)
    return rows.withColumn("_opens", opens).withColumn("_island", island).groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def pending_ranges(done: DataFrame, totals: DataFrame, key: str, total: str = "total", start: str = "start", end: str = "end") -> DataFrame:
    """What of 1..total the done ranges leave open; done as merged_ranges() gives it, so no two touch.  One row a key in totals."""
    own = Window.partitionBy(key).orderBy(start)
    rows = totals.select(key, total).join(done, key, "left")
    gap = lambda low, high: F.struct(low.cast("long").alias(start), high.cast("long").alias(end))
    before = gap(F.coalesce(F.lag(end).over(own), F.lit(0)) + 1, F.coalesce(F.col(start) - 1, F.col(total)))
    after = gap(F.max(end).over(own.rowsBetween(Window.unboundedPreceding, 0)) + 1, F.col(total))
    is_last = F.lead(F.lit(True)).over(own).isNull()
    rows = rows.select(key, F.when(is_last, F.array(before, after)).otherwise(F.array(before)).alias("_gaps"))
    return rows.select(key, F.explode("_gaps").alias("_gap")).select(key, "_gap.*").where(F.col(start) <= F.col(end))
