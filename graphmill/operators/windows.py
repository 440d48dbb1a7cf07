"""Ordering, top-k, diversity and de-duplication by window functions.

Rank filters are written as row_number() <= k so that Spark keeps only k rows per
group before the shuffle (WindowGroupLimit), which is what makes a hot group cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row for each key, the first in order."""
    return top_per_group(rows, keys, order, 1, "_first").drop("_first")


def round_robin(rows: DataFrame, bucket: str, order: list[Column | str], limit: int, max_per_bucket: int | None = None, pinned: list | None = None) -> DataFrame:
    """`limit` rows dealt over buckets in turn, the fullest bucket first; rows of a bucket keep their order.

    Only the first `limit` rows of a bucket can be dealt, so no more leave their partition.  pinned: buckets that go
    before all others.
    """
    own = Window.partitionBy(bucket)
    sizes = rows.groupBy(bucket).agg(F.count("*").alias("_size"))
    heads = rows.withColumn("_turn", F.row_number().over(own.orderBy(*order))).where(F.col("_turn") <= min(limit, max_per_bucket or limit))
    ahead = [F.when(F.col(bucket).isin(pinned), 0).otherwise(1)] if pinned else []
    dealt = heads.join(sizes, bucket).orderBy("_turn", *ahead, F.desc("_size"), bucket).limit(limit)
    return dealt.drop("_size")


def capped_per_source(rows: DataFrame, keys: list[str], source: str, order: list[Column | str], least: int = 10, single: int = 100) -> DataFrame:
    """Per key, at most max(n // 2, least) rows a source if there are several sources, else `single`."""
    totals = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.countDistinct(source).alias("_sources"))
    cap = F.when(F.col("_sources") > 1, F.greatest(F.floor(F.col("_n") / 2), F.lit(least))).otherwise(F.lit(single))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, source).orderBy(*order)))
    return ranked.join(totals, keys).where(F.col("_rank") <= cap).drop("_n", "_sources", "_rank")


def carried(value: Column, keys: list[str], order: list[str]) -> Column:
    """The last non-null value up to and with the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def looked_back(value: Column, keys: list[str], order: list[str], most: int) -> Column:
    """The last non-null value among the `most` rows before the row."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-most, -1))


def renumbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "sequence") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def page(rows: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """Page `number` (from 1) of the rows in order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def layout(nodes: DataFrame, layer: str, order: list[str], width: int = 200, height: int = 150) -> DataFrame:
    """x, y of nodes: layers below one another, a layer's nodes side by side around 0."""
    own = Window.partitionBy(layer)
    i = F.row_number().over(own.orderBy(*order)) - 1
    return nodes.withColumns({"x": (-F.count("*").over(own) * width / 2 + i * width).cast("double"), "y": (F.col(layer) * height).cast("long")})


def running_sum(rows: DataFrame, keys: list[str], at: str, order: list[str], value: str, width: int) -> DataFrame:
    """The rows with `running`, the sum of value up to and with each row of its keys in order.

    at: a whole number that the order starts with.  Rows are summed within cells of `width` of its values and the cells'
    totals are carried over, so a task holds one cell of a key, or a key's totals.
    """
    celled = rows.withColumn("_cell", F.floor(F.col(at) / width))
    totals = celled.groupBy(*keys, "_cell").agg(F.sum(value).alias("_total"))
    carried = F.sum("_total").over(Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select(*keys, "_cell", F.coalesce(carried, F.lit(0)).alias("_carry"))
    own = F.sum(value).over(Window.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return celled.withColumn("_own", own).join(totals, [*keys, "_cell"]).withColumn("running", F.col("_carry") + F.col("_own")).drop("_cell", "_own", "_carry")


def keywords_by_length(words: Column, k: int = 8) -> Column:
    """Distinct words, longest first, equal lengths in order of appearance."""
    distinct = F.array_distinct(words)
    placed = F.transform(distinct, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w")))
    return F.slice(F.transform(F.array_sort(placed), lambda s: s["w"]), 1, k)


def bounded_selection(rows: DataFrame, keys: list[str], order: list[Column | str], size: str, most_rows: int, most_size: int) -> DataFrame:
    """Rows in order until there are most_rows or their sizes sum to more than most_size."""
    own = Window.partitionBy(*keys).orderBy(*order)
    cut = rows.withColumns({"_rank": F.row_number().over(own), "_sum": F.sum(size).over(own.rowsBetween(Window.unboundedPreceding, 0))})
    return cut.where((F.col("_rank") <= most_rows) & (F.col("_sum") <= most_size)).drop("_rank", "_sum")
