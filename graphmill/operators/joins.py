"""Join shapes beyond a plain equi join.

A containment or range condition is given an equality to shuffle or broadcast on:
rule tables are broadcast (their size is that of the rules), ranges are dealt to
buckets of a fixed width.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.partitioning import dealt
from graphmill.workspace import checkpointed

#: Pairs that one task counts, about.
PAIRS = 1_000_000


def first_rule(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """Value of the first rule (keyword, value) whose keyword the text contains, case ignored."""
    upper = F.upper(text)
    out = F.lit(otherwise).cast("string")
    for keyword, value in reversed(rules):
        out = F.when(upper.contains(keyword.upper()), F.lit(value)).otherwise(out)
    return out


def without(rows: DataFrame, existing: DataFrame, keys: list[str], both_ways: tuple[str, str] | None = None) -> DataFrame:
    """Rows whose keys aren't in existing; both_ways names two key columns that may also be the other way round."""
    have = existing.select(*keys)
    if both_ways:
        a, b = both_ways
        have = have.unionByName(have.withColumnsRenamed({a: "_a"}).withColumnsRenamed({b: a}).withColumnsRenamed({"_a": b}).select(*keys))
    return rows.join(have, keys, "left_anti")


def common_neighbours(edges: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """a, b, common: nodes b that share at least `least` distinct neighbours with a node a of ids (column `a`)."""
    both = edges.select(F.col("src").alias("x"), F.col("dst").alias("y")).unionByName(edges.select(F.col("dst").alias("x"), F.col("src").alias("y"))).distinct()
    first = ids.join(both, ids["a"] == both["x"]).select("a", F.col("y").alias("mid"))
    second = both.select(F.col("x").alias("mid"), F.col("y").alias("b"))
    return first.join(second, "mid").where("a <> b").groupBy("a", "b").agg(F.countDistinct("mid").alias("common")).where(F.col("common") >= least)


def sharing_pairs(links: DataFrame, least: int, cell: int = 2048) -> DataFrame:
    """a, b, common: pairs a < b of nodes with at least `least` shared ones; links (node, shared) are distinct.

    Nodes with fewer links go first.  Then each node gets, for each of its shared ones, the list of those with more links
    there (among equals, the greater), and counts them where it is: lists are shuffled, not pairs, and a node of very
    many links stands in the lists of the others.  A shared one of more than `cell` nodes is dealt to cells, and each
    cell meets each cell.
    """
    links = links.where(F.col("shared").isNotNull())
    wide = links.groupBy("node").agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    kept = checkpointed(links.join(wide, "node"))
    sizes = checkpointed(kept.groupBy("shared").agg(F.count("*").alias("_n")).where("_n > 1"))
    hubs = F.broadcast(sizes.where(F.col("_n") > cell).select("shared", F.ceil(F.col("_n") / cell).cast("int").alias("_cells")))
    # Partitions by pairs, not by bytes: what a task's sums hold stays the same as the links grow.
    pairs = sizes.agg(F.coalesce(F.sum(F.col("_n") * (F.col("_n") - 1) / 2), F.lit(0.0)).alias("n")).first()["n"]
    parts = max(links.sparkSession.sparkContext.defaultParallelism, math.ceil(pairs / PAIRS))
    members = F.sort_array(F.collect_list(F.struct("_n", "node")))
    whole = dealt(kept.join(hubs, "shared", "left_anti"), "shared", scan=kept).groupBy("shared").agg(members["node"].alias("_all"))
    whole = whole.select(F.posexplode("_all").alias("_i", "a"), "_all").where(F.col("_i") + 1 < F.size("_all"))
    whole = whole.select("a", F.slice("_all", F.col("_i") + 2, F.size("_all")).alias("_bs"))
    cells = kept.join(hubs, "shared").withColumn("_y", F.pmod(F.xxhash64("node"), F.col("_cells")).cast("int"))
    cells = cells.groupBy("shared", "_y", "_cells").agg(members.alias("_all"))
    own = cells.select("shared", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)).alias("_y"), F.col("_all").alias("_as"))
    split = own.join(cells.select("shared", "_y", F.col("_all").alias("_bs")), ["shared", "_y"]).select(F.explode("_as").alias("_a"), "_bs")
    split = split.select(F.col("_a.node").alias("a"), F.filter("_bs", lambda b: b > F.col("_a"))["node"].alias("_bs")).where(F.size("_bs") > 0)
    met = whole.unionByName(split).repartition(parts, "a").select("a", F.explode("_bs").alias("b"))
    met = met.groupBy("a", "b").agg(F.count("*").alias("common")).where(F.col("common") >= least)
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, width: int) -> DataFrame:
    """Pairs of rows with equal keys whose positions lie at most `width` apart, right columns suffixed _r.

    Positions are dealt to buckets of the width; a right row stands in its own bucket and both beside it, so the join
    is an equi join on (keys, bucket) that does not gather a whole key.
    """
    lhs = left.withColumn("_bucket", F.floor(F.col(at) / width))
    rhs = right.withColumnsRenamed({c: f"{c}_r" for c in right.columns if c not in keys})
    rhs = rhs.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col(f"{at}_r") / width) + d for d in (-1, 0, 1)))))
    return lhs.join(rhs, [*keys, "_bucket"]).where(F.abs(F.col(at) - F.col(f"{at}_r")) <= width).drop("_bucket")


def overlapping(ranges: DataFrame, start: str, end: str, page: Column, window: int) -> DataFrame:
    """Rows whose range comes within `window` of a page."""
    return ranges.where((F.col(start) <= page + window) & (F.col(end) >= page - window))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row for each key: a partial max_by instead of a sort of the group."""
    newest = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_row.*")


def last_before(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> Column:
    """As-of link within one stream of rows: the value of the last row up to here that has one."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def containing(texts: DataFrame, words: DataFrame, keys: list[str], most: int = 4) -> DataFrame:
    """keys, text_id, word_id: texts (keys, text_id, text) and the words (keys, word_id, word) of the same keys in them.

    An equi join finds candidates: a word's first `most` characters, or all of a shorter one, are among a text's runs of
    that length.  The runs travel without the text, which only candidates meet again.  Words are not empty; a null text,
    word, key or id gives no row.
    """
    parts = [F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)) for n in range(1, most + 1)]
    places = texts.where("text IS NOT NULL").select(*keys, "text_id", F.explode(F.array_distinct(F.concat(*parts))).alias("_run"))
    starts = words.where("word <> ''").withColumn("_run", F.substring("word", 1, most)).distinct()
    near = places.join(starts, [*keys, "_run"]).select(*keys, "text_id", "word_id", "word")
    return near.join(texts, [*keys, "text_id"]).where(F.col("text").contains(F.col("word"))).select(*keys, "text_id", "word_id").distinct()
