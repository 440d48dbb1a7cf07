"""Merging what several retrievers return for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from graphmill.partitioning import dealt


def merged_items(items: DataFrame, key: str = "entity_id", vector: str = "vector", text: str = "text") -> DataFrame:
    """One row an entity from rows (key, source, doc_id, score, coverage, snippet, pos, page); a null key merges with none.

    Base: the first item of the text source, else the first.  Score: the highest vector score if there is one, else the
    highest.  Coverage: the highest.  Snippet: the longest, ties to the smaller.  Citations: distinct (doc_id, page).
    """
    order = F.struct("pos", "page", "doc_id", "source")
    named = items.where(F.col(key).isNotNull())
    base = F.min_by("source", F.struct(F.when(F.col("source") == text, 0).otherwise(1).alias("t"), order.alias("o")))
    out = named.groupBy(key).agg(
        base.alias("base_source"),
        F.coalesce(F.max(F.when(F.col("source") == vector, F.col("score"))), F.max("score")).alias("score"),
        F.max("coverage").alias("coverage"),
        F.min_by("snippet", F.struct(-F.length("snippet"), F.col("snippet"))).alias("snippet"),
        F.count_distinct("doc_id", "page").alias("citations"),
        F.count("*").alias("merged"),
    )
    alone = items.where(F.col(key).isNull()).select(F.col(key), F.col("source").alias("base_source"), "score", "coverage", "snippet", F.lit(1).cast("long").alias("citations"), F.lit(1).cast("long").alias("merged"))
    return out.unionByName(alone)


#: What makes two edges, or two citations, one.
EDGE_KEY = ("type", "target")
CITATION_KEY = ("source", "chunk_id", "location", "page_number", "section", "image_url")


def merged_details(items: DataFrame, order: list[str], key: str = "entity_id", text: str = "text") -> DataFrame:
    """key, snippet, attrs, edges, citations: what the items of an entity have, put together.

    items: key, source, snippet, attrs (map), edges (array of type, target), citations (array with CITATION_KEY) and the
    columns of order.  The first item of the text source comes first, then the others in order.  Of an attribute the
    first value that isn't blank counts; edges are one by type and target, citations by their key, in order; the longest
    snippet counts, of equal ones the first.  A null key merges with none and is left out.

    Items are dealt once, by their key, in partitions by their number.  There each gets its place, and what it has is one
    row each: so equal ones are found by plain columns and the first place, a number.
    """
    own = Window.partitionBy(key).orderBy(*order)
    is_text = F.col("source") == text
    texts = F.count(F.when(is_text, 1)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = dealt(items.where(F.col(key).isNotNull()), key).withColumns({"_n": F.row_number().over(own), "_texts": texts})
    rows = rows.withColumn("_at", F.when(is_text & (F.col("_texts") == 1), 0).otherwise(F.col("_n")).cast("long"))

    def inner(name: str, fields: tuple[str, ...]) -> StructType:
        return StructType([StructField(f, items.schema[name].dataType.elementType[f].dataType) for f in fields])

    types = {"kind": "int", "k": "string", "v": "string", "edge": inner("edges", EDGE_KEY), "cite": inner("citations", CITATION_KEY)}

    def had(i: Column | int, **given: Column) -> Column:
        return F.struct(*(given.get(name, F.lit(None)).cast(t).alias(name) for name, t in types.items()), (F.col("_at") * 2**32 + i).alias("at"))

    def each(array: Column, one) -> Column:
        return F.coalesce(F.transform(array, one), F.array())

    told = F.concat(
        F.array(had(0, kind=F.lit(0), v=F.col("snippet"))),
        each(F.filter(F.map_entries("attrs"), lambda e: F.trim(e["value"]) != ""), lambda e: had(0, kind=F.lit(1), k=e["key"], v=e["value"])),
        each(F.col("edges"), lambda e, i: had(i, kind=F.lit(2), edge=F.struct(*(e[f].alias(f) for f in EDGE_KEY)))),
        each(F.col("citations"), lambda e, i: had(i, kind=F.lit(3), cite=F.struct(*(e[f].alias(f) for f in CITATION_KEY)))),
    )
    one = rows.select(key, F.inline(told)).groupBy(key, *types).agg(F.min("at").alias("at"))
    listed = lambda kind, *columns: F.collect_list(F.when(F.col("kind") == kind, F.struct(*columns)))
    out = one.groupBy(key).agg(
        F.min_by("v", F.when(F.col("kind") == 0, F.struct(-F.length(F.coalesce("v", F.lit(""))), "at"))).alias("snippet"),
        F.sort_array(listed(1, "k", "at", "v")).alias("_a"),
        F.sort_array(listed(2, "at", "edge")).alias("_e"),
        F.sort_array(listed(3, "at", "cite")).alias("_c"),
    )
    first = F.filter("_a", lambda x, i: ~x["k"].eqNullSafe(F.get("_a", i - 1)["k"]))
    some = lambda name, value: F.when(F.size(name) > 0, value)
    return out.select(
        key,
        "snippet",
        some("_a", F.map_from_entries(F.transform(first, lambda x: F.struct(x["k"], x["v"])))).alias("attrs"),
        some("_e", F.transform("_e", lambda x: x["edge"])).alias("edges"),
        some("_c", F.transform("_c", lambda x: x["cite"])).alias("citations"),
    )


def unified_hints(items: DataFrame, most: int = 20) -> DataFrame:
    """One row of sorted distinct values, cut: entities, documents, pages, sources.

    Each list is a top-k of distinct values, so no set of all values is gathered.
    """
    lists = None
    for name, column in (("entities", "entity_id"), ("documents", "doc_id"), ("pages", "page"), ("sources", "source")):
        top = items.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct().orderBy("v").limit(most)
        one = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list("v")), lambda v: v.cast("string")), ",").alias("values")).select(F.lit(name).alias("hint"), "values")
        lists = one if lists is None else lists.unionByName(one)
    return lists


def document_views(items: DataFrame, most: int = 6) -> DataFrame:
    """doc_id, n, pages, sources, highlights: the best `most` snippets, best score first."""
    own = Window.partitionBy("doc_id").orderBy(F.desc("score"), "pos", "page")
    top = items.withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= most)
    shown = top.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "snippet"))), lambda s: s["snippet"]), " | ").alias("highlights"))
    sets = items.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return sets.join(shown, "doc_id")


def api_citations(items: DataFrame, per_item: int = 3, most: int = 30) -> DataFrame:
    """Citations in order: images first, one a source document, at most per_item an entity."""
    image = F.when(F.col("source") == "graph", 0).otherwise(1)
    own = Window.partitionBy("entity_id").orderBy(image, F.desc("score"), "pos", "page")
    some = items.withColumns({"_k": F.row_number().over(own), "_image": image}).where(F.col("_k") <= per_item)
    one = some.withColumn("_d", F.row_number().over(Window.partitionBy("doc_id").orderBy("_image", F.desc("score"), "pos", "page"))).where("_d = 1")
    return one.orderBy("_image", F.desc("score"), "doc_id").limit(most).select("doc_id", "entity_id", "source", "score")


def node_citations(nodes: DataFrame, links: DataFrame, fallback: str, most: int = 3) -> DataFrame:
    """id, citations: the first `most` sources of a node, or the fallback.  links: id, source."""
    own = Window.partitionBy("id").orderBy("source")
    top = links.distinct().withColumn("_r", F.row_number().over(own)).where(F.col("_r") <= most).groupBy("id").agg(F.array_sort(F.collect_list("source")).alias("_s"))
    return nodes.select("id").join(top, "id", "left").select("id", F.array_join(F.coalesce("_s", F.array(F.lit(fallback))), ",").alias("citations"))


# Roles of documents by words of their names, best priority first; any other name is `other`.
ROLES = (
    ("guide", ("指南", "手册", "guide")),
    ("detail_atlas", ("详图", "图集", "详解")),
    ("code_spec", ("规范", "标准", "gb")),
    ("macro_atlas", ("资料",)),
)


def with_roles(docs: DataFrame, name: str = "name", roles=ROLES) -> DataFrame:
    """Documents with `role` and `priority` (0 is best) by the first role of which a word is in the name, case ignored."""
    low = F.lower(F.coalesce(name, F.lit("")))
    role, priority = F.lit("other"), F.lit(len(roles))
    for i, (label, words) in reversed(list(enumerate(roles))):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w.lower())
        role, priority = F.when(hit, label).otherwise(role), F.when(hit, i).otherwise(priority)
    return docs.withColumns({"role": role, "priority": priority})


def view_order(docs: DataFrame, keys: list[str], count: str = "n", tie: str = "doc_id") -> DataFrame:
    """Documents (keys, tie, count, role, priority) with their `place` among those of their keys.

    Of a role, the fullest come first; in a role of more than three the upper, middle and lower third by count take
    turns.  Then the roles take turns, best priority first.
    """
    own = Window.partitionBy(*keys, "priority", "role")
    rows = docs.withColumns({"_i": F.row_number().over(own.orderBy(F.desc(count), tie)) - 1, "_m": F.count("*").over(own)})
    one, two = F.floor(F.col("_m") / 3), F.floor(F.col("_m") * 2 / 3)
    third = F.when((F.col("_m") <= 3) | (F.col("_i") < one), 0).when(F.col("_i") < two, 1).otherwise(2)
    turn = F.col("_i") - F.when(F.col("_m") <= 3, 0).when(F.col("_i") < one, 0).when(F.col("_i") < two, one).otherwise(two)
    rows = rows.withColumns({"_third": third, "_turn": turn})
    rows = rows.withColumn("_at", F.row_number().over(own.orderBy("_turn", "_third")))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_at", "priority", "role"))
    return rows.withColumn("place", place).drop("_i", "_m", "_third", "_turn", "_at")
