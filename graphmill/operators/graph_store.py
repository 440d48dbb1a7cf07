"""A stored graph whose nodes and edges live as long as some document supports them.

A store is a folder of segments, each written once.  A segment holds the statements that it adds, in folders by a hash
of their document (forward), and by how much it changes the support of every node and edge.  Removing documents reads
the statements in these documents' folders only and writes a segment of tombstones with negative changes; so an edge or
a node that another document supports too stays, with what is left of its support, and one that none supports is gone.
Nothing else is read or rewritten, whatever the store's size.  compacted() makes one segment of all.

Seeds are nodes that stay without support, if `keep_seeds` says so.  A document that is added while it is there supports
twice; remove it first.  Statements without document, subject or object are left out; a null relation is an empty one.
Repeated statements each support.  An unknown document's removal changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.workspace import checkpointed

#: Folders of statements by document, and of changes by node or edge.
BUCKETS = 32
EDGE = ["src", "rel", "dst"]


def _bucket(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str

    def segments(self) -> list:
        """at, name, kind of each segment, in order; a few rows."""
        return self.spark.read.schema("at int, name string, kind string").parquet(f"{self.path}/segments").orderBy("at").collect()

    def part(self, name: str, *kinds: str) -> DataFrame | None:
        """One part of all segments of these kinds since the last clearing, with `at`."""
        out, segments = None, self.segments()
        start = max([s["at"] for s in segments if s["kind"] == "cleared"], default=-1)
        for s in segments:
            if s["at"] > start and s["kind"] in kinds:
                rows = self.spark.read.parquet(f"{self.path}/{s['name']}/{name}").withColumn("at", F.lit(s["at"]))
                out = rows if out is None else out.unionByName(rows)
        return out

    def statements(self, docs: DataFrame | None = None) -> DataFrame:
        """doc_id, chunk_id, src, rel, dst, confidence that are there; docs (doc_id): of these documents alone."""
        rows = self.part("forward", "added")
        if rows is None:
            return self.spark.createDataFrame([], "doc_id long, chunk_id long, src string, rel string, dst string, confidence double")
        if docs is not None:
            buckets = [r["b"] for r in docs.select(_bucket("doc_id").alias("b")).distinct().collect()]  # at most BUCKETS
            rows = rows.where(F.col("bucket").isin(buckets)).join(docs, "doc_id", "left_semi")
        gone = self.part("removed", "removed")
        if gone is not None:
            last = gone.groupBy("doc_id").agg(F.max("at").alias("_gone"))
            rows = rows.join(last, "doc_id", "left").where("_gone IS NULL OR _gone < at").drop("_gone")
        return rows.drop("at", "bucket")

    def changes(self, name: str, keys: list[str]) -> DataFrame:
        """keys, n: all changes of support."""
        rows = self.part(name, "added", "removed")
        if rows is None:
            return self.spark.createDataFrame([], ", ".join(f"{k} string" for k in keys) + ", n long")
        return rows.select(*keys, "n")

    def _support(self, name: str, keys: list[str]) -> DataFrame:
        return self.changes(name, keys).groupBy(*keys).agg(F.sum("n").alias("support")).where("support > 0")

    def edges(self) -> DataFrame:
        """src, rel, dst, support."""
        return self._support("edges", EDGE)

    def nodes(self, seeds: DataFrame | None = None) -> DataFrame:
        """id, support, seed; seeds (id) stay at support 0."""
        own = self._support("nodes", ["id"])
        if seeds is None:
            return own.withColumn("seed", F.lit(False))
        marked = seeds.select("id").distinct().withColumn("_seed", F.lit(True))
        return own.join(marked, "id", "full").select("id", F.coalesce("support", F.lit(0)).alias("support"), F.coalesce("_seed", F.lit(False)).alias("seed"))


def create(spark: SparkSession, path: str) -> Store:
    spark.createDataFrame([], "at int, name string, kind string").write.parquet(f"{path}/segments")
    return Store(spark, path)


def _register(store: Store, name: str, kind: str) -> None:
    at = len(store.segments())
    store.spark.createDataFrame([(at, name, kind)], "at int, name string, kind string").coalesce(1).write.mode("append").parquet(f"{store.path}/segments")


def _changes(store: Store, name: str, rows: DataFrame, sign: int) -> None:
    """A node's support counts the statements that it stands in, once each; an edge's those that say it."""
    rows.groupBy(*EDGE).agg((F.count("*") * sign).alias("n")).write.parquet(f"{store.path}/{name}/edges")
    ends = F.explode(F.array_distinct(F.array("src", "dst")))
    rows.select(ends.alias("id")).groupBy("id").agg((F.count("*") * sign).alias("n")).write.parquet(f"{store.path}/{name}/nodes")


def add(store: Store, triplets: DataFrame) -> None:
    """Adds statements (doc_id, chunk_id, subject, relation, object, confidence)."""
    name = f"segment-{uuid.uuid4().hex}"
    rows = triplets.where("doc_id IS NOT NULL AND subject IS NOT NULL AND object IS NOT NULL")
    rows = rows.select("doc_id", "chunk_id", F.col("subject").alias("src"), F.coalesce("relation", F.lit("")).alias("rel"), F.col("object").alias("dst"), "confidence")
    if rows.isEmpty():  # partitioned files of no rows have no schema
        return
    shuffles = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.withColumn("bucket", _bucket("doc_id")).repartition(shuffles, "bucket", F.pmod(F.xxhash64("doc_id", "chunk_id", "dst"), F.lit(max(1, shuffles // BUCKETS))))
    placed.write.partitionBy("bucket").parquet(f"{store.path}/{name}/forward")
    _changes(store, name, store.spark.read.parquet(f"{store.path}/{name}/forward"), 1)
    _register(store, name, "added")


def remove(store: Store, docs: DataFrame) -> None:
    """Removes documents (doc_id) with all that only they support."""
    name = f"segment-{uuid.uuid4().hex}"
    docs = checkpointed(docs.where("doc_id IS NOT NULL").select("doc_id").distinct())
    gone = checkpointed(store.statements(docs))
    gone.select("doc_id").distinct().write.parquet(f"{store.path}/{name}/removed")
    _changes(store, name, gone, -1)
    _register(store, name, "removed")


def clear(store: Store) -> None:
    """Removes all documents; seeds stay."""
    _register(store, f"segment-{uuid.uuid4().hex}", "cleared")


def compacted(store: Store, path: str) -> Store:
    """A store with one segment of what is there."""
    out = create(store.spark, path)
    add(out, store.statements().withColumnsRenamed({"src": "subject", "rel": "relation", "dst": "object"}))
    return out


def verified(store: Store, chunks: DataFrame | None = None) -> DataFrame:
    """problem, n: edges and nodes whose support is not what their statements give, edges without a node at an end, and
    statements whose chunk (doc_id, chunk_id) isn't there.  All zero in a store that is whole.

    Changes and statements meet once by edge; what an edge's statements give its ends, and these ends, then meet the
    changes of nodes once by node.  A row without id counts the edges that are off.
    """
    there, none = store.statements(), F.lit(0).cast("long")
    count = lambda when: F.when(when, 1).otherwise(0).cast("long")
    edges = store.changes("edges", EDGE).select(*EDGE, F.col("n").alias("support"), none.alias("said"))
    edges = edges.unionByName(there.select(*EDGE, none.alias("support"), F.lit(1).cast("long").alias("said")))
    edges = edges.groupBy(*EDGE).agg(F.greatest(F.sum("support"), none).alias("support"), F.sum("said").alias("said"))
    at = F.transform(F.array_distinct(F.array("src", "dst")), lambda i: F.struct(i.alias("id"), F.col("said"), count(F.col("support") > 0).alias("ends"), none.alias("off")))
    off = F.struct(F.lit(None).cast("string").alias("id"), none.alias("said"), none.alias("ends"), F.lit(1).cast("long").alias("off"))
    own = edges.select(F.inline(F.when(F.col("support") != F.col("said"), F.concat(at, F.array(off))).otherwise(at))).withColumn("support", none)
    nodes = own.unionByName(store.changes("nodes", ["id"]).select("id", none.alias("said"), none.alias("ends"), none.alias("off"), F.col("n").alias("support")))
    nodes = nodes.groupBy("id").agg(F.greatest(F.sum("support"), none).alias("support"), *(F.sum(x).alias(x) for x in ("said", "ends", "off")))
    found = {
        "edges_support": F.sum("off"),
        "nodes_support": F.count_if(F.col("id").isNotNull() & (F.col("support") != F.col("said"))),
        "dangling_ends": F.sum(F.when(F.col("id").isNotNull() & (F.col("support") == 0), F.col("ends"))),
    }
    total = nodes.agg(*(F.coalesce(n, none).alias(problem) for problem, n in found.items()))
    out = total.select(F.inline(F.array(*(F.struct(F.lit(problem).alias("problem"), F.col(problem).alias("n")) for problem in found))))
    if chunks is None:
        return out
    lost = there.join(chunks.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_anti")
    return out.unionByName(lost.agg(F.count("*").alias("n")).select(F.lit("lost_chunks").alias("problem"), "n"))


def rebuilt(store: Store, triplets: DataFrame, docs: DataFrame | None = None, dry: bool = False) -> DataFrame:
    """store, before, after: counts of documents, nodes and edges.

    Clears the store, or removes `docs` (doc_id) alone, and adds their statements of the triplets again.  dry: counts what
    is there and what would be added, and changes nothing.
    """

    def counts(own: Store) -> dict[str, int]:
        return {"documents": own.statements().select("doc_id").distinct().count(), "nodes": own.nodes().count(), "edges": own.edges().count()}

    before = counts(store)
    new = triplets if docs is None else triplets.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    if dry:
        ends = new.select(F.explode(F.array_distinct(F.array("subject", "object"))).alias("id")).distinct()
        after = {"documents": new.select("doc_id").distinct().count(), "nodes": ends.count(), "edges": new.select("subject", "relation", "object").distinct().count()}
    else:
        clear(store) if docs is None else remove(store, docs)
        add(store, new)
        after = counts(store)
    return store.spark.createDataFrame([(k, before[k], after[k]) for k in before], "store string, before long, after long")
