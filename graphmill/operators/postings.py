"""A stored full-text index: postings in blocks with bounds, ranked by BM25, kept up to date by segments.

An index is a folder of segments, each written once.  A segment holds its documents with their term counts (forward), the
postings by term, and what it changes in the terms' document frequencies and in the number and length of documents.
Adding documents writes a segment of them; removing writes one of tombstones with negative changes, read off the forward
rows of these documents alone.  Nothing is rebuilt: postings hold counts and lengths, and weights are computed when a
query is known.

A block is the postings of one term for one cell, a hash range of documents that is the same for all terms, with its
largest count and smallest length.  For a query, a cell's bound is the sum over its terms of the highest weight that
these allow.  The documents of the cells with the highest bounds are scored first; the k-th best of them is a score that
the result reaches at least, so cells with a lower bound are skipped unread, exactly.

Blocks lie in folders by a hash of their term, so a scan reads the folders of the query's terms.  A common term is one
row a cell, never one row.  Ids may have any plain type.  A document without terms is counted, at length 0.  A document
that is added again while it is there counts twice; remove it first.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.workspace import checkpointed

#: Documents of a cell, about, and folders of postings.
CELL, BUCKETS = 128, 64
K1, B = 1.2, 0.75
#: Cells that are scored first for a query, for each of its k results.
FIRST = 1
#: Scores are rounded; a cell whose bound is within this of the k-th score may tie with it.
DIGITS = 4


def _bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def segments(self) -> list[dict]:
        """name, kind and cells of the segments, in order of writing; a few rows."""
        rows = self.spark.read.schema("at int, name string, kind string, cells int").parquet(f"{self.path}/segments").orderBy("at").collect()
        return [r.asDict() for r in rows]

    def read(self, name: str, part: str) -> DataFrame:
        """A part of a segment; partitioned parts may have no files, so their schema is given."""
        reader = self.spark.read
        if part == "terms":
            reader = reader.schema("term string, df long, bucket int")
        if part == "postings":
            kind = self.read(name, "forward").schema["doc_id"].dataType.simpleString()
            reader = reader.schema(f"term string, cell int, max_tf long, min_len long, docs array<struct<doc_id: {kind}, tf: long, len: long>>, bucket int")
        return reader.parquet(f"{self.path}/{name}/{part}")

    def _gathered(self, part: str, *kinds: str) -> DataFrame | None:
        out = None
        for s in self.segments():
            if s["kind"] in kinds:
                rows = self.read(s["name"], part).withColumn("at", F.lit(s["at"]))
                out = rows if out is None else out.unionByName(rows)
        return out

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (doc_id, at) without those that a later segment removed."""
        gone = self._gathered("removed", "removed")
        if gone is None:
            return rows
        last = gone.groupBy("doc_id").agg(F.max("at").alias("_gone"))
        return rows.join(last, "doc_id", "left").where("_gone IS NULL OR _gone < at").drop("_gone")


def _register(index: Index, name: str, kind: str, cells: int, at: int) -> None:
    index.spark.createDataFrame([(at, name, kind, cells)], "at int, name string, kind string, cells int").coalesce(1).write.mode("append").parquet(f"{index.path}/segments")


def create(spark: SparkSession, path: str) -> Index:
    spark.createDataFrame([], "at int, name string, kind string, cells int").write.parquet(f"{path}/segments")
    return Index(spark, path)


def add(index: Index, docs: DataFrame) -> None:
    """Adds documents (doc_id, terms: an array with repeats)."""
    name, at = f"segment-{uuid.uuid4().hex}", len(index.segments())
    terms = F.coalesce("terms", F.array().cast("array<string>"))
    # Counts by the places where the sorted terms change: a document's terms are one row's work, in one pass.
    forward = docs.select("doc_id", F.size(terms).cast("long").alias("len"), F.sort_array(terms).alias("_all"))
    start = F.filter(F.transform("_all", lambda t, i: i), lambda i: (i == 0) | ~F.get("_all", i - 1).eqNullSafe(F.get("_all", i)))
    forward = forward.withColumn("_start", start)
    counts = F.transform("_start", lambda s, k: F.struct(F.get("_all", s).alias("term"), (F.coalesce(F.get("_start", k + 1).cast("long"), F.col("len")) - s).alias("tf")))
    forward.select("doc_id", "len", counts.alias("counts")).write.parquet(f"{index.path}/{name}/forward")
    rows = index.read(name, "forward")
    cells = max(1, -(-rows.count() // CELL))
    cell = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(cells)).cast("int")
    postings = rows.select("doc_id", "len", cell.alias("cell"), F.explode("counts").alias("c")).groupBy("c.term", "cell")
    blocks = postings.agg(F.max("c.tf").alias("max_tf"), F.min("len").alias("min_len"), F.collect_list(F.struct("doc_id", "c.tf", "len")).alias("docs"))
    # A block's row stands in the folder of its term; a folder's rows are in order of their terms, so files skip by them.
    shuffles = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    placed = blocks.withColumn("bucket", _bucket()).repartition(shuffles, "bucket", F.pmod("cell", F.lit(max(1, shuffles // BUCKETS)))).sortWithinPartitions("bucket", "term")
    placed.write.partitionBy("bucket").parquet(f"{index.path}/{name}/postings")
    _changes(index, name, rows, 1)
    _register(index, name, "added", cells, at)


def _changes(index: Index, name: str, forward: DataFrame, sign: int) -> None:
    terms = forward.select(F.explode("counts.term").alias("term")).groupBy("term").agg((F.count("*") * sign).alias("df"))
    terms.withColumn("bucket", _bucket()).write.partitionBy("bucket").parquet(f"{index.path}/{name}/terms")
    totals = forward.agg((F.count("*") * sign).alias("n"), (F.coalesce(F.sum("len"), F.lit(0)) * sign).alias("total"))
    totals.write.parquet(f"{index.path}/{name}/totals")


def remove(index: Index, ids: DataFrame) -> None:
    """Removes the documents with these ids (doc_id); unknown ones are ignored."""
    forward = index._gathered("forward", "added")
    if forward is None:
        return
    name, at = f"segment-{uuid.uuid4().hex}", len(index.segments())
    gone = checkpointed(index._alive(forward.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")))
    gone.select("doc_id").distinct().write.parquet(f"{index.path}/{name}/removed")
    _changes(index, name, gone, -1)
    _register(index, name, "removed", 0, at)


def _weight(tf: Column, length: Column) -> Column:
    return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg")))


def search(index: Index, queries: DataFrame, k: int, skipped: list | None = None) -> DataFrame:
    """query_id, doc_id, score, rank of the k best by BM25, ties to the smaller id.  queries: query_id, term, distinct.

    skipped, if given, gets one tuple: cells of the queries, cells whose documents were read.
    """
    spark = index.spark
    asked = checkpointed(queries.select("query_id", "term").distinct().withColumn("bucket", _bucket()))
    buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS
    added = [s for s in index.segments() if s["kind"] == "added"]
    if not added or not buckets:
        kind = queries.schema["query_id"].dataType.simpleString()
        return spark.createDataFrame([], f"query_id {kind}, doc_id long, score double, rank int")
    totals = index._gathered("totals", "added", "removed").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    corpus = totals.select("n", (F.col("total") / F.col("n")).alias("avg")).first()
    df = index._gathered("terms", "added", "removed").where(F.col("bucket").isin(buckets)).join(asked.select("term").distinct(), "term", "left_semi")
    df = df.groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log(1 + (F.lit(corpus["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = checkpointed(asked.join(df, "term").select("query_id", "term", idf.alias("idf"), F.lit(corpus["avg"]).cast("double").alias("avg")))

    postings = None
    for s in added:
        own = index.read(s["name"], "postings").where(F.col("bucket").isin(buckets)).withColumn("at", F.lit(s["at"]))
        postings = own if postings is None else postings.unionByName(own)
    bounds = postings.select("at", "cell", "term", "max_tf", "min_len").join(terms, "term")
    bounds = checkpointed(bounds.groupBy("query_id", "at", "cell").agg(F.sum(_weight(F.col("max_tf"), F.col("min_len"))).alias("bound")))

    def scored(cells: DataFrame) -> DataFrame:
        """query_id, doc_id, at, score of all documents of the cells (query_id, at, cell)."""
        wanted = cells.join(terms, "query_id")
        docs = postings.join(wanted, ["at", "cell", "term"]).select("query_id", "at", "idf", "avg", F.explode("docs").alias("d"))
        rows = docs.select("query_id", "at", F.col("d.doc_id").alias("doc_id"), _weight(F.col("d.tf"), F.col("d.len")).alias("_w"))
        return index._alive(rows.groupBy("query_id", "at", "doc_id").agg(F.round(F.sum("_w"), DIGITS).alias("score")))

    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "at", "cell")
    ranked = bounds.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= max(1, FIRST * k))
    first = checkpointed(scored(ranked.select("query_id", "at", "cell")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    least = first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k).select("query_id", F.col("score").alias("_least"))
    rest = bounds.join(ranked.select("query_id", "at", "cell"), ["query_id", "at", "cell"], "left_anti").join(least, "query_id", "left")
    rest = checkpointed(rest.where(F.col("_least").isNull() | (F.col("bound") >= F.col("_least") - 10.0**-DIGITS)).select("query_id", "at", "cell"))
    if skipped is not None:
        skipped.append((bounds.count(), rest.count() + ranked.count()))
    out = first.unionByName(scored(rest)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "doc_id", "score", "rank")
