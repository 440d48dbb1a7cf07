"""Tables of a data folder, and the retrieval and graph tables derived from them.

Each derived table is a function of a Catalog; the matching oracle text is in
`plans/oracle.py`.  Nothing is collected or cached here: a plan that reads one
derived table prunes and pushes down to the Parquet columns it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.partitioning import dealt


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


@dataclass(frozen=True)
class Catalog:
    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def chunks(self) -> DataFrame:
        """doc_id, sequence (from 1, over non-empty lines), content, n_chars, content_type, section.

        A line that ends in a colon or has at most 3 words is a title, one with a bar a table, else text.
        """
        lines = self.table("documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line", "content"))
        lines = lines.where(F.trim("content") != "")
        words = F.size(F.split("content", " "))
        kind = F.when(F.col("content").contains("|"), "table").when(words <= 3, "title").otherwise("text")
        return lines.select("doc_id", (F.col("line") + 1).alias("sequence"), "content", F.length("content").alias("n_chars"), kind.alias("content_type"), "source", "lang")

    def doc_terms(self) -> DataFrame:
        """doc_id, sequence, term: lower-case words of at least 4 Latin letters in each line, repeats kept."""
        words = F.regexp_extract_all(F.lower("content"), F.lit("[a-z]{4,}"), F.lit(0))
        return self.chunks().select("doc_id", "sequence", F.explode(words).alias("term"))

    def nodes(self) -> DataFrame:
        """id, label, name of the property graph."""

        def one(table: str, prefix: str, label: str, key: str, name: Column) -> DataFrame:
            return self.table(table).select(_key(prefix, key).alias("id"), F.lit(label).alias("label"), name.alias("name"))

        return (
            one("region", "region", "Region", "r_regionkey", F.col("r_name"))
            .unionByName(one("nation", "nation", "Nation", "n_nationkey", F.col("n_name")))
            .unionByName(one("customer", "customer", "Customer", "c_custkey", F.col("c_name")))
            .unionByName(one("supplier", "supplier", "Supplier", "s_suppkey", F.col("s_name")))
            .unionByName(one("part", "part", "Part", "p_partkey", F.col("p_name")))
            .unionByName(one("orders", "order", "Order", "o_orderkey", _key("order", "o_orderkey")))
        )

    def line_pairs(self, a: str, b: str) -> DataFrame:
        """Distinct pairs of two keys of the order lines."""
        lineitem = self.table("lineitem")
        return dealt(lineitem.select(a, b), a, b, scan=lineitem).distinct()

    def edges(self) -> DataFrame:
        """src, rel, dst of the property graph, distinct."""

        def one(rows: DataFrame, src: Column, rel: str, dst: Column) -> DataFrame:
            return rows.select(src.alias("src"), F.lit(rel).alias("rel"), dst.alias("dst"))

        nation, customer, supplier, orders = (self.table(t) for t in ("nation", "customer", "supplier", "orders"))
        pairs = self.line_pairs
        return (
            one(nation, _key("region", "n_regionkey"), "CONTAINS", _key("nation", "n_nationkey"))
            .unionByName(one(customer, _key("nation", "c_nationkey"), "CONTAINS", _key("customer", "c_custkey")))
            .unionByName(one(supplier, _key("nation", "s_nationkey"), "CONTAINS", _key("supplier", "s_suppkey")))
            .unionByName(one(orders, _key("customer", "o_custkey"), "PLACED", _key("order", "o_orderkey")))
            .unionByName(one(pairs("l_orderkey", "l_partkey"), _key("order", "l_orderkey"), "REQUIRES", _key("part", "l_partkey")))
            .unionByName(one(pairs("l_suppkey", "l_partkey"), _key("supplier", "l_suppkey"), "PROVIDES", _key("part", "l_partkey")))
        )

    def triplets(self) -> DataFrame:
        """subject, relation, object, confidence, chunk_id, doc_id: one for each line of an order."""
        relation = F.when(F.col("l_returnflag") == "R", "REQUIRES").when(F.col("l_returnflag") == "A", "CONTAINS").otherwise("RELATED_TO")
        return self.table("lineitem").select(
            _key("order", "l_orderkey").alias("subject"),
            relation.alias("relation"),
            _key("part", "l_partkey").alias("object"),
            F.round(1 - F.col("l_discount"), 2).alias("confidence"),
            F.col("l_linenumber").cast("long").alias("chunk_id"),
            F.col("l_suppkey").alias("doc_id"),
        )

    def tasks(self) -> DataFrame:
        """task_id, module, status, created_at, value, extra: progress events; a user is a task."""
        return self.table("events").select(
            F.col("user_id").alias("task_id"),
            F.concat(F.lit("m"), F.pmod("user_id", F.lit(4)).cast("string")).alias("module"),
            F.col("event_type").alias("status"),
            F.col("ts").alias("created_at"),
            "value",
            F.col("props").alias("extra"),
            "event_id",
        )

    def messages(self) -> DataFrame:
        """session_id, sequence, role, content."""
        return self.table("conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("sequence"), "role", F.col("text").alias("content"))

    def items(self) -> DataFrame:
        """entity_id, source, doc_id, score, coverage, snippet: what several retrievers might return for a query.

        Parts play the entities, suppliers the documents; discount and tax stand in for the scores.
        """
        return self.table("lineitem").select(
            _key("part", "l_partkey").alias("entity_id"),
            F.when(F.col("l_returnflag") == "R", "vector").when(F.col("l_returnflag") == "A", "text").otherwise("graph").alias("source"),
            F.col("l_suppkey").alias("doc_id"),
            F.round(1 - F.col("l_discount"), 2).alias("score"),
            F.round(F.col("l_tax"), 2).alias("coverage"),
            F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int")).alias("snippet"),
            F.col("l_orderkey").alias("pos"),
            F.col("l_linenumber").alias("page"),
        )
