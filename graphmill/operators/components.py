"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.workspace import checkpointed


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst", most_rounds: int = 60) -> DataFrame:
    """node, component of every node of an undirected graph; component is the smallest node id.

    Each round joins edges with the smallest neighbour of their ends: a node's neighbours are reduced by a partial
    aggregate, never gathered, and the number of edges doesn't grow.  The smallest neighbours are a written table, so
    that Spark can split a node with very many edges when it joins them (skew join).  The number of rounds is
    logarithmic; it is an error if labels still change after most_rounds of them.  Self loops give their node a
    component of its own; edges with a null end are ignored; no edges, no rows.
    """
    both = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    loops = both.where(F.col("a") == F.col("b")).select(F.col("a").alias("node"))
    now = checkpointed(both.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        now = checkpointed(_small_star(_large_star(now)))
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    found = now.select(F.col("v").alias("node"), F.col("u").alias("component"))
    roots = now.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node"))
    out = found.unionByName(roots)
    alone = loops.distinct().join(out, "node", "left_anti").withColumn("component", F.col("node"))
    return out.unionByName(alone)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour y of a node x gets x's smallest neighbour (or x) in place of x."""
    both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
    least = checkpointed(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")))
    return edges.withColumnRenamed("u", "x").join(least, "x").select(F.col("m").alias("u"), "v").where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, get the smallest of them."""
    edges = checkpointed(edges)  # read by the two uses below
    least = checkpointed(edges.groupBy("v").agg(F.min("u").alias("m")))
    moved = edges.join(least, "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(least.select(F.col("m").alias("u"), "v")).distinct()
