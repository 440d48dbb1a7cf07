"""Vector search over inverted lists.

An index is a folder: the lists' centroids, and the vectors as Parquet partitioned by list_id.  The centroids are
trained by k-means on a bounded sample; every vector is then assigned to its nearest one and written to that list.
A search finds the nearest lists of each query by a matrix product with the centroids and reads those lists' folders
only: the scan has a partition filter.  With all lists probed the result is that of an exact search.

Queries up to BROADCAST (they are counted) go to all tasks of the scan, so no vector is shuffled; more are dealt to the
lists they probe, a large list being cut into parts of PART vectors.  Either way k rows a query and task are shuffled.

Null vectors, and those with another length than the first of the sample, are not indexed; ids need not be distinct.
A query without a vector, or with another length, has no hits.  An empty table gives an index without lists.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.operators.retrieval import best_places

BROADCAST = 5_000
#: Most lists, and most sampled vectors that train them.
LISTS, SAMPLE = 4096, 32_768
#: Vectors of a list that one task compares where queries are dealt to lists.
PART = 20_000
ITERATIONS = 12


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str

    def centroids(self) -> np.ndarray:
        """A row for each list; at most LISTS of them."""
        rows = self.spark.read.parquet(f"{self.path}/centroids").orderBy("list_id").collect()
        return np.array([r["centroid"] for r in rows]).reshape(len(rows), len(rows[0]["centroid"]) if rows else 0)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/vectors")

    def sizes(self) -> dict[int, int]:
        return {r["list_id"]: r["count"] for r in self.vectors().groupBy("list_id").count().collect()}


def means(points: np.ndarray, lists: int, seed: int = 7) -> np.ndarray:
    """k-means centroids by Lloyd's steps from centres drawn as k-means++ does; a centre that loses all points stays."""
    rng = np.random.default_rng(seed)
    centres = [points[rng.integers(len(points))]]
    near = ((points - centres[0]) ** 2).sum(1)
    while len(centres) < lists and near.max() > 0:
        centres.append(points[rng.choice(len(points), p=near / near.sum())])
        near = np.minimum(near, ((points - centres[-1]) ** 2).sum(1))
    out = np.array(centres)
    for _ in range(ITERATIONS):
        own = assigned(points, out)
        count = np.bincount(own, minlength=len(out))
        sums = np.zeros_like(out)
        np.add.at(sums, own, points)
        moved = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], out)
        if np.allclose(moved, out):
            break
        out = moved
    return out


def assigned(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each point by Euclidean distance, ties to the first."""
    return np.argmin(np.round((centres**2).sum(1)[None, :] - 2 * points @ centres.T, 10), 1)


def _assign(shared, columns: list[str]):
    def run(batches):
        centres = shared.value
        for batch in batches:
            batch = batch[[v is not None and len(v) == centres.shape[1] for v in batch["vector"]]]
            if len(batch):
                yield batch.assign(list_id=assigned(np.stack(batch["vector"]).astype(float), centres).astype(np.int32))[[*columns, "list_id"]]

    return run


def append(index: Index, vectors: DataFrame) -> None:
    """Adds vectors (id, vector and any other columns that the index has) to their lists."""
    spark, centres = index.spark, index.centroids()
    rows = vectors.where("vector IS NOT NULL")
    if not len(centres):
        return
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInPandas(_assign(spark.sparkContext.broadcast(centres), rows.columns), f"{schema}, list_id int")
    # A list is written by a few tasks, and a large one by more.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed.repartition(n, "list_id", F.pmod(F.xxhash64("id"), F.lit(4))).write.mode("append").partitionBy("list_id").parquet(f"{index.path}/vectors")


def build(vectors: DataFrame, path: str, lists: int | None = None) -> Index:
    """An index of vectors (id, vector, other columns are kept) in a folder.  lists: the root of their number by default."""
    spark = vectors.sparkSession
    rows = vectors.where("vector IS NOT NULL")
    n = rows.count()
    lists = max(1, min(lists or round(n**0.5), LISTS, n)) if n else 0
    sample = [r["vector"] for r in rows.select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]  # at most SAMPLE rows
    points = np.array([v for v in sample if len(v) == len(sample[0])], float) if sample else np.zeros((0, 0))
    centres = means(points, lists) if len(points) else points
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list_id int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    kept = rows.withColumn("list_id", F.lit(0))
    kept.limit(0).write.parquet(f"{path}/schema")
    kept.limit(0).write.parquet(f"{path}/vectors")
    index = Index(spark, path)
    append(index, vectors)
    return index


def _hits(query_ids, q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """(query_id, ids, scores) of the k best of some vectors for each query."""
    s = np.round(q @ vectors.T, 10)
    for i, query in enumerate(query_ids):
        at = best_places(s[i], ids, k)
        yield query, ids[at], s[i][at]


def _frame(found: list) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "query_id": np.repeat(np.array([f[0] for f in found]), [len(f[1]) for f in found]) if found else np.zeros(0, np.int64),
            "id": np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64),
            "_s": np.concatenate([f[2] for f in found]) if found else np.zeros(0),
        }
    )


def _scan(shared, k: int):
    """Over the scan of probed lists: each batch's vectors meet the queries that probe their list."""

    def run(batches):
        query_ids, q, probing = shared.value
        best: dict[int, tuple] = {}
        for batch in batches:
            for list_id, own in batch.groupby("list_id"):
                rows = probing.get(int(list_id))
                if rows is None:
                    continue
                for i, (_, ids, s) in zip(rows, _hits(query_ids[rows], q[rows], own["id"].to_numpy(), np.stack(own["vector"]).astype(float), k)):
                    if i in best:
                        ids, s = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], s])
                        at = best_places(s, ids, k)
                        ids, s = ids[at], s[at]
                    best[i] = ids, s
        yield _frame([(query_ids[i], *b) for i, b in best.items()])

    return run


def _part(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return _frame([])
        vectors, ids, out = np.stack(rows["vector"]).astype(float), rows["id"].to_numpy(), []
        for at in range(0, len(queries), 256):  # so that scores take 256 rows at a time
            some = queries.iloc[at : at + 256]
            out += _hits(some["query_id"].to_numpy(), np.stack(some["q"]).astype(float), ids, vectors, k)
        return _frame(out)

    return run


def nearest_lists(centres: np.ndarray, q: np.ndarray, nprobe: int) -> np.ndarray:
    """The nprobe nearest lists of each query, nearest first."""
    return np.argsort(np.round((centres**2).sum(1)[None, :] - 2 * q @ centres.T, 10), axis=1, kind="stable")[:, :nprobe]


def _probing(shared, nprobe: int):
    def run(batches):
        centres = shared.value
        for batch in batches:
            batch = batch[[v is not None and len(v) == centres.shape[1] for v in batch["q"]]]
            if len(batch):
                near = nearest_lists(centres, np.stack(batch["q"]).astype(float), nprobe)
                yield batch.iloc[np.repeat(np.arange(len(batch)), near.shape[1])].assign(list_id=near.ravel().astype(np.int32))

    return run


def search(index: Index, queries: DataFrame, k: int, nprobe: int, keep: Column | None = None, digits: int = 4) -> DataFrame:
    """query_id, id, score, rank: the k nearest by inner product within the nprobe nearest lists; ties to the smaller id.

    queries: query_id, q.  keep: a filter on the vectors' other columns, applied within the scan.
    """
    spark, centres = index.spark, index.centroids()
    empty = spark.createDataFrame([], "query_id long, id long, score double, rank int")
    if not len(centres):
        return empty
    nprobe = max(1, min(nprobe, len(centres)))
    rows = index.vectors() if keep is None else index.vectors().where(keep)
    asked = queries.select("query_id", "q").where("q IS NOT NULL")
    schema = "query_id long, id long, _s double"
    if asked.limit(BROADCAST + 1).count() <= BROADCAST:
        found = asked.toPandas()
        found = found[[len(v) == centres.shape[1] for v in found["q"]]].sort_values("query_id")
        if found.empty:
            return empty
        q = np.stack(found["q"]).astype(float)
        near = nearest_lists(centres, q, nprobe)
        lists, at = np.unique(near), np.repeat(np.arange(len(q)), near.shape[1])
        probing = {int(i): at[near.ravel() == i] for i in lists}
        shared = spark.sparkContext.broadcast((found["query_id"].to_numpy(), q, probing))
        scored = rows.where(F.col("list_id").isin([int(i) for i in lists])).select("id", "vector", "list_id").mapInPandas(_scan(shared, k), schema)
    else:
        probed = asked.mapInPandas(_probing(spark.sparkContext.broadcast(centres), nprobe), "query_id long, q array<double>, list_id int")
        parts = spark.createDataFrame([(i, -(-n // PART)) for i, n in index.sizes().items()], "list_id int, _n int")  # a row a list
        dealt = rows.join(F.broadcast(parts), "list_id").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
        asked = probed.join(F.broadcast(parts), "list_id").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        # Queries of a list that very many ask go in blocks.
        blocks = F.lit(max(1, asked.count() // (PART * max(1, len(centres)))))
        asked = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))
        dealt = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0), blocks.cast("int") - 1)))
        keys = ["list_id", "_part", "_block"]
        scored = dealt.select("id", "vector", *keys).groupBy(*keys).cogroup(asked.select("query_id", "q", *keys).groupBy(*keys)).applyInPandas(_part(k), schema)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_s"), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "id", F.round("_s", digits).alias("score"), "rank")


def calibrated(index: Index, queries: DataFrame, k: int, recall: float = 0.95, keep: Column | None = None, sample: int = 200) -> int:
    """The fewest lists, of 1, 2, 4, ..., that find this share of the true k nearest of a bounded sample of queries."""
    asked = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    lists = len(index.centroids())
    wanted = {(r["query_id"], r["id"]) for r in search(index, asked, k, lists, keep).collect()}  # at most sample * k rows
    probes = 1
    while probes < lists:
        got = {(r["query_id"], r["id"]) for r in search(index, asked, k, probes, keep).collect()}
        if len(wanted & got) >= recall * len(wanted):
            return probes
        probes *= 2
    return max(1, lists)
