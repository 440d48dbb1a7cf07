"""Nearest neighbours by inner product with vantage-point trees, one per shard.

Largest inner product becomes nearest Euclidean neighbour when a vector x gets one
more component sqrt(M^2 - |x|^2), M being the greatest norm of all, and a query q
gets a zero: |q - x|^2 = |q|^2 + M^2 - 2 q.x.  The Euclidean distance obeys the
triangle inequality, so a vantage-point tree can prune: with t the distance of the
k-th best so far, the far side of a split at radius m is visited only if

    |d(query, vantage) - m| <= relax * t

relax = 1 is the triangle inequality's own bound: the search is exact, ties included.
Below 1 it prunes more than is safe.  Without a factor given, the smallest is taken that finds RECALL of the true
neighbours of TRIED queries in a tree of as many sampled vectors as a shard has.

1. A top-level tree is made on the driver from a sample of at most SAMPLE vectors.  Its
   leaves are regions of about SHARD rows (at most SAMPLE / 16 regions).  Every vector is
   put in its region; a region with more rows is dealt by a hash into several shards.
2. Each query is searched in the shards of its own region.  That gives it k candidates,
   and so a bound t.
3. With that bound the top-level tree names the other regions that a query must visit,
   and it is searched in their shards.  The best of all are its answer.

A task searches one shard: it builds the shard's tree (median splits, leaves of LEAF
points) and walks it for a block of at most about BLOCK queries.  A vector goes once to
its shard and once more for every further BLOCK queries that come to the shard.

Equal vectors are one point with its smallest k + 1 ids (one may be the query's own),
kept by a ranking that limits each task's rows before the exchange.  Within a leaf, rows
are ordered by inner product, then id, so that ties are decided as the result's are.

Defined cases
    Vectors that are null or zero, hold null, NaN or infinite components, or have
    another length than most (of equally frequent lengths the shorter counts), and
    rows with a null vec_id, take no part.  Ties go to the smaller vec_id.  A query
    has fewer rows if there are fewer candidates.  Rows equal in vec_id and vector
    are one; a vec_id with several vectors is several candidates, and as a query has
    an answer for each, in which none of its own vectors is.  Columns besides vec_id
    and embedding aren't read.  An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.textarrays import tidy
from graphmill.workspace import checkpointed

K = 20
#: Rows of a shard, queries of a block, points of a leaf, vectors that the top-level tree is made from.
SHARD, BLOCK, LEAF, SAMPLE = 8192, 16384, 128, 32768
#: Factors that are tried, the share of the true neighbours that the one chosen must find, and the queries that are tried.
FACTORS = (0.03, 0.06, 0.09, 0.12, 0.15, 0.18, 0.21, 0.25, 0.3, 0.4, 0.5, 0.7)
RECALL, TRIED = 0.96, 400
#: Rounding of distances, relative to the largest.
SLACK = 1e-9


def _distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(1))


def _split(points: np.ndarray, leaf: int, rng: np.random.Generator, number=None):
    """A tree over rows of points: (vantage, radius, inner, outer), or an array of row numbers, or a leaf's number."""

    def build(own: np.ndarray):
        if len(own) <= leaf:
            return own if number is None else next(number)
        vantage = points[own[rng.integers(len(own))]]
        d = _distances(points[own], vantage)
        radius = float(np.partition(d, len(own) // 2)[len(own) // 2])
        inner = d < radius
        if not inner.any():
            inner = d <= radius  # very many at the same distance
            radius = float(np.nextafter(radius, np.inf))
            if inner.all():
                return own if number is None else next(number)
        return vantage, radius, build(own[inner]), build(own[~inner])

    return build(np.arange(len(points)))


class Tree:
    """A shard: points n x d (lifted), different; rows first[i] to first[i + 1] of ids have the vector of point i."""

    def __init__(self, points: np.ndarray, first: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 3):
        self.points, self.first, self.ids = points, first, ids
        self.root = _split(points, leaf, np.random.Generator(np.random.PCG64(seed)))

    def search(self, queries: np.ndarray, query_ids: np.ndarray, bound: np.ndarray, k: int, relax: float, most: float):
        """Ids and inner products of the k best of each query, best first (id -1 where there are fewer).

        bound: inner products that a k-th best is known to reach, or -inf.
        """
        n = len(queries)
        self.q, self.q_ids, self.k, self.relax, self.most = queries, query_ids, k, relax, most
        self.base = (queries * queries).sum(1) + most * most
        self.bound, self.compared = bound.copy(), 0
        self.score, self.found = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        self._visit(self.root, np.arange(n))
        return self.found, self.score

    def _visit(self, node, own: np.ndarray) -> None:
        if not len(own):
            return
        if isinstance(node, np.ndarray):
            self._leaf(node, own)
            return
        vantage, radius, inner, outer = node
        d = _distances(self.q[own], vantage)
        near_in = d < radius
        for near, far, side in ((inner, outer, near_in), (outer, inner, ~near_in)):
            mine, gap = own[side], np.abs(d[side] - radius)
            self._visit(near, mine)
            self._visit(far, mine[gap <= reach(self.base[mine], self.bound[mine], self.relax)])

    def _leaf(self, node: np.ndarray, own: np.ndarray) -> None:
        self.compared += len(own) * len(node)
        count = self.first[node + 1] - self.first[node]
        ids = self.ids[np.repeat(self.first[node] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        x = np.ascontiguousarray(self.points[node, :-1])
        for at in range(0, len(own), 4096):
            rows = own[at : at + 4096]
            score = np.repeat(np.einsum("id,jd->ij", self.q[rows, :-1], x), count, axis=1)
            score[ids[None] == self.q_ids[rows][:, None]] = -np.inf
            better = np.flatnonzero((score >= self.bound[rows][:, None]).any(1))
            if not len(better):
                continue
            rows = rows[better]
            score = np.concatenate([self.score[rows], score[better]], 1)
            named = np.concatenate([self.found[rows], np.broadcast_to(ids, (len(rows), len(ids)))], 1)
            order = np.lexsort((named, -score), axis=1)[:, : self.k]
            score = np.take_along_axis(score, order, 1)
            self.score[rows] = score
            self.found[rows] = np.where(np.isfinite(score), np.take_along_axis(named, order, 1), -1)
            self.bound[rows] = np.maximum(self.bound[rows], score[:, -1])


def reach(base: np.ndarray, bound: np.ndarray, relax: float) -> np.ndarray:
    """How far from a split a query may be and still have to see its other side.  base: |q|^2 + M^2."""
    return relax * np.sqrt(np.maximum(base - 2 * bound, 0)) + SLACK * (1 + np.sqrt(base))


def _lifted(x: np.ndarray, most: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))[:, None]], 1)


def _as_queries(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((len(x), 1))], 1)


def _vectors(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


class Regions:
    """The top-level tree."""

    def __init__(self, sample: np.ndarray, most: float, count: int):
        self.most = most
        numbers = iter(range(1 << 30))
        self.root = _split(_lifted(sample, most), max(1, math.ceil(len(sample) / count)), np.random.Generator(np.random.PCG64(7)), numbers)
        self.count = next(numbers)

    def of(self, points: np.ndarray) -> np.ndarray:
        """The region of each lifted point."""
        out = np.zeros(len(points), np.int64)

        def go(node, own):
            if not isinstance(node, tuple):
                out[own] = node
                return
            vantage, radius, inner, outer = node
            inside = _distances(points[own], vantage) < radius
            go(inner, own[inside])
            go(outer, own[~inside])

        go(self.root, np.arange(len(points)))
        return out

    def near(self, queries: np.ndarray, bound: np.ndarray, relax: float):
        """(query row, region) pairs that a search has to visit, those of the query's own region included."""
        far = reach((queries * queries).sum(1) + self.most * self.most, bound, relax)
        rows, regions = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def go(node, own):
            if not len(own):
                return
            if not isinstance(node, tuple):
                rows.append(own)
                regions.append(np.full(len(own), node))
                return
            vantage, radius, inner, outer = node
            d = _distances(queries[own], vantage)
            cross = np.abs(d - radius) <= far[own]
            go(inner, own[(d < radius) | cross])
            go(outer, own[(d >= radius) | cross])

        go(self.root, np.arange(len(queries)))
        return np.concatenate(rows), np.concatenate(regions)


_FOUND = pa.schema([("query_id", pa.int64()), ("query_key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search_cell(dim: int, k: int, relax: float, most: float):
    def run(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(candidates) or not len(queries):
            return _FOUND.empty_table()
        x, ids = _vectors(candidates.column("_vector"), dim), candidates.column("vec_id").to_numpy()
        q, q_ids, q_keys, bound = _vectors(queries.column("_vector"), dim), queries.column("vec_id").to_numpy(), queries.column("_key").to_numpy(), queries.column("_bound").to_numpy()
        order = np.lexsort((ids, *x.T))
        x, ids = x[order], ids[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]).any(1)))
        tree = Tree(_lifted(x[first], most), np.append(first, len(x)), ids)
        found, score = tree.search(_as_queries(q), q_ids, bound, k, relax, most)
        row, col = np.nonzero(np.isfinite(score))
        return pa.table([q_ids[row], q_keys[row], found[row, col], score[row, col]], schema=_FOUND)

    return run


def calibrated(sample: np.ndarray, most: float, k: int = K, recall: float = RECALL, size: int = SHARD) -> float:
    """The smallest of FACTORS that reaches the recall in a tree of sampled vectors (1, which is exact, if none does)."""
    rng = np.random.Generator(np.random.PCG64(11))
    points = sample[rng.permutation(len(sample))[:size]]
    ids = np.arange(len(points))
    tree, asked = Tree(_lifted(points, most), np.arange(len(points) + 1), ids), ids[:TRIED]
    known = np.full(len(asked), -np.inf)

    def found(factor: float) -> np.ndarray:
        return tree.search(_as_queries(points[asked]), asked, known, k, factor, most)[0]

    best = found(1.0)
    wanted = (best >= 0).sum()
    for factor in FACTORS:
        got = found(factor)
        if sum(len(np.intersect1d(a[a >= 0], b[b >= 0])) for a, b in zip(best, got)) >= recall * wanted:
            return factor
    return 1.0


def usable(vector: str = "embedding") -> Column:
    """Whether the vector can take part, length aside."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, is_query: Column, k: int = K, relax: float | None = None, shard_rows: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: for each row (vec_id, embedding) with is_query, about its k rows of largest inner product.

    relax: the factor; by default one that is calibrated on a sample.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("_vector"), is_query.alias("_query"))
    rows = rows.withColumn("_dim", F.size("_vector"))
    squares = F.aggregate("_vector", F.lit(0.0), lambda a, x: a + x * x)
    sizes = rows.groupBy("_dim").agg(F.count("*").alias("n"), F.max(F.sqrt(squares)).alias("most")).collect()  # a row for each length
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    common = max(sizes, key=lambda r: (r["n"], -r["_dim"]))
    n, dim, most = common["n"], common["_dim"], common["most"] * (1 + 1e-12)
    rows = rows.where(F.col("_dim") == dim).drop("_dim").withColumn("_key", F.xxhash64("_vector"))

    place = F.xxhash64("_vector", F.lit(5)).cast("double") / 2.0**64 + 0.5
    drawn = rows.where(place <= min(1.0, 0.9 * SAMPLE / n)).select("vec_id", "_vector").limit(SAMPLE).toArrow()
    if not len(drawn):
        drawn = rows.select("vec_id", "_vector").limit(1).toArrow()
    sample = np.unique(_vectors(drawn.column("_vector"), dim), axis=0)
    relax = calibrated(sample, most, k) if relax is None else relax
    regions = spark.sparkContext.broadcast(Regions(sample, most, max(1, min(math.ceil(n / shard_rows), SAMPLE // 16))))

    def put(batches):
        for batch in batches:
            own = regions.value.of(_lifted(_vectors(batch.column("_vector"), dim), most))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "_vector", "_query", "_key")), pa.array(own)], ["vec_id", "_vector", "_query", "_key", "_region"])

    placed = rows.mapInArrow(tidy(put), "vec_id long, _vector array<double>, _query boolean, _key long, _region long")
    same = Window.partitionBy("_region", "_key", "_vector").orderBy("vec_id")
    # Of equal vectors the k + 1 smallest ids; every query stays one, once for each of its vectors.
    placed = checkpointed(placed)
    ranked = placed.select("vec_id", "_vector", "_key", "_region").distinct().withColumn("_rank", F.row_number().over(same)).where(F.col("_rank") <= k + 1).drop("_rank")
    ranked = checkpointed(ranked)
    counts = {r["_region"]: r["n"] for r in ranked.groupBy("_region").agg(F.count("*").alias("n")).collect()}  # at most SAMPLE / 16
    parts = spark.createDataFrame([(r, math.ceil(m / (2 * shard_rows))) for r, m in counts.items()], "_region long, _parts int")
    candidates = ranked.join(F.broadcast(parts), "_region").withColumn("_shard", F.pmod(F.xxhash64("_key"), F.col("_parts")))
    queries = placed.where("_query").select("vec_id", "_vector", "_key", "_region").dropDuplicates(["vec_id", "_key"])

    found = None
    for own_region in (True, False):
        if own_region:
            asked = queries.withColumn("_bound", F.lit(float("-inf")))
        else:
            asked = _routed(queries.join(_bounds(found, k), ["vec_id", "_key"], "left").na.fill(float("-inf"), ["_bound"]), regions, dim, relax)
        asked = checkpointed(asked)
        visits = asked.groupBy("_region").agg(F.ceil(F.count("*") / BLOCK).alias("_blocks"))
        visits = spark.createDataFrame([tuple(r) for r in visits.collect()], "_region long, _blocks long")  # at most SAMPLE / 16
        cells = candidates.join(F.broadcast(visits), "_region").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        cells = cells.select("_region", "_shard", "_block", "vec_id", "_vector")
        sent = asked.join(F.broadcast(visits), "_region").withColumn("_block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("_blocks")))
        sent = sent.join(F.broadcast(parts), "_region").withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - F.lit(1).cast("long"))))
        sent = sent.select("_region", "_shard", "_block", "vec_id", "_vector", "_key", "_bound")
        key = ["_region", "_shard", "_block"]
        one = cells.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(tidy(_search_cell(dim, k, relax, most)), "query_id long, query_key long, vec_id long, score double")
        found = checkpointed(one) if own_region else found.unionByName(one)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bounds(found: DataFrame, k: int) -> DataFrame:
    """The k-th best inner product of each query that has k candidates."""
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    last = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") == k)
    return last.select(F.col("query_id").alias("vec_id"), F.col("query_key").alias("_key"), F.col("score").alias("_bound"))


def _routed(queries: DataFrame, regions, dim: int, relax: float) -> DataFrame:
    """The queries once for each region besides their own that the top-level tree can't rule out."""

    def run(batches):
        for batch in batches:
            own = batch.column("_region").to_numpy()
            row, region = regions.value.near(_as_queries(_vectors(batch.column("_vector"), dim)), batch.column("_bound").to_numpy(), relax)
            other = region != own[row]
            row, region = row[other], region[other]
            for at in range(0, len(row), 8192):
                part = batch.take(pa.array(row[at : at + 8192]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "_vector", "_key")), pa.array(region[at : at + 8192]), part.column("_bound")], ["vec_id", "_vector", "_key", "_region", "_bound"])

    return queries.select("vec_id", "_vector", "_key", "_region", "_bound").mapInArrow(tidy(run), "vec_id long, _vector array<double>, _key long, _region long, _bound double")
