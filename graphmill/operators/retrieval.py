"""Vector and keyword retrieval.

A set of queries is searched in one job.  If there are at most BROADCAST of them (they
are counted), every task gets them as one matrix and keeps the best k rows of each
over all it reads; else vectors and queries are dealt to blocks and each pair of
blocks is one task.  Either way k rows per query and task are shuffled, and scores
are matrix products, not expressions evaluated for every pair.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.functions.vectors import dot

BROADCAST = 5_000


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, keep: Column | None = None, least: float | None = None, digits: int = 4) -> DataFrame:
    """query_id, id, score, rank: the k nearest by inner product of unit vectors; exact; ties to the smaller id.

    vectors: id, vector and what `keep` reads (applied before scoring, so it reaches the scan).  queries: query_id, q.
    """
    rows = (vectors if keep is None else vectors.where(keep)).select("id", "vector")
    few = queries.limit(BROADCAST + 1).count() <= BROADCAST
    schema = "query_id long, id long, _s double"
    if few:
        found = queries.select("query_id", "q").toPandas().sort_values("query_id")  # at most BROADCAST rows
        shared = rows.sparkSession.sparkContext.broadcast((found["query_id"].to_numpy(), np.stack(found["q"]).astype(float) if len(found) else np.zeros((0, 0))))
        scored = rows.mapInPandas(_scan(shared, k), schema)
    else:
        n, m = max(1, rows.count() // 20_000), max(1, queries.count() // 2_000)
        a = rows.withColumns({"_i": F.pmod(F.xxhash64("id"), F.lit(n)), "_j": F.explode(F.sequence(F.lit(0), F.lit(m - 1)))})
        b = queries.withColumns({"_j": F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int"), "_i": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))})
        scored = a.groupBy("_i", "_j").cogroup(b.groupBy("_i", "_j")).applyInPandas(_block(k), schema)
    own = Window.partitionBy("query_id").orderBy(F.desc("_s"), "id")
    out = scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    if least is not None:
        out = out.where(F.col("_s") >= least)
    return out.select("query_id", "id", F.round("_s", digits).alias("score"), "rank")


def best_places(s: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k largest scores, ties to the smaller id; only those that reach the k-th are put in order."""
    if len(s) > 4 * k:
        at = np.flatnonzero(s >= -np.partition(-s, k - 1)[k - 1])
        return at[np.lexsort((ids[at], -s[at]))][:k]
    return np.lexsort((ids, -s))[:k]


#: Queries whose scores are in memory at a time.
QUERIES = 256


def _hits(q: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """For each query, in order, the ids and scores of its k best of some vectors.

    The 10th decimal of a score is the last, so equal vectors tie wherever they stand in a product.
    """
    for first in range(0, len(q), QUERIES):
        for row in np.round(q[first : first + QUERIES] @ vectors.T, 10):
            at = best_places(row, ids, k)
            yield ids[at], row[at]


def _found(query_ids, hits: list) -> pd.DataFrame:
    sizes = [len(ids) for ids, _ in hits]
    joined = lambda i, kind: np.concatenate([h[i] for h in hits]) if hits else np.zeros(0, kind)
    return pd.DataFrame({"query_id": np.repeat(query_ids, sizes) if hits else np.zeros(0, np.int64), "id": joined(0, np.int64), "_s": joined(1, float)})


def _scan(shared, k: int):
    def run(batches):
        query_ids, q = shared.value
        best: list = []
        for batch in batches:
            if batch.empty or not len(q):
                continue
            new = _hits(q, batch["id"].to_numpy(), np.stack(batch["vector"]).astype(float), k)
            if not best:
                best = list(new)
                continue
            for i, (ids, s) in enumerate(new):
                ids, s = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], s])
                at = best_places(s, ids, k)
                best[i] = ids[at], s[at]
        yield _found(query_ids, best)

    return run


def _block(k: int):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or queries.empty:
            return _found([], [])
        hits = _hits(np.stack(queries["q"]).astype(float), rows["id"].to_numpy(), np.stack(rows["vector"]).astype(float), k)
        return _found(queries["query_id"].to_numpy(), list(hits))

    return run


def probes(n_lists: Column, share: float = 0.05, low: int = 8, high: int = 128) -> Column:
    """Lists to probe of an inverted-file index."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.round(n_lists * share).cast("int")))


def probes_for(k: Column, filtered: bool) -> Column:
    """Lists to probe for k hits: twice as many, within 30 and 64 under a filter, which thins out lists, else 10 and 32."""
    low, high = (30, 64) if filtered else (10, 32)
    return F.greatest(F.lit(low), F.least(F.lit(high), 2 * F.greatest(F.lit(1), k))).cast("int")


def clustered(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """Vectors with the id of their nearest centroid: the column that an inverted-file search filters on.

    The centroids (their number is that of the lists) come to each row as one array, so rows are not multiplied.
    """
    lists = centroids.agg(F.collect_list(F.struct("list_id", "centroid")).alias("_lists"))
    best = F.array_max(F.transform("_lists", lambda c: F.struct(F.round(dot(F.col("vector"), c["centroid"]), 10).alias("s"), (-c["list_id"]).alias("list_id"))))
    return vectors.join(F.broadcast(lists)).select("id", (-best["list_id"]).alias("list_id"))


def reranked(hits: DataFrame, score: Callable[[DataFrame], DataFrame], head: int = 80, top: int | None = None) -> DataFrame:
    """Hits (query_id, id, rank) with the first `head` put in order of a new score; the others follow as they were.

    score gives rows (query_id, id, new_score) for some hits; a missing one counts 0, and equal ones keep their order.
    """
    scored = hits.join(score(hits.where(F.col("rank") <= head)), ["query_id", "id"], "left")
    part = F.when(F.col("rank") <= head, 0).otherwise(1)
    by = F.when(F.col("rank") <= head, -F.coalesce("new_score", F.lit(0.0))).otherwise(F.lit(0.0))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(part, by, "rank"))
    out = scored.withColumn("place", place).select("query_id", "id", "rank", "place")
    return out if top is None else out.where(F.col("place") <= top)


def first_hits(hits: DataFrame, key: str, tier: str) -> DataFrame:
    """Of each query the hits of its first tier that has any."""
    best = hits.groupBy(key).agg(F.min(tier).alias("_best"))
    return hits.join(best, key).where(F.col(tier) == F.col("_best")).drop("_best")


def with_phrases(hits: DataFrame, phrases: DataFrame, texts: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id) whose text contains all phrases of the query, case ignored; without phrases all of them.

    phrases: query_id, phrase, a few for each query; texts: doc_id, text.  Only hits of queries with phrases meet texts.
    """
    asked = phrases.groupBy("query_id").agg(F.collect_set(F.lower("phrase")).alias("_phrases"))
    marked = hits.join(asked, "query_id", "left")
    own = marked.where("_phrases IS NOT NULL").join(texts.select("doc_id", F.lower("text").alias("_text")), "doc_id")
    kept = own.where(F.forall("_phrases", lambda p: F.col("_text").contains(p)))
    return marked.where("_phrases IS NULL").select(hits.columns).unionByName(kept.select(hits.columns))


def bm25(terms: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, phrases: DataFrame | None = None, texts: DataFrame | None = None) -> DataFrame:
    """query_id, doc_id, score, rank.  terms: doc_id, term with repeats; queries: query_id, term, distinct.

    With phrases (query_id, phrase) and texts (doc_id, text), only documents that contain a query's phrases are ranked.

    Only terms that a query has are kept before the counts by document are shuffled, and a document's length and the
    document frequencies are partial aggregates.
    """
    lengths = terms.groupBy("doc_id").agg(F.count("*").alias("_len"))
    corpus = lengths.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"))
    wanted = queries.select("term").distinct()
    tf = terms.join(wanted, "term", "left_semi").groupBy("term", "doc_id").agg(F.count("*").alias("_tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("_df"))
    rows = tf.join(df, "term").join(lengths, "doc_id").join(F.broadcast(corpus))
    idf = F.log(1 + (F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    weight = idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))
    scored = rows.select("term", "doc_id", weight.alias("_w")).join(queries, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("_w"), 4).alias("score"))
    if phrases is not None:
        scored = with_phrases(scored, phrases, texts)
    own = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def embedded(texts: DataFrame, cache: DataFrame, provider: Callable[[pd.Series], pd.Series], key: str = "key", text: str = "text") -> DataFrame:
    """key, vector of every distinct text: from the cache, or from a provider that is called with batches of the rest."""
    distinct = texts.select(key, text).dropDuplicates([key])
    missing = distinct.join(cache.select(key), key, "left_anti")

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "vector": provider(batch[text])})

    kind = distinct.schema[key].dataType.simpleString()
    return cache.select(key, "vector").join(distinct.select(key), key, "left_semi").unionByName(missing.mapInPandas(run, f"{key} {kind}, vector array<double>"))
