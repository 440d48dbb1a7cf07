from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from graphmill.llm import vptree as V


def exact(ids, x, q_id, q, k):
    own = ids != q_id
    s = (x[own] * q).sum(1)
    order = np.lexsort((ids[own], -s))[:k]
    return ids[own][order].tolist()


def test_factor_one_is_exact(spark):
    rng = np.random.Generator(np.random.PCG64(2))
    x = rng.normal(size=(600, 8)) * rng.uniform(0.2, 3, (600, 1))  # norms differ
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = V.search(df, F.col("vec_id") % 20 == 0, k=7, relax=1.0, shard_rows=150).toPandas()
    for q in range(0, 600, 20):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == exact(np.arange(600), x, q, x[q], 7)


def test_ties_are_exact_at_factor_one(spark, monkeypatch):
    """Small whole numbers: very many equal inner products and equal vectors."""
    monkeypatch.setattr(V, "BLOCK", 7)
    rng = np.random.Generator(np.random.PCG64(3))
    x = rng.integers(-1, 2, (800, 4)).astype(float)
    x[(x == 0).all(1)] = 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = V.search(df, F.col("vec_id") % 20 == 0, k=9, relax=1.0, shard_rows=60).toPandas()
    for q in range(0, 800, 20):
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == exact(np.arange(800), x, q, x[q], 9) and own.score.tolist() == [float(x[i] @ x[q]) for i in own.vec_id]
    one = spark.createDataFrame([(i, [1.0, 1.0 / (1 + i % 5)]) for i in range(400)], "vec_id long, embedding array<double>")
    got = V.search(one, F.col("vec_id") % 20 == 0, k=5, relax=1.0, shard_rows=50).toPandas()
    y = np.array([[1.0, 1.0 / (1 + i % 5)] for i in range(400)])
    for q in range(0, 400, 20):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == exact(np.arange(400), y, q, y[q], 5)


def test_repeated_ids(spark):
    """A query's id in many rows: none of its own vectors is in its answer, and the answer is full."""
    rng = np.random.Generator(np.random.PCG64(8))
    x = rng.normal(size=(60, 3))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, v.tolist()) for v in x[1:25]] + [(0, x[0].tolist())] * 3 + [(30, x[30].tolist())] * 2
    got = V.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=6, relax=1.0, shard_rows=20).toPandas()
    assert len(got) == 25 * 6 and 0 not in set(got.vec_id)
    keys = got.sort_values(["rank"]).groupby("rank").score.max()
    for r in range(1, 7):
        assert r in keys.index
    best = {tuple(exact(np.arange(60), x, 0, x[i], 6)) for i in range(25)}
    lists = got.sort_values(["score"], ascending=False).groupby("rank").vec_id.apply(set)
    assert lists[1] == {b[0] for b in best}


def test_clashing_columns_floats_and_negative_ids(spark):
    rng = np.random.Generator(np.random.PCG64(9))
    x = rng.normal(size=(100, 4)).astype(np.float32)
    df = spark.createDataFrame([(i - 50, v.tolist(), 1, 2, 3) for i, v in enumerate(x)], "vec_id int, embedding array<float>, _vector int, _key int, _region int")
    got = V.search(df, F.col("vec_id") % 20 == 0, k=4, relax=1.0, shard_rows=30).toPandas()
    ids = np.arange(100) - 50
    for q in (-40, -20, 0, 20, 40):
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == exact(ids, x.astype(float), q, x[ids == q][0].astype(float), 4)


def test_recall_of_the_production_factor(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = V.search(df, F.col("vec_id") % 20 == 0, shard_rows=200).toPandas()
    rows = df.toPandas().sort_values("vec_id")
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    hits = [len(set(g.vec_id) & set(exact(ids, x, q, x[ids == q][0], 20))) / 20 for q, g in got.groupby("query_id")]
    assert np.mean(hits) >= 0.9


def test_awkward_vectors(spark):
    one = [1.0, 0.0, 0.5]
    rows = [(0, one), (1, None), (2, [0.0, 0.0, 0.0]), (3, [None, 1.0, 1.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [1.0]), (None, one), (20, [0.5, 0.5, 0.5])]
    rows += [(100 + i, one) for i in range(60)]  # ties: the smaller ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = V.search(df, F.col("vec_id") % 20 == 0, k=5).toPandas()
    assert got[got.query_id == 0].sort_values("rank").vec_id.tolist() == [100, 101, 102, 103, 104]
    assert set(got.query_id) == {0, 20, 100, 120, 140} and not set(got.vec_id) & {1, 2, 3, 4, 5, 6}
    few = V.search(df.where("vec_id IN (0, 20)"), F.col("vec_id") % 20 == 0, k=5).toPandas()
    assert sorted(zip(few.query_id, few.vec_id)) == [(0, 20), (20, 0)]
    assert V.search(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


def test_the_calibrated_factor_compares_fewer_points_and_keeps_recall(spark):
    """Vectors of few free dimensions: a tenth of the points are compared; of many, most are, and recall holds too."""
    rng = np.random.Generator(np.random.PCG64(12))
    for free, share in ((3, 0.35), (24, 1.0)):
        x = np.concatenate([rng.normal(size=(3000, free)), np.zeros((3000, 24 - free))], 1)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        most = 1.0 + 1e-9
        factor = V.calibrated(x, most, 10)
        assert factor < 1
        tree, asked = V.Tree(V._lifted(x, most), np.arange(3001), np.arange(3000)), np.arange(1000, 1200)
        got, _ = tree.search(V._as_queries(x[asked]), asked, np.full(200, -np.inf), 10, factor, most)
        assert tree.compared < share * 200 * 3000
        hits = sum(len(set(g) & set(exact(np.arange(3000), x, q, x[q], 10))) for g, q in zip(got.tolist(), asked))
        assert hits >= 0.9 * 2000
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:1500])], "vec_id long, embedding array<double>")
        found = V.search(df, F.col("vec_id") % 20 == 0, k=10, shard_rows=400).toPandas()
        hits = sum(len(set(found[found.query_id == q].vec_id) & set(exact(np.arange(1500), x[:1500], q, x[q], 10))) for q in range(0, 1500, 20))
        assert hits >= 0.9 * 750
