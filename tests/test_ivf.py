"""Inverted-list search: exact with all lists, recall and pruning with few, appended vectors, both ways of searching."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.operators import ivf
from graphmill.workspace import folder

SCHEMA = "id long, vector array<double>, label int"


def _data(n=1500, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim)) * 2
    points = centres[rng.integers(25, size=n)] + rng.normal(size=(n, dim)) * 0.4
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points = np.round(points, 3)
    points[10:14] = points[9]  # ties
    rows = [(i, p.tolist(), i % 3) for i, p in enumerate(points)]
    return rows + [(5000, None, 1), (5001, [1.0, 2.0], 1), rows[7]], points


def _exact(points, ids, queries, k):
    out = {}
    for query in queries:
        s = np.round(points @ points[query], 10)
        order = sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:k]
        out[query] = [ids[i] for i in order]
    return out


@pytest.fixture(scope="module")
def built(spark):
    rows, points = _data()
    vectors = spark.createDataFrame(rows, SCHEMA)
    return ivf.build(vectors, folder(spark, "ivf"), lists=30), points, vectors


def _queries(vectors):
    return vectors.where("id < 1500 AND id % 50 = 9").dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.col("vector").alias("q"))


def _got(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


@pytest.mark.parametrize("broadcast", [5000, 0])
def test_all_lists_are_exact(built, monkeypatch, broadcast):
    index, points, vectors = built
    monkeypatch.setattr(ivf, "BROADCAST", broadcast)
    monkeypatch.setattr(ivf, "PART", 20)
    got = _got(ivf.search(index, _queries(vectors), 10, 1000))
    everything = np.concatenate([points, points[7:8]])
    want = _exact(everything, [*range(1500), 7], sorted(got), 10)
    assert len(got) == 30 and got == want


def test_few_lists_reach_recall_and_are_all_that_is_read(built):
    index, points, vectors = built
    probes = ivf.calibrated(index, _queries(vectors), 10, recall=0.9)
    assert probes < 30
    hits = ivf.search(index, _queries(vectors), 10, probes)
    got, want = _got(hits), _exact(np.concatenate([points, points[7:8]]), [*range(1500), 7], sorted(_got(hits)), 10)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(len(set(w)) for w in want.values())
    one = ivf.search(index, _queries(vectors).where("query_id = 9"), 10, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*list_id#\d+ IN \(", plan)
    lists = [int(i) for i in ivf.nearest_lists(index.centroids(), points[9:10], 2)[0]]
    assert index.vectors().where(F.col("list_id").isin(lists)).count() < 300


def test_filter_and_appended_vectors(spark, built):
    rows, points = _data(300)
    vectors = spark.createDataFrame(rows, SCHEMA).where("id < 300")
    index = ivf.build(vectors.where("id % 10 <> 3"), folder(spark, "ivf"), lists=8)
    ivf.append(index, vectors.where("id % 10 = 3"))
    asked = vectors.where("id % 50 = 3").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    got = _got(ivf.search(index, asked, 5, 8, keep=F.col("label") == 1))
    ids = [i for i in range(300) if i % 3 == 1] + [7]
    want = _exact(points[ids], ids, [], 5)
    for query, found in got.items():
        s = np.round(points[ids] @ points[query], 10)
        assert found == [ids[i] for i in sorted(range(len(ids)), key=lambda i: (-s[i], ids[i]))[:5]]
    assert len(got) == 6 and want == {}


def test_empty_and_short_queries(spark, built):
    index, _, _ = built
    nothing = ivf.build(spark.createDataFrame([], SCHEMA), folder(spark, "ivf"))
    asked = spark.createDataFrame([(1, [1.0] * 12), (2, None), (3, [1.0])], "query_id long, q array<double>")
    assert ivf.search(nothing, asked, 3, 4).collect() == []
    assert {r["query_id"] for r in ivf.search(index, asked, 3, 4).collect()} == {1}
