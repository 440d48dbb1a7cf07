from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from graphmill.llm import sharding as S
from tests.llm.common import SCHEMA, documents


def test_matrix_has_exact_margins():
    m = S.communication_matrix([100, 0, 37, 1000], 7)
    assert m.sum(1).tolist() == [100, 0, 37, 1000]
    assert m.sum(0).tolist() == [1137 // 7 + (s < 1137 % 7) for s in range(7)]
    assert (m >= 0).all()


def test_large_draws_follow_the_distribution():
    rng = np.random.Generator(np.random.PCG64(1))
    n = [S._hypergeometric(rng, 4 * 10**9, 6 * 10**9, 10**6) for _ in range(300)]
    assert abs(np.mean(n) - 400_000) < 4 * 490 / np.sqrt(300) and 380 < np.std(n) < 610


def test_matrix_is_hypergeometric():
    rng = [S.communication_matrix([10, 10], 2, seed)[0, 0] for seed in range(2000)]
    assert abs(np.mean(rng) - 5) < 0.15 and abs(np.var(rng) - 10 * 0.25 * 10 / 19) < 0.2


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(S, "PART_ROWS", 40)
    monkeypatch.setattr(S, "CELL", 5)
    ids = spark.range(500).selectExpr("id AS doc_id", "CAST(id AS STRING) AS text", "1 AS shard", "2 AS slot")
    out = S.shard(spark, ids, 6).toPandas()
    assert out.doc_id.nunique() == 500
    sizes = out.groupby("shard").size()
    assert len(sizes) == 6 and sizes.max() - sizes.min() <= 1
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    again = S.shard(spark, ids.repartition(7), 6).toPandas()
    assert out.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_against_brute_force(spark, monkeypatch):
    """The law of each step, row by row, from the random numbers that Spark gives the rows."""
    monkeypatch.setattr(S, "PART_ROWS", 30)
    monkeypatch.setattr(S, "CELL", 7)
    rng = random.Random(2)
    rows = [(rng.choice([None, 1, 2, i]), rng.choice([None, "", "x", f"t{i}"])) for i in range(200)] + [(None, "hot")] * 90 + [(4, "é" * 300_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit(9), "_r": F.lit(9), "_copy": F.lit(9), "size": F.lit(9)})
    got = S.shard(spark, docs, 5)
    seen = Counter()
    keyed = []
    for doc_id, text in rows:
        data = (text or "").encode()
        key = (doc_id, len(data) + 8, zlib.crc32(data))
        seen[key] += 1
        keyed.append((*key, seen[key]))
    parts = -(-len(rows) // 30)
    table = spark.createDataFrame(keyed, "doc_id long, size long, text_crc32 long, _copy long")
    random_of = table.select("*", *(S._random(S.SEED + k).alias(f"r{k}") for k in range(3))).collect()
    cells = {1: math.ceil(len(rows) / parts / 7), 2: math.ceil(len(rows) / 5 / 7)}
    order = lambda r, k: (((r[f"r{k}"] % 2**64) >> 33) * cells[k] >> 31, r[f"r{k}"], r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32, r["_copy"])
    dealt = [[] for _ in range(parts)]
    for r in random_of:
        dealt[r.r0 % parts].append(r)
    matrix = S.communication_matrix([len(p) for p in dealt], 5)
    shards = [[] for _ in range(5)]
    for p, own in enumerate(dealt):
        own.sort(key=lambda r: order(r, 1))
        at = 0
        for s in range(5):
            shards[s] += own[at : at + matrix[p, s]]
            at += matrix[p, s]
    want = [(r.doc_id, r.size, r.text_crc32, s, slot) for s, own in enumerate(shards) for slot, r in enumerate(sorted(own, key=lambda r: order(r, 2)))]
    assert Counter(map(tuple, got.collect())) == Counter(want)


def test_awkward_rows(spark):
    docs = documents(spark)
    out = S.shard(spark, docs, 4).toPandas()
    assert len(out) == docs.count() and out.groupby("shard").size().max() - out.groupby("shard").size().min() <= 1
    assert out[out.doc_id == 0]["size"].tolist() == [8] and out[out.doc_id == 0].text_crc32.tolist() == [0]
    assert S.shard(spark, spark.createDataFrame([], SCHEMA), 4).count() == 0
    assert S.shard(spark, docs.limit(2), 24).count() == 2
