"""Stored postings against BM25 by its formula, before and after documents come, go and come back; skipped cells."""

from __future__ import annotations

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from graphmill.operators import postings as P
from graphmill.workspace import folder

WORDS = [f"w{i}" for i in range(120)]


def _docs(rng, ids):
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return {i: rng.choices(WORDS, weights, k=rng.randrange(1, 60)) for i in ids}


def _want(docs, queries, k):
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for terms in docs.values() for t in set(terms))
    out = {}
    for query, terms in queries.items():
        scores = {}
        for i, own in docs.items():
            tf = Counter(own)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(own) / avg)) for t in terms if tf[t])
            if any(tf[t] for t in terms):
                scores[i] = round(s, 4)
        out[query] = [(i, s) for i, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return {q: v for q, v in out.items() if v}


def _got(index, asked, k, skipped=None):
    out = {}
    for r in P.search(index, asked, k, skipped).orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def _same(got, want):
    assert got.keys() == want.keys()
    for q in want:
        assert [s for _, s in got[q]] == [s for _, s in want[q]] or all(abs(a[1] - b[1]) < 2e-4 for a, b in zip(got[q], want[q]))
        assert len(got[q]) == len(want[q])


def test_scores_before_and_after_changes(spark, monkeypatch):
    monkeypatch.setattr(P, "CELL", 8)
    monkeypatch.setattr(P, "BUCKETS", 8)
    rng = random.Random(5)
    docs = _docs(rng, range(300))
    docs[299] = []
    frame = lambda d: spark.createDataFrame([(i, t) for i, t in d.items()], "doc_id long, terms array<string>")
    queries = {q: set(rng.sample(WORDS[20:], 3)) | {WORDS[q % 4]} for q in range(12)} | {50: {"unknown"}}
    asked = spark.createDataFrame([(q, t) for q, terms in queries.items() for t in terms], "query_id long, term string")
    index = P.create(spark, folder(spark, "postings"))
    assert _got(index, asked, 5) == {}
    P.add(index, frame({1000: []}))  # a segment without a term
    assert _got(index, asked, 5) == {}
    P.remove(index, spark.createDataFrame([(1000,)], "doc_id long"))
    P.add(index, frame(docs))
    skipped = []
    _same(_got(index, asked, 5, skipped), _want(docs, queries, 5))
    cells, read = skipped[0]
    assert read < cells  # blocks below the fifth score are not read
    gone = [i for i in docs if i % 10 == 3]
    P.remove(index, spark.createDataFrame([(i,) for i in [*gone, 9999]], "doc_id long"))
    left = {i: t for i, t in docs.items() if i not in gone}
    _same(_got(index, asked, 5), _want(left, queries, 5))
    new = _docs(rng, [*gone, *range(400, 420)])  # other texts under the ids that went, and new ones
    P.add(index, frame(new))
    _same(_got(index, asked, 5), _want(left | new, queries, 5))
    P.remove(index, spark.createDataFrame([(gone[0],)], "doc_id long"))
    now = {i: t for i, t in (left | new).items() if i != gone[0]}
    _same(_got(index, asked, 5), _want(now, queries, 5))


def test_ties_and_scan_of_the_terms_folders(spark):
    docs = spark.createDataFrame([(i, ["a", "b"]) for i in range(30)], "doc_id long, terms array<string>")
    index = P.create(spark, folder(spark, "postings"))
    P.add(index, docs)
    asked = spark.createDataFrame([(1, "a")], "query_id long, term string")
    assert [r["doc_id"] for r in P.search(index, asked, 4).orderBy("rank").collect()] == [0, 1, 2, 3]
    name = index.segments()[0]["name"]
    own = index.read(name, "postings").where(F.col("bucket").isin([1]))
    assert "PartitionFilters: [isnotnull(bucket" in own._jdf.queryExecution().executedPlan().toString()
