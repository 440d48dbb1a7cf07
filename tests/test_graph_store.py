"""Cascading deletes against a graph that is built from scratch, after random changes."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from graphmill.operators import graph_store as G
from graphmill.workspace import folder

SCHEMA = "doc_id long, chunk_id long, subject string, relation string, object string, confidence double"


def _rows(rng, docs):
    return [(d, rng.randrange(3), f"n{rng.randrange(12)}", rng.choice(["r", "s", None]), f"n{rng.randrange(12)}", 0.5) for d in docs for _ in range(rng.randrange(1, 6))]


def _scratch(rows):
    edges = Counter((s, r or "", o) for d, _, s, r, o, _ in rows if d is not None and s and o)
    nodes = Counter(n for d, _, s, r, o, _ in rows if d is not None and s and o for n in {s, o})
    return edges, nodes


def _check(store, rows):
    edges, nodes = _scratch(rows)
    assert {(r["src"], r["rel"], r["dst"]): r["support"] for r in store.edges().collect()} == dict(edges)
    assert {r["id"]: r["support"] for r in store.nodes().collect()} == dict(nodes)
    assert all(r["n"] == 0 for r in G.verified(store).collect())


def test_random_changes_equal_a_build_from_scratch(spark):
    rng = random.Random(6)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    ids = lambda docs: spark.createDataFrame([(d,) for d in docs], "doc_id long")
    store = G.create(spark, folder(spark, "graph"))
    assert store.edges().collect() == [] and store.nodes().collect() == []
    G.add(store, frame([]))
    G.remove(store, ids([1]))
    assert store.edges().collect() == []
    now = _rows(rng, range(20)) + [(None, 1, "lost", "r", "lost", 0.1), (5, 1, None, "r", "x", 0.1), (5, 1, "self", "r", "self", 0.1)]
    G.add(store, frame(now))
    _check(store, now)
    for step in range(3):
        gone = rng.sample(range(20), 5)
        G.remove(store, ids([*gone, 777, gone[0]]))
        now = [r for r in now if r[0] not in gone]
        _check(store, now)
        back = _rows(rng, gone[:3])
        G.add(store, frame(back))
        now += back
        _check(store, now)
    _check(G.compacted(store, folder(spark, "graph")), now)
    lost = G.verified(store, frame(now).select("doc_id", "chunk_id").where("doc_id <> 7")).where("problem = 'lost_chunks'").first()["n"]
    assert lost == sum(1 for r in now if r[0] == 7 and r[2] and r[4])


def test_removal_reads_the_documents_folders_alone(spark):
    store = G.create(spark, folder(spark, "graph"))
    G.add(store, spark.createDataFrame(_rows(random.Random(1), range(60)), SCHEMA))
    plan = store.statements(spark.createDataFrame([(3,)], "doc_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "(bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_options_of_a_rebuild(spark):
    rng = random.Random(9)
    rows = _rows(rng, range(8))
    frame = spark.createDataFrame(rows, SCHEMA)
    store = G.create(spark, folder(spark, "graph"))
    G.add(store, frame)
    seeds = spark.createDataFrame([("n1",), ("only a seed",)], "id string")
    dry = {r["store"]: (r["before"], r["after"]) for r in G.rebuilt(store, frame, spark.createDataFrame([(2,)], "doc_id long"), dry=True).collect()}
    assert dry["documents"] == (8, 1)
    _check(store, rows)
    G.rebuilt(store, frame, spark.createDataFrame([(2,), (3,)], "doc_id long"))
    _check(store, rows)
    G.rebuilt(store, frame.where(F.col("doc_id") < 4))
    _check(store, [r for r in rows if r[0] < 4])
    G.clear(store)
    assert store.edges().collect() == [] and {(r["id"], r["support"]) for r in store.nodes(seeds).collect()} == {("n1", 0), ("only a seed", 0)}


def test_faults_of_a_store_are_found_in_one_pass(spark):
    """Every kind of fault is counted; statements are read once, and meet the changes once by edge and once by node."""
    store = G.create(spark, folder(spark, "graph"))
    assert {r["problem"]: r["n"] for r in G.verified(store).collect()} == {"edges_support": 0, "nodes_support": 0, "dangling_ends": 0}
    G.add(store, spark.createDataFrame([(1, 1, "a", "r", "b", 0.5), (1, 2, "a", "r", "b", 0.5), (2, 1, "b", None, "b", 0.5), (2, 1, "b", "s", "c", 0.5)], SCHEMA))
    # No statement says x-y, whose ends aren't there; a-b is said once more than it counts; c is gone.
    for name, kind, edges, nodes in [("bad", "added", [("x", "r", "y", 1)], []), ("worse", "removed", [("a", "r", "b", -1)], [("c", -1)])]:
        spark.createDataFrame(edges, "src string, rel string, dst string, n long").write.parquet(f"{store.path}/{name}/edges")
        spark.createDataFrame(nodes, "id string, n long").write.parquet(f"{store.path}/{name}/nodes")
        spark.createDataFrame([], "doc_id long, chunk_id long, src string, rel string, dst string, confidence double, bucket int").write.parquet(f"{store.path}/{name}/forward")
        spark.createDataFrame([], "doc_id long").write.parquet(f"{store.path}/{name}/removed")
        G._register(store, name, kind)
    out = G.verified(store)
    assert {r["problem"]: r["n"] for r in out.collect()} == {"edges_support": 2, "nodes_support": 1, "dangling_ends": 3}
    plan = G.verified(store)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(src") == 1 and plan.count("Exchange hashpartitioning(id") == 1
