"""What a task holds, or does for a row, doesn't grow with the input."""

from __future__ import annotations

import itertools
import re
import time
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphmill.catalog import Catalog
from graphmill.operators import build as B
from graphmill.operators import chunking as C
from graphmill.operators import fusion as M
from graphmill.operators import graph as G
from graphmill.operators import joins as J
from graphmill.operators import postings
from graphmill.plans import QUERIES
from graphmill.workspace import checkpointed


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sharing_pairs_are_joined_in_parts_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(J, "PAIRS", 50)
    rows = [(f"n{i:02d}", f"s{j}") for i in range(30) for j in range(6) if (i * 7 + j * 3) % 4]
    got = J.sharing_pairs(spark.createDataFrame(rows, "node string, shared string"), 3, cell=8)
    own = {n: {s for m, s in rows if m == n} for n, _ in rows}
    want = {(a, b, len(own[a] & own[b])) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) >= 3}
    assert {tuple(r) for r in got.collect()} == want
    pairs = sum(n * (n - 1) // 2 for n in Counter(s for _, s in rows).values())
    assert f"{-(-pairs // 50)}), REPARTITION_BY_NUM" in _plan(got)
    assert J.sharing_pairs(spark.createDataFrame(rows, "node string, shared string").limit(0), 3).count() == 0


def test_sharing_pairs_are_counted_where_their_lists_are(spark):
    """No pairs are shuffled; nulls, a node of very many links, shared ones of one and of several cells."""
    rows = {(i, j) for i in range(40) for j in range(25) if (i * 7 + j * 3) % 4 and (j % 3 or i < 12)}
    rows |= {(99, j) for j in range(200)} | {(200 + j % 3, j) for j in range(25, 200)}
    nulls = [(i, None) for i in range(10)] + [(None, j) for j in range(25)]
    links = spark.createDataFrame([*rows, *nulls], "node long, shared long")
    own = defaultdict(set)
    for node, shared in rows:
        own[node].add(shared)
    want = {(a, b, len(own[a] & own[b])) for a, b in itertools.combinations(sorted(own), 2) if len(own[a] & own[b]) >= 8}
    for cell in (10, 2048):
        got = J.sharing_pairs(links, 8, cell=cell)
        assert not re.search(r"hashpartitioning\(a#\d+L?, b#", _plan(got))
        rows_got = [tuple(r) for r in got.collect()]
        assert len(rows_got) == len(want)
        assert set(rows_got) == want


def test_texts_meet_methods_where_they_are(spark):
    """Few methods are broadcast whatever the session's threshold, so texts of few answers aren't gathered."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        methods = spark.createDataFrame([("x", "split flow")], "answer string, method string")
        points = spark.createDataFrame([("x", "1", "A Flow"), ("x", "2", "none"), ("y", "3", "flow")], "answer string, id string, text string")
        out = G.method_edges(methods, points, spark.createDataFrame([("x", "9", "n")], "answer string, id string, name string"))
        assert "SortMergeJoin" not in _plan(out)
        assert sorted((r.answer, r.rel, r.dst) for r in out.collect()) == [("x", "GUIDES", "9"), ("x", "MENTIONED_IN", "1")]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_terms_are_counted_in_one_pass(spark, tmp_path):
    docs = {1: ["b", "a", "b", "a", "b"], 2: [], 3: None, 4: ["c"], 5: [f"w{i:06d}" for i in range(150_000)]}
    index = postings.create(spark, str(tmp_path / "postings"))
    t = time.time()
    postings.add(index, spark.createDataFrame(list(docs.items()), "doc_id long, terms array<string>"))
    assert time.time() - t < 60
    got = {r.doc_id: r for r in index.read(index.segments()[0]["name"], "forward").collect()}
    for k, terms in docs.items():
        assert got[k].len == len(terms or []) and {c.term: c.tf for c in got[k].counts} == Counter(terms or [])


def test_chunks_of_a_batch_are_cut_a_few_at_a_time():
    class Docs:
        schema = {"doc_id": type("F", (), {"dataType": type("T", (), {"simpleString": lambda self: "long"})()})}
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run

    text = "\n\n".join("some plain words of a text " * 20 for _ in range(4))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10_000)), "text": [text] * 10_000})
    tracemalloc.start()
    rows = sum(b.num_rows for b in C.simple_chunks(Docs())(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 10_000 * len(C.simple_cuts(text, 1200, 100, "\n\n")) and peak < 8e6


def test_statements_are_put_in_form_in_partitions_by_their_number(spark):
    rows = [("a", "r", "b", 0.9, 1), ("A", "R", "B", 0.8, 2), ("b", "r", "a", 0.9, 1), ("a", "r", "a", 0.9, 1), (None, "r", "b", 0.9, 1)]
    triplets = spark.createDataFrame(rows, "subject string, relation string, object string, confidence double, chunk_id long")
    out = B.optimized(triplets, spark.createDataFrame([("b", "c")], "old string, new string"), F.upper("relation"), ["chunk_id"])
    assert _plan(out).count("REPARTITION_BY_NUM") == 3
    assert sorted((r.subject, r.relation, r.object) for r in out.collect()) == [("A", "R", "B"), ("a", "R", "c"), ("c", "R", "a")]


def test_scopes_are_found_where_a_chunks_rows_are(spark):
    """One deal of the rows, by chunk, at any size: nothing is shuffled again by chunk and type."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(1, "p", "space"), (1, "p", "space"), (1, "u", "unit"), (1, "d", "department"), (2, "q", "space"), (None, "p", "space"), (3, "v", None)]
        out = B.scope_chains(spark.createDataFrame(rows, "chunk long, entity string, type string"), {"space": ("unit", "department"), "unit": ("department",)})
        plan = _plan(out)
        assert "hashpartitioning(chunk" in plan and not [x for x in plan.split("hashpartitioning(chunk")[1:] if "type" in x.split(")")[0]]
        assert sorted((r.chunk or 0, r.entity, tuple(r.scope)) for r in out.collect()) == [(0, "p", ()), (1, "p", ("d", "u")), (1, "u", ("d",)), (2, "q", ())]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("search", ["trails", "shortest_path", "neighbourhood"])
def test_searches_write_the_edges_once_and_shuffle_none(spark, monkeypatch, search):
    """A search from few nodes stores the edges one way, once; every other table it writes is of what it reached."""
    chain = [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d")]
    edges = spark.createDataFrame(chain + [(f"x{i}", "r", f"y{i}") for i in range(500)], "src string, rel string, dst string")
    written, plans = [], []

    def kept(df):
        plans.append(_plan(df))
        out = checkpointed(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(G, "checkpointed", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        if search == "trails":
            got = [r.path for r in G.trails(edges, ["a"], ["d"], 2, 3, 10).collect()]
        elif search == "shortest_path":
            got = [" - ".join(r.id for r in G.shortest_path(edges, "a", "d").orderBy("step").collect())]
        else:
            got = [" - ".join([r.src, r.dst]) for r in G.neighbourhood(edges, spark.createDataFrame([("a",)], "id string"), 1).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == (["a - b"] if search == "neighbourhood" else ["a - b - c - d"])
    assert [n for n in written if n > 20] == [503]
    assert not [p for p in plans if "SortMergeJoin" in p and "a#" in p.split("SortMergeJoin")[1].split("]")[0]]


def test_details_of_an_entity_are_put_together_where_its_items_are(spark):
    """One deal of the items by their key, and no join of an entity's parts; an item as early as the lead isn't the lead."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cite = "array<struct<source:string,chunk_id:string,location:string,page_number:int,section:string,image_url:string>>"
        schema = f"entity_id string, source string, snippet string, attrs map<string,string>, edges array<struct<type:string,target:string>>, citations {cite}, pos long"
        rows = [
            ("a", "vector", None, {"p": "1", "q": " "}, [("IN", "x"), ("IN", "y")], None, 1),
            ("a", "text", "bb", {"p": "2"}, [("IN", "y"), (None, None)], [], 2),
            ("a", "graph", "cc", {"q": "3"}, None, [("s", "1", None, None, None, None)] * 2, 2),
            ("b", "graph", None, None, None, None, 1),
        ]
        out = M.merged_details(spark.createDataFrame(rows, schema), ["pos"])
        assert _plan(out).split("Initial Plan")[0].count("Exchange hashpartitioning") == 1 and "Join" not in _plan(out)
        got = {r.entity_id: (r.snippet, r.attrs, r.edges and [tuple(e) for e in r.edges], r.citations and [tuple(c) for c in r.citations]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got["a"] == ("bb", {"p": "2", "q": "3"}, [("IN", "y"), (None, None), ("IN", "x")], [("s", "1", None, None, None, None)])
    assert got["b"] == (None, None, None, None)


def test_a_skeleton_is_kept_in_one_pass_over_the_edges(spark, sf_dir):
    out = QUERIES["clear_keep_skeleton"](spark, sf_dir)
    assert _plan(out).count("REPARTITION_BY_NUM") == 2  # the two kinds of distinct pairs, once each
    catalog = Catalog(spark, sf_dir)
    keep = {r.id for r in catalog.nodes().where("label <> 'Part'").collect()}
    edges = catalog.edges().collect()
    got, kept = out.first(), sum(e.src in keep and e.dst in keep for e in edges)
    assert (got.kept_nodes, got.kept_edges, got.removed_edges) == (len(keep), kept, len(edges) - kept)
