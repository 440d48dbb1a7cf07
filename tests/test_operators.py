from __future__ import annotations

import difflib
import random

from pyspark.sql import functions as F

from graphmill.functions import text as X
from graphmill.operators import build as B
from graphmill.operators import chunking as C
from graphmill.operators import graph as G
from graphmill.operators import retrieval as R
from graphmill.operators import sets as U
from graphmill.operators import windows as W
from graphmill.operators.components import connected_components


def test_fuzzy_pairs_against_all_pairs(spark):
    rng = random.Random(1)
    names = {"".join(rng.choice("abcd") for _ in range(rng.randrange(8, 24))) for _ in range(40)}
    for n in sorted(names)[:20]:
        k = rng.randrange(len(n))
        names.add(n[:k] + "z" + n[k + 1 :])
    want = {(a, b) for a in names for b in names if a < b and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.9}
    got = {(r.a, r.b) for r in B.fuzzy_pairs(spark.createDataFrame([("t", n) for n in names], "kind string, name string"), "kind", "name").collect()}
    missed = want - got
    assert got <= want and all(a[: len(a) // 3] != b[: len(b) // 3] and a[-(len(a) // 3) :] != b[-(len(b) // 3) :] for a, b in missed)


def test_fuzzy_pairs_misses_none(spark):
    rng = random.Random(7)
    names = {"seventeen letters", "seventeen letterss", "a" + "x" * 28 + "b", "c" + "x" * 28 + "d", "", "Ünï😀cödé größe", "Ünï😀cödé grösse"}
    for _ in range(60):
        n = "".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 40)))
        names.add(n)
        for _ in range(rng.randrange(1, 4)):  # edits at any place
            k = rng.randrange(len(n) + 1)
            n = n[:k] + rng.choice(["", "z"]) + n[k + rng.randrange(2) :]
            names.add(n)
    want = {(a, b) for a in names for b in names if a < b and difflib.SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.9}
    df = spark.createDataFrame([("t", n) for n in names] + [("u", "seventeen letters"), ("t", None)], "kind string, name string")
    for cell in (B.CELL, 5):
        got = [(r.a, r.b) for r in B.fuzzy_pairs(df, "kind", "name", cell=cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want and ("seventeen letters", "seventeen letterss") in want


def test_latent_candidates_pair_all_entities(spark):
    rng = random.Random(8)
    docs = {d: {f"e{rng.randrange(25):02}" for _ in range(rng.randrange(20))} for d in range(12)}
    known = [("e03", "e01"), ("e02", "e05")]
    count = {}
    for own in docs.values():
        for a, b in ((a, b) for a in own for b in own if a < b and (a, b) not in known and (b, a) not in known):
            count[a, b] = count.get((a, b), 0) + 1
    want = sorted(((a, b, n) for (a, b), n in count.items()), key=lambda r: (-r[2], r[0], r[1]))
    mentions = spark.createDataFrame([(d, e) for d, own in docs.items() for e in sorted(own) * 2] + [(0, None)], "doc_id long, entity string")
    existing = spark.createDataFrame(known, "a string, b string")
    for cell in (B.CELL, 4):
        assert [tuple(r) for r in B.latent_candidates(mentions, existing, 1000, cell).collect()] == want
        assert [tuple(r) for r in B.latent_candidates(mentions, existing, 30, cell).collect()] == want[:30]


def blank_line_chunks(text, most, overlap):
    """The simple chunker's rule over one growing string: parts end in a blank line, a full buffer leaves its tail."""
    done, open_ = [], ""
    for part in (p + "\n\n" for p in text.split("\n\n")):
        if open_ and len(open_) + len(part) > most:
            done.append(open_.strip())
            open_ = done[-1][-overlap:]
        open_ += part
    return [c for c in [*done, open_.strip()] if c]


def test_simple_and_hierarchical_chunks(spark):
    rng = random.Random(2)
    docs = [(i, "\n\n".join("w" * rng.randrange(0, 60) for _ in range(rng.randrange(0, 30)))) for i in range(20)] + [(99, None), (98, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in C.simple_chunks(df, 100, 10).orderBy("sequence").collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {i: c for i, t in docs if t and (c := blank_line_chunks(t, 100, 10))}
    items = spark.createDataFrame([(1, 0, "title", "T"), (1, 1, "text", "a" * 60), (1, 2, "text", "b" * 60), (1, 3, "table", "tab"), (1, 4, "text", "end"), (2, 0, "text", None)], "doc_id long, pos long, kind string, text string")
    rows = [tuple(r)[1:] for r in C.hierarchical_chunks(items, 100, 5).orderBy("doc_id", "sequence").collect()]
    assert rows == [(1, "T", "text", "T\n" + "a" * 60, 0, 1), (2, "T", "text", "aaaaa\n" + "b" * 60, 2, 2), (3, "T", "table", "tab", 3, 3), (4, "T", "text", "end", 4, 4)]


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 200), (None, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {n: find(n) for n in root}


def test_round_robin_is_the_loop(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abcde"), i) for i in range(80)]
    buckets = {}
    for b, i in rows:
        buckets.setdefault(b, []).append(i)
    order = sorted(buckets, key=lambda b: (-len(buckets[b]), b))
    want = [(b, buckets[b][k]) for k in range(80) for b in order if k < len(buckets[b])][:23]
    got = W.round_robin(spark.createDataFrame(rows, "b string, i long"), "b", ["i"], 23).collect()
    assert [(r.b, r.i) for r in got] == want


def test_page_ranges(spark):
    done = spark.createDataFrame([("f", 1, 2), ("f", 3, 4), ("f", 8, 9)], "file string, start long, end long")
    merged = U.merged_ranges(done, "file")
    assert sorted((r.start, r.end) for r in merged.collect()) == [(1, 4), (8, 9)]
    totals = spark.createDataFrame([("f", 10), ("g", 3)], "file string, total long")
    assert sorted((r.file, r.start, r.end) for r in U.pending_ranges(merged, totals, "file").collect()) == [("f", 5, 7), ("f", 10, 10), ("g", 1, 3)]


def test_graph_search(spark):
    edges = spark.createDataFrame([("a", "R", "b"), ("b", "R", "c"), ("d", "R", "c"), ("x", "R", "y"), ("a", "S", "b")], "src string, rel string, dst string")
    assert [(r.step, r.id) for r in G.shortest_path(edges, "a", "d").orderBy("step").collect()] == [(0, "a"), (1, "b"), (2, "c"), (3, "d")]
    assert G.shortest_path(edges, "a", "y").where("step > 0").count() == 0
    seeds = spark.createDataFrame([("a",)], "id string")
    assert {(r.src, r.rel, r.dst) for r in G.neighbourhood(edges, seeds, 2).collect()} == {("a", "R", "b"), ("a", "S", "b"), ("b", "R", "c")}
    got = {r.path for r in G.trails(edges, ["a"], ["a"], 2, 2, 10).collect()}
    assert got == {"a - b - a"}  # there and back by the parallel edge


def test_vector_search_in_blocks_is_the_same(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float((i * k) % 7) for k in range(1, 5)]) for i in range(60)], "id long, vector array<double>")
    queries = rows.where("id % 9 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("q"))
    one = sorted(map(tuple, R.vector_top_k(rows, queries, 5).collect()))
    monkeypatch.setattr(R, "BROADCAST", 2)
    assert sorted(map(tuple, R.vector_top_k(rows, queries, 5).collect())) == one


def test_text_functions_on_literals(spark):
    df = spark.createDataFrame([("Ａ１　ＩＩ level 3", "see [1,2] and [7][2]", "1, 3-5,8", "x {\"a\": 1} y", "in 2024, was 1985")], "name string, cited string, pages string, messy string, years string")
    row = df.select(X.half_width(F.col("name")), X.split_citation_groups(F.col("cited")), X.renumbered_citations(F.col("cited")), X.page_spec(F.col("pages")), X.json_in(F.col("messy")), X.year(F.col("years"))).first()
    assert tuple(row) == ("A1 II level 3", "see [1][2] and [7][2]", "see [1,2] and [1][2]", [1, 3, 4, 5, 8], '{"a": 1}', 2024)


def test_ranges_are_sorted_once_in_partitions_that_follow_the_rows(spark, monkeypatch):
    from graphmill import partitioning
    from graphmill.operators.sets import merged_ranges, pending_ranges

    monkeypatch.setattr(partitioning, "ROWS", 10)
    rows = [(k, s, s + (s * 7 + k) % 5) for k in range(6) for s in range(1, 90, 3 + k)] + [(1, 40, 40)] * 3 + [(7, 5, 2), (7, 5, 2)]
    merged = merged_ranges(spark.createDataFrame(rows, "key long, start long, end long"), "key")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "REPARTITION_BY_NUM" in plan and merged._jdf.queryExecution().toRdd().getNumPartitions() >= len(rows) // 10
    got = pending_ranges(merged, spark.createDataFrame([(k, 100) for k in range(9)], "key long, total int"), "key").collect()
    for k in set(range(9)) - {7}:
        covered = {p for key, s, e in rows if key == k for p in range(s, e + 1)}
        assert sorted(p for r in got if r["key"] == k for p in range(r["start"], r["end"] + 1)) == sorted(set(range(1, 101)) - covered)


def test_dangling_edges_by_either_end(spark):
    from graphmill.operators import aggregates as A

    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    edges = [("a", "r", "b"), ("a", "r", "x"), ("y", "r", "b"), ("y", "r", "x"), (None, "r", "a"), ("z", "r", None)]
    frame = spark.createDataFrame(edges, "src string, rel string, dst string")
    assert A.dangling(nodes, frame).first()["dangling"] == 4  # a null end is unknown, as it is to SQL
    assert A.dangling(nodes, frame.limit(1)).first()["dangling"] == 0
