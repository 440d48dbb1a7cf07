"""Construction, merging and chunking rules against their definitions, step by step in Python."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from graphmill.functions import text as X
from graphmill.operators import build as B
from graphmill.operators import chunking as C
from graphmill.operators import fusion as M

RULES = {("s", "t"): ("REQUIRES", 0.7), ("t", "t"): ("ADJACENT", 0.4)}
INVERSES = {"REQUIRES": "REQUIRED_BY"}


def cooccurring(mentions, existing, window, least, plain):
    """Edges added one after another, document by document, pairs in order."""
    graph = {(a, r, b) for a, r, b in existing}
    kind = {e: t for _, _, e, t in mentions}
    out = []
    for doc in sorted({m[0] for m in mentions}):
        chunks: dict = {}
        for d, s, e, _ in mentions:
            if d == doc:
                chunks.setdefault(s, set()).add(e)
        seq = [chunks[s] for s in sorted(chunks)]
        count: dict = {}
        for i, own in enumerate(seq):
            for j, other in enumerate(seq):
                if i != j and abs(i - j) <= window:
                    for a in own:
                        for b in other:
                            if a != b:
                                count[a, b] = count.get((a, b), 0) + 1
        for (a, b), n in sorted(count.items()):
            if n < least:
                continue
            rel, conf = RULES.get((kind[a], kind[b]), ("CO_OCCUR", 0.5))
            if rel != "CO_OCCUR" or n >= max(least, 3):
                conf = max(conf, 0.6)
            if rel == "CO_OCCUR" and not plain:
                continue
            if any(r != "CO_OCCUR" for x, r, y in graph if (x, y) in ((a, b), (b, a))) or (a, rel, b) in graph:
                continue
            new = [(a, rel, b, conf, n, doc, False)] + ([(b, INVERSES[rel], a, conf, n, doc, True)] if rel in INVERSES else [])
            out += new
            graph |= {(e[0], e[1], e[2]) for e in new}
    return sorted(out)


def test_cooccurrence_edges(spark):
    rng = random.Random(4)
    kinds = {f"e{i}": rng.choice("stuu") for i in range(14)}
    mentions = sorted({(d, rng.randrange(0, 40), e, kinds[e]) for d in range(4) for e in rng.choices(sorted(kinds), k=30)})
    existing = [("e1", "OWNS", "e2"), ("e3", "CO_OCCUR", "e4"), ("e5", "OWNS", "e6")]
    m = spark.createDataFrame(mentions, "doc_id long, sequence long, entity string, type string")
    e = spark.createDataFrame(existing, "src string, rel string, dst string")
    for window, least, plain in ((3, 2, True), (1, 1, True), (5, 4, False)):
        got = sorted(map(tuple, B.cooccurrence_edges(m, e, RULES, window, least, plain).collect()))
        assert got == cooccurring(mentions, existing, window, least, plain) and got


def folded(items):
    """Two by two: the text source is the base, else what came first."""

    def merge(a, b):
        base, other = (a, b) if (a["source"] == "text") or b["source"] != "text" else (b, a)
        attrs = {k: v for k, v in other["attrs"].items() if v.strip()} | {k: v for k, v in base["attrs"].items() if v.strip()}
        snippet = base["snippet"] if len(base["snippet"]) >= len(other["snippet"]) else other["snippet"]
        return {"source": base["source"], "attrs": attrs, "snippet": snippet, "edges": list(dict.fromkeys(base["edges"] + other["edges"])), "citations": list(dict.fromkeys(base["citations"] + other["citations"]))}

    out: dict = {}
    for i in items:
        out[i["id"]] = merge(out[i["id"]], i) if i["id"] in out else merge(i, {**i, "source": i["source"]})
    return out


def test_merged_details(spark):
    rng = random.Random(2)
    items = []
    for pos in range(200):
        edges = [(rng.choice("xy"), f"t{rng.randrange(4)}") for _ in range(rng.randrange(3))]
        cites = [(rng.choice(["a", None]), f"c{rng.randrange(3)}", None, rng.choice([1, None]), "s", None) for _ in range(rng.randrange(3))]
        items.append({"id": f"e{rng.randrange(12)}", "source": rng.choice(["text", "vector", "graph"]), "snippet": "z" * rng.randrange(4) + rng.choice("ab"), "attrs": {k: rng.choice(["", " ", f"v{pos}"]) for k in rng.sample("pqr", 2)}, "edges": edges, "citations": cites, "pos": pos})
    schema = "entity_id string, source string, snippet string, attrs map<string,string>, edges array<struct<type:string,target:string>>, citations array<struct<source:string,chunk_id:string,location:string,page_number:int,section:string,image_url:string>>, pos long"
    df = spark.createDataFrame([(i["id"], i["source"], i["snippet"], i["attrs"], i["edges"], i["citations"], i["pos"]) for i in items] + [(None, "text", "x", {}, [], [], 1)], schema)
    got = {r.entity_id: (r.snippet, r.attrs or {}, [tuple(e) for e in r.edges or []], [tuple(x) for x in r.citations or []]) for r in M.merged_details(df, ["pos"]).collect()}
    assert got == {k: (v["snippet"], v["attrs"], v["edges"], v["citations"]) for k, v in folded(items).items()}


def test_simple_chunks(spark):
    assert C.simple_cuts("a\n\nb", 100, 10, "\n\n") == ["a\n\nb"]
    assert C.simple_cuts("aaaa\n\nbbbb\n\ncc", 8, 3, "\n\n") == ["aaaa", "aaabbbb", "bbbcc"]
    assert C.simple_cuts("", 8, 3, "\n\n") == [] and C.simple_cuts(" \n\n \n\n", 3, 2, "\n\n") == []
    rng = random.Random(3)
    texts = ["\n\n".join("w" * rng.randrange(0, 30) for _ in range(rng.randrange(1, 12))) for _ in range(20)]
    rows = C.simple_chunks(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string"), 40, 5).collect()
    for i, t in enumerate(texts):
        own = [r.content for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.sequence)]
        assert sum(c.count("w") for c in own) - 5 * max(0, len(own) - 1) <= t.count("w") <= sum(c.count("w") for c in own)
        assert all(len(c) <= 5 + 40 for c in own) and all(b.startswith(a[-5:].lstrip()) for a, b in zip(own, own[1:]))
    assert not [r for r in rows if r.doc_id == len(texts)]


def test_small_chunks_around_images(spark):
    rows = [(1, 1, "a", "text", 1, 1), (1, 2, "b ", "table", 2, 3), (1, 3, "i", "image", 3, 3), (1, 4, " c", "text", 4, 4), (1, 5, "x" * 100, "text", 5, 5), (1, 6, "d", "text", 6, 6), (2, 1, "e", "text", 9, 9)]
    got = C.merged_small(spark.createDataFrame(rows, "doc_id long, sequence int, content string, content_type string, first_page int, last_page int")).orderBy("doc_id", "sequence").collect()
    assert [tuple(r) for r in got] == [(1, 1, "a\n\nb", "text", 1, 3, 2), (1, 2, "i", "image", 3, 3, 1), (1, 3, "c", "text", 4, 4, 1), (1, 4, "x" * 100, "text", 5, 5, 1), (1, 5, "d", "text", 6, 6, 1), (2, 1, "e", "text", 9, 9, 1)]


def test_words_name_types_and_perspectives(spark):
    names = {"手术间": "空间", "急诊部": "功能分区", "设计原则": "设计方法", "某项目": "案例", "建筑规范": "资料来源", "《某室》": "资料来源", "a.PDF": "资料来源", "": "空间", None: "空间", "other": "空间"}
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", X.soft_type(F.col("name")).alias("t")).collect()
    assert {r.name: r.t for r in rows} == names
    cases = {("GB 50", None): "规范要求", ("学术论文", "x"): "学术观点", ("", "图集书籍"): "案例数据", (None, "会议纪要"): "会议纪要", ("杂", "x"): "现状调研", (None, None): "现状调研", ("管理", "规范标准"): "运营建议"}
    rows = spark.createDataFrame(list(cases), "c string, s string").select("c", "s", X.perspective(F.col("c"), F.col("s")).alias("p")).collect()
    assert {(r.c, r.s): r.p for r in rows} == cases


def test_citations(spark):
    cases = {
        "a [1,2,3,4,5,6] b": "a [1][2][3][4][5][6] b",
        "[1，2、3][9]": "[1][2][3][9]",
        "[x] [1, y] [12]": "[x] [1, y] [12]",
        "": "",
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", X.split_citation_groups(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == cases
    ranges = {"[3-1] x [5~5] [1–40]": "[1][2][3] x [5] [1][40]", "[a-b]": "[a-b]"}
    rows = spark.createDataFrame([(t,) for t in ranges], "t string").select("t", X.expanded_citation_ranges(F.col("t")).alias("o")).collect()
    assert {r.t: r.o for r in rows} == ranges
    runs = {"a [3] [1][2] b [7]": ("a [1][2][3]b [7]", "a [1-3]b [7]"), "[5][5]": ("[5]", "[5]"), "[1][3][4]": ("[1][3][4]", "[1][3][4]"), "none": ("none", "none")}
    rows = spark.createDataFrame([(t,) for t in runs], "t string").select("t", X.sorted_citation_runs(F.col("t")).alias("s"), X.collapsed_citation_runs(F.col("t")).alias("c")).collect()
    assert {r.t: (r.s, r.c) for r in rows} == runs


def test_numerals_before_suffixes(spark):
    rows = [("Ⅲ级 手术 室",), ("二类", ), ("III 级",), ("一二三",), ("XIV level",), (None,), ("第三 区",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(X.normalize_numbers(F.col("s"))).collect()]
    assert got == ["3级手术室", "2类", "3级", "一二三", "XIVlevel", None, "第3区"]


def test_aliases_by_type(spark, tmp_path):
    from graphmill.sources.files import canonicalized, read_aliases

    (tmp_path / "alias.json").write_text('{"Room": {"OR  II level": "Theatre", "ＯＲ": "theatre"}, "Zone": {"or": "sector"}}', encoding="utf-8")
    table = read_aliases(spark, str(tmp_path / "alias.json"))
    assert {tuple(r) for r in table.collect()} == {("Room", "or2level", "theatre"), ("Room", "or", "theatre"), ("Zone", "or", "sector")}
    rows = spark.createDataFrame([(1, "Or", "Room"), (2, "OR", "Zone"), (3, "or", "Else"), (4, None, "Room")], "id int, name string, type string")
    got = {r["id"]: r["canonical"] for r in canonicalized(rows, table).collect()}
    assert got == {1: "theatre", 2: "sector", 3: "or", 4: ""}


def test_images_where_a_text_has_no_place_for_them(spark):
    rows = [
        ("one", ["a"], "one\n\n(Figure 1: a)\n[IMG:1]"),
        ("one\n\ntwo\n\nthree", ["a", "b", "c"], "one\n\ntwo\n\n(Figure 1: a)\n[IMG:1]\n\nthree\n\n(Figure 2: b)\n[IMG:2]\n\n(Figure 3: c)\n[IMG:3]"),
        ("has [IMG:1]", ["a", "b"], "has [IMG:1]"),
        ("none", [], "none"),
        ("x\n### E\np\n### F\nq", ["a"], "x\n### E\np\n\n(Figure 1: a)\n[IMG:1]\n\n### F\nq"),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "t string, c array<string>")
    assert [r[0] for r in df.select(X.injected_images(F.col("t"), F.col("c"), "E", "S")).collect()] == [r[2] for r in rows]


def test_tables_without_citations_stay(spark):
    rows = ["a | b\nno rule | here [1]\n", "| a |  b |\n|---|---|\n| x |  y |", "[1]\n|a|b|\n|-|-|\n|x [2]|y [2][3]|\n|z|w|\nafter [4]"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(X.moved_table_citations(F.col("t"), "by ")).collect()]
    assert got == [*rows[:2], "[1]\n|a|b|\n|-|-|\n|x |y |\n|z|w|\n\nby [2][3]\n\nafter [4]"]


def test_hits_have_all_phrases(spark):
    from graphmill.operators.retrieval import with_phrases

    hits = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (1, 3)], "query_id int, doc_id int")
    phrases = spark.createDataFrame([(1, "Big dog"), (1, "a cat")], "query_id int, phrase string")
    texts = spark.createDataFrame([(1, "A cat and a BIG dog"), (2, "a big brown dog, a cat"), (3, None)], "doc_id int, text string")
    assert {tuple(r) for r in with_phrases(hits, phrases, texts).collect()} == {(1, 1), (2, 1), (2, 2)}


def test_containing_is_all_pairs_that_contain(spark):
    from graphmill.operators.joins import containing

    rng = random.Random(5)
    made = lambda n: "".join(rng.choice("ab室é \n") for _ in range(n))
    texts = [(rng.choice("xy"), i, made(rng.randrange(0, 40))) for i in range(60)] + [("x", 99, None), (None, 98, "ab")]
    words = [(rng.choice("xy"), i, made(rng.randrange(0, 8))) for i in range(60)] + [("x", 99, None), (None, 98, "ab")]
    got = containing(spark.createDataFrame(texts, "k string, text_id int, text string"), spark.createDataFrame(words, "k string, word_id int, word string"), ["k"])
    want = {(k, i, j) for k, i, t in texts for q, j, w in words if k is not None and k == q and t is not None and w and w in t}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want and len(want) > 200


def test_spaces_methods_and_points(spark):
    from graphmill.operators import graph as G

    points = spark.createDataFrame([("a", "p1", "An Operating room plan", None), ("a", "p2", "x", ["theatre"]), ("a", "p3", None, []), ("b", "p4", "ward", [])], "answer string, id string, text string, applies array<string>")
    spaces = spark.createDataFrame([("a", "s1", "operating Room"), ("a", "s2", "Theatre 2"), ("a", "s3", "a lobby"), ("b", "s4", "WARD")], "answer string, id string, name string")
    got = {(r["src"], r["dst"], float(r["weight"])) for r in G.space_edges(points, spaces).collect()}
    assert got == {("p1", "s1", 0.7), ("p2", "s2", 0.9), ("p4", "s4", 0.7)}
    rules = [("k1", "one way"), ("k2", "two"), ("k3", "three"), ("k4", "four")]
    questions = spark.createDataFrame([("a", "K3 please"), ("b", None)], "answer string, text string")
    items = spark.createDataFrame([("a", 2, "k1 k3"), ("a", 1, "k4"), ("a", 3, "k2"), ("b", 1, None)], "answer string, id int, name string")
    found = G.inferred_methods(questions, items, rules)
    assert {tuple(r) for r in found.collect()} == {("a", "three", 1), ("a", "four", 2), ("a", "one way", 3)}
    known = spark.createDataFrame([("a", "p1", "a long WAY"), ("a", "p2", None), ("b", "p3", "three")], "answer string, id string, text string")
    edges = {tuple(r) for r in G.method_edges(found, known, spaces.where("id = 's1'")).collect()}
    assert {(e[1], e[2], e[3]) for e in edges} == {("three", "GUIDES", "s1"), ("four", "GUIDES", "s1"), ("one way", "GUIDES", "s1"), ("one way", "MENTIONED_IN", "p1")}


def test_citations_have_their_fields(spark):
    df = spark.createDataFrame([("s", None, "/api/v1/f", "old"), (None, "x", "", "/api/v1x"), ("", "y", None, None)], "source string, snippet string, pdf_url string, pdfUrl string")
    fields = {n: F.col(n) for n in df.columns} | {"chunk_id": F.lit(7)}
    rows = [r[0].asDict() for r in df.select(X.complete_citation(fields, "/r")).collect()]
    assert [(r["source"], r["location"], r["snippet"], r["pdf_url"], r["chunk_id"]) for r in rows] == [("s", "", "", "/f", 7), ("unknown source", "", "x", "/api/v1x", 7), ("unknown source", "", "y", None, 7)]
    where = [r[0] for r in spark.createDataFrame([(1, "c", "t", "s"), (None, "c", None, "s"), (2, "", "t", " ")], "p int, c string, t string, s string").select(X.page_location(*map(F.col, "pcts"))).collect()]
    assert where == ["1|c t|s", "s", "2|t"]


def test_mentions_that_cannot_be_near_often_make_no_pairs(spark):
    once = [(d, s, f"e{d}-{s}") for d in range(3) for s in range(40)]
    rows = once + [(1, s, "often") for s in (3, 4, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, at long, entity string")
    pairs = lambda own, least: {(d, a, b, n) for d, a, b, n in B.near_mentions(own, "at", 3, least).groupBy("doc_id", "entity", "entity_r").count().collect() if n >= least}
    assert B.near_mentions(frame.where("entity <> 'often'"), "at", 3, 2).isEmpty()
    for least in (1, 2, 3, 4):
        by_hand = Counter((d, a, b) for d, s, a in rows for e, t, b in rows if d == e and a != b and 0 < abs(s - t) <= 3)
        assert pairs(frame, least) == {(*k, n) for k, n in by_hand.items() if n >= least}
