"""Roles by names, and the order of documents by hand."""

from __future__ import annotations

import random

from graphmill.operators import fusion as M


def _order(docs):
    """docs: (id, n, role, priority) of one answer."""
    groups = {}
    for d in sorted(docs, key=lambda d: (-d[1], d[0])):
        groups.setdefault(d[3], []).append(d)
    queues = []
    for _, own in sorted(groups.items()):
        if len(own) > 3:
            a, b = len(own) // 3, len(own) * 2 // 3
            tiers = [own[:a], own[a:b], own[b:]]
            own = [t[i] for i in range(max(map(len, tiers))) for t in tiers if i < len(t)]
        queues.append(own)
    return [q[i][0] for i in range(max(map(len, queues))) for q in queues if i < len(q)]


def test_roles_and_turns(spark):
    names = {"设计指南": "guide", "User GUIDE": "guide", "图集一": "detail_atlas", "GB 50-1": "code_spec", "标准指南": "guide", "资料集": "macro_atlas", "": "other", None: "other", "x": "other"}
    rows = M.with_roles(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert {r["name"]: r["role"] for r in rows} == names
    rng = random.Random(5)
    roles = ["guide", "detail_atlas", "code_spec", "macro_atlas", "other"]
    docs = [(a, i, rng.randrange(1, 6), roles[p], p) for a, size in ((1, 40), (2, 3), (3, 11), (4, 1)) for i in range(size) for p in [rng.choice([0, 0, 1, 2, 4])]]
    got = {}
    for r in M.view_order(spark.createDataFrame(docs, "answer int, doc_id int, n int, role string, priority int"), ["answer"]).orderBy("answer", "place").collect():
        got.setdefault(r["answer"], []).append(r["doc_id"])
    assert got == {a: _order([d[1:] for d in docs if d[0] == a]) for a in (1, 2, 3, 4)}
