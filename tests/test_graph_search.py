"""Searches from both ends against enumeration on random multigraphs."""

from __future__ import annotations

import random
from collections import deque

import pytest

from graphmill.operators import graph as G


def _graph(seed, nodes, edges):
    rng = random.Random(seed)
    rows = {(f"n{rng.randrange(nodes)}", rng.choice(["r", "s"]), f"n{rng.randrange(nodes)}") for _ in range(edges)}
    return sorted(rows | {("n1", "loop", "n1"), ("far1", "r", "far2")})


def _ways(rows):
    out = {}
    for e in rows:
        a, _, b = e
        out.setdefault(a, []).append((b, e))
        if a != b:
            out.setdefault(b, []).append((a, e))
    return out


def _shortest(rows, start, end, most):
    """By levels from the start; of several parents the smallest."""
    if start == end:
        return [start]
    ways, dist = _ways(rows), {start: 0}
    queue = deque([start])
    while queue:
        at = queue.popleft()
        for b, _ in ways.get(at, []):
            if b not in dist:
                dist[b] = dist[at] + 1
                queue.append(b)
    if dist.get(end, most + 1) > most:
        return []
    path = [end]
    while path[-1] != start:
        path.append(min(b for b, _ in ways[path[-1]] if dist.get(b) == dist[path[-1]] - 1))
    return path[::-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths(spark, seed):
    rows = _graph(seed, 24, 30)
    edges = spark.createDataFrame(rows, "src string, rel string, dst string")
    for start, end, most in [("n1", "n2", 6), ("n3", "n9", 4), ("n1", "far2", 6), ("n5", "n5", 6), ("n4", "n17", 2)]:
        got = [(r["step"], r["id"]) for r in G.shortest_path(edges, start, end, most).orderBy("step").collect()]
        assert got == list(enumerate(_shortest(rows, start, end, most))), (start, end, most)


def _trails(rows, starts, ends, low, high):
    ways, out = _ways(rows), []

    def walk(path, used):
        if low <= len(used) and (ends is None or path[-1] in ends):
            out.append((len(used), " - ".join(path)))
        if len(used) < high:
            for b, e in ways.get(path[-1], []):
                if e not in used:
                    walk([*path, b], [*used, e])

    for s in starts:
        walk([s], [])
    return sorted(out)


@pytest.mark.parametrize("ends", [["n2", "n7"], None])
def test_trails(spark, ends):
    rows = _graph(4, 10, 16)
    edges = spark.createDataFrame(rows, "src string, rel string, dst string")
    got = [(r["hops"], r["path"]) for r in G.trails(edges, ["n1", "n3", "none"], ends, 2, 4, 10_000).collect()]
    assert got == sorted(got) and sorted(got) == _trails(rows, ["n1", "n3"], ends, 2, 4)
