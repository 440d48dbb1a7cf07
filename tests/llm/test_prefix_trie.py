"""The prefix trie against one that is built turn by turn, with several blocks, ties, nulls and repeated rows."""

from __future__ import annotations

import hashlib
import random
import zlib

from graphmill.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, place long, n_convs string"


def _sequences(rows):
    convs = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role or "", text or ""))
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}:{t}".encode()).hexdigest()
    for own in convs.values():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], digest(x[1], x[2])))
    own = {c: [(r, t) for _, r, t in v] for c, v in convs.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + own[c][h:]
    return out


def _brute(sequences):
    nodes = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = set()
    for node, members in nodes.items():
        below = [n for n in nodes if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(nodes[n]) - 1) * len(n[-1][1].encode()) for n in below if n)
        ends = sorted(c for c in members if len(sequences[c]) == len(node))
        parent = min(nodes[node[:-1]]) if node else None
        out.add((min(members), len(node), parent, len(members), len(children), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return out


def _got(spark, rows, width):
    frame = T.trie(T.rebuilt(T.turns(spark.createDataFrame(rows, SCHEMA).repartition(3))), width)
    assert frame.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = [tuple(r) for r in frame.collect()]
    assert len(got) == len(set(got))
    return set(got)


def _rows(seed, convs=40, most=14):
    rng = random.Random(seed)
    rows = []
    for c in [*range(convs), 1000, -7, -10]:
        n = rng.randrange(1, most)
        for turn in range(n):
            text = rng.choice(["a", "b", "ü", "", None]) if turn < 3 else rng.choice(["a", "b"])
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", text, 5, 6, "x"))
    rows += [(3, None, None, "first", 1, 1, ""), (3, 1, "user", "tie", 1, 1, ""), rows[0], rows[0], (None, 1, "user", "lost", 1, 1, "")]
    return rows


def test_against_a_trie_built_by_turns(spark):
    rows = _rows(3)
    assert _got(spark, rows, 8) == _brute(_sequences(rows))


def test_blocks_continue_long_conversations(spark, monkeypatch):
    """Two columns a block: up to seven blocks, and positions and sums that are carried over cells."""
    monkeypatch.setattr(T, "CELL", 3)
    rows = _rows(4, convs=18)
    assert _got(spark, rows, 2) == _brute(_sequences(rows))


def test_equal_conversations_and_empty_table(spark):
    rows = [(c, t, "user", "same", 0, 0, "") for c in range(0, 50, 5) for t in range(9)]
    assert _got(spark, rows, 4) == _brute(_sequences(rows))
    assert _got(spark, [], 8) == set()
    alone = [(1, 0, "user", "x", 0, 0, "")]  # no base, and its own turn is before h: a member of the root alone
    assert _sequences(alone) == {1: []} and _got(spark, alone, 8) == _brute({1: []})
