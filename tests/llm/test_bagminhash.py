from __future__ import annotations

import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphmill.llm import bagminhash as B
from graphmill.llm.textarrays import flat
from tests.llm.common import SCHEMA, WORDS, awkward, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def brute_rows(rows):
    """For each row the (doc_id, text) that its class starts with, by all pairs of texts; None where it is in none."""
    texts = sorted({(r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None}, key=lambda x: (x[0], sha256(x[1].encode()).digest()))
    bags = [bag(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (x, (_, s)) in enumerate(zip(bags, texts)):
        for j, (y, (_, t)) in enumerate(zip(bags[:i], texts)):
            both = sum((x & y).values())
            if s == t or (both and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both) - 1e-9):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    at = {t: find(i) for i, t in enumerate(texts)}
    return [texts[at[r[0], r[1]]] if (r[0], r[1]) in at else None for r in rows]


def brute(rows):
    """Class of each doc_id; doc_ids are different."""
    return {r[0]: r[0] if first is None else first[0] for r, first in zip(rows, brute_rows(rows)) if r[0] is not None}


def test_signature_agreement_is_weighted_jaccard():
    rng = random.Random(6)
    texts = []
    for repeat in (1, 3, 9):
        a = [rng.choice(WORDS[:6]) for _ in range(60)] * repeat
        b = list(a)
        for i in range(0, len(b), 25):
            b[i] = "new"
        texts += [" ".join(a), " ".join(b)]
    buffer, offsets = flat(pa.array(texts))
    owner, code, count = B.shingles(buffer, offsets)
    sign = B.signatures(owner, code, count, len(texts), components=4096)
    for i in range(0, len(texts), 2):
        x, y = bag(texts[i]), bag(texts[i + 1])
        both = sum((x & y).values())
        true = both / (sum(x.values()) + sum(y.values()) - both)
        assert abs((sign[i] == sign[i + 1]).mean() - true) < 5 * np.sqrt(true * (1 - true) / 4096) + 1e-3


def check(spark, docs, rows):
    """classes() and keep_one() against brute force."""
    want = brute_rows(rows)
    classes = Counter((r[0], r[0] if f is None else f[0]) for r, f in zip(rows, want))
    assert Counter(map(tuple, B.classes(docs).collect())) == classes
    kept = B.keep_one(docs)
    assert kept.columns == docs.columns
    stay = {(r[0], r[1]) for r, f in zip(rows, want) if f == (r[0], r[1])}
    others = Counter((r[0], r[1]) for r, f in zip(rows, want) if f is None)
    assert Counter((r.doc_id, r.text) for r in kept.select("doc_id", "text").collect()) == Counter(stay) + others


def test_awkward_rows(spark):
    check(spark, documents(spark), awkward())


def test_repeated_ids_with_different_texts(spark):
    """No text goes because another one has its doc_id; only copies go."""
    rng = random.Random(4)
    own = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(6)]
    near = own[0].split()
    near[30] = "other"
    rows = [(5, own[0]), (5, own[1]), (5, own[1]), (7, " ".join(near)), (7, own[2]), (3, own[1]), (9, own[2]), (9, own[3]), (None, own[4]), (None, own[5]), (None, own[0]), (1, None), (1, None), (1, ""), (2, "")]
    rows = [(*r, *[None] * 8) for r in rows]
    check(spark, documents(spark, rows), rows)


def test_ids_of_any_type_and_clashing_columns(spark):
    rows = [("b", "one two three four five six", 1), ("a", "one two three four five six", 2), ("c", "other", 3)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, _digest long").withColumns({"node": F.lit(1), "class_id": F.lit(2), "digest": F.lit(3), "first": F.lit(4)})
    assert {tuple(r) for r in B.classes(docs).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}
    kept = B.keep_one(docs)
    assert kept.columns == docs.columns and {(r.doc_id, r["_digest"]) for r in kept.collect()} == {("a", 2), ("c", 3)}


def test_very_long_texts(spark):
    """Two near copies of a megabyte and one other text."""
    rng = random.Random(9)
    long = [rng.choice(WORDS) for _ in range(200_000)]
    near = list(long)
    near[1000:2000] = ["x"] * 1000
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[::-1]))]
    got = {tuple(r) for r in B.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 3)}


@pytest.mark.parametrize("seed", [1, 2])
def test_families_against_brute_force(spark, monkeypatch, seed):
    """Copies that differ more and more, so that a bucket's smallest document doesn't reach them all; small blocks."""
    monkeypatch.setattr(B, "SIDE", 8)
    monkeypatch.setattr(B, "BLOCK_ROWS", 8)
    monkeypatch.setattr(B, "CELL", 4)
    rng = random.Random(seed)
    base = [rng.choice(WORDS) for _ in range(90)]
    rows = []
    for i in range(90):
        own = list(base)
        for _ in range(rng.randrange(0, 5)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(40)}"
        rows.append((i * 3 % 271, " ".join(own), *[None] * 8))
    chain = list(base[::-1])
    for i in range(30):  # each near the one before only
        chain[i * 3] = f"c{i}"
        rows.append((1000 + i, " ".join(chain), *[None] * 8))
    got = {r.doc_id: r.class_id for r in B.classes(documents(spark, rows)).collect()}
    assert got == brute(rows)


def test_empty(spark):
    assert B.classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert B.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
