"""Counts and scores against plain dictionaries, with tries that burst and spill all the time."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphmill.llm import collocation as C
from tests.llm.common import SCHEMA, awkward, documents


def _grams(rows):
    """Counts of 1 to 3 words by language, and the number of words."""
    n, f = Counter(), {}
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    return n, f


def _brute(rows, least, share, top):
    n, counts = _grams(rows)
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in often.items():
            if any(len(q) > len(p) and 100 * b >= share * a and p in [q[i : i + len(p)] for i in range(len(q) - len(p) + 1)] for q, b in often.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def _rows(seed, n=60):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gämma", "de lta", "x-y", "#", "　z", "eta"]
    texts = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(0, 40)):
            text += rng.choices(words, [9, 8, 4, 3, 2, 2, 1, 1])[0] + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " "])
        texts.append((rng.randrange(9), text, rng.choice(["en", "de", None, "und"])))
    return awkward() + [(i, t, lang, "s", 0, 0.0, 0, 0, 0, 0) for i, t, lang in texts]


@pytest.mark.parametrize("top", [2000, 3])
def test_against_dictionaries(spark, monkeypatch, top):
    rows = _rows(1)
    got = sorted(tuple(r) for r in C.collocations(documents(spark, rows), least=4, top=top).collect())
    assert got == _brute(rows, 4, 50, top) and len(got) > 5


def test_tries_that_burst_spill_and_start_anew(monkeypatch):
    monkeypatch.setattr(C, "BURST", 4)
    monkeypatch.setattr(C, "FAN", 3)
    monkeypatch.setattr(C, "SPILL", 25)
    monkeypatch.setattr(C, "VOCABULARY", 12)
    rows = _rows(2)
    batch = pa.RecordBatch.from_pydict({"lang": pa.array(["und" if r[2] is None else r[2] for r in rows]), "text": pa.array([r[1] for r in rows])})
    runs = pa.Table.from_batches([b for k in range(0, len(rows), 7) for b in list(C._count(5)(iter([batch.slice(k, 7)])))])
    assert runs.num_rows > 20
    got = {}
    for cell in set(runs["cell"].to_pylist()):
        for r in C._merge(1)(runs.filter(pa.compute.equal(runs["cell"], cell))).to_pylist():
            key = (r["lang"], tuple(w for w in (r["first"], r["second"], r["third"]) if w is not None))
            if key[1]:
                assert key not in got  # a phrase meets in one cell
            got[key] = got.get(key, 0) + r["n"]
    n, f = _grams(rows)
    want = {(lang, p): a for lang, own in f.items() for p, a in own.items()} | {(lang, ()): a for lang, a in n.items() if a}
    assert got == want


def test_a_trie_counts_like_a_dictionary(monkeypatch):
    monkeypatch.setattr(C, "BURST", 8)
    rng = np.random.default_rng(1)
    trie, want = C.Trie(), Counter()
    for _ in range(20):
        ids = rng.integers(1, 9, size=(50, 3))
        ids[:25, 0] = 5  # a common first word bursts again, by the second
        keys, counts = np.unique(ids[:, 0] << 42 | ids[:, 1] << 21 | ids[:, 2], return_counts=True)
        trie.add(keys, counts)
        want.update(dict(zip(keys.tolist(), counts.tolist())))
    assert trie.size == len(want)
    keys, counts = trie.spilled(len(want) // 2)
    rest = trie.taken()
    assert 0 < len(keys) < len(want) and dict(zip(np.concatenate([keys, rest[0]]).tolist(), np.concatenate([counts, rest[1]]).tolist())) == want


def test_scores_over_64_bits_and_empty_table(spark):
    row = spark.createDataFrame([(4_000_000_000_000, 5_000_000_000_000, 9_000_000_000_000)], "a long, l long, r long")
    assert row.select(C._score("a", "l", "r").alias("s")).first()["s"] == 1_000_000 * 4_000_000_000_000**2 // (5_000_000_000_000 * 9_000_000_000_000)
    assert C.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
