from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from graphmill.llm import decontaminate as D
from tests.llm.common import SCHEMA, WORDS, awkward, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def cut(text):
    return WORD.findall((text or "").translate(UP))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = cut(text), set(), set()
        for item_id, t in items:
            own = cut(t)
            n = min(13, len(own))
            windows = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
        out.append((-1 if doc_id is None else doc_id, len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


@pytest.mark.parametrize("lengths", [(13, 30), (1, 30), (20, 40)])
def test_against_brute_force(spark, lengths):
    rng = random.Random(lengths[0])
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(*lengths)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, items[0][1]), (3, items[3][1])]
    rows = [(r[0], r[1]) for r in awkward()]
    for i in range(40):
        own = rng.choice(items[:25])[1].split()
        a, b = sorted((rng.randrange(len(own) + 1), rng.randrange(len(own) + 1)))
        noise = [rng.choice(WORDS) for _ in range(rng.randrange(30))]
        rows.append((1000 + i, " ".join(noise[:5] + own[a:b] + noise[5:] + (own if i % 4 == 0 else [])).upper() + "!"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in D.find(docs, bench).collect())
    assert got == brute(rows, items)


def test_one_passage_in_many_items_and_ids_of_any_type(spark, monkeypatch):
    """A boilerplate passage that all items and many documents have; nothing broadcast; clashing columns; string ids."""
    monkeypatch.setattr(D, "BROADCAST", 0)
    monkeypatch.setattr(D, "KEYS", 0)
    rng = random.Random(11)
    passage = " ".join(rng.choice(WORDS) for _ in range(40))
    items = [(f"i{i}", passage + f" {i} " + " ".join(rng.choice(WORDS) for _ in range(15))) for i in range(30)] + [("rep", "la " * 60)]
    rows = [(f"d{i}", f"{i} " + passage if i % 2 else "la " * (40 + i)) for i in range(20)] + [(None, passage), (None, passage), ("d1", "other")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(7) for c in ("_a", "_b", "_words", "_fp", "item_id", "n_hit")})
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = sorted(("-" if r.doc_id is None else r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in D.find(docs, bench).collect())
    assert got == sorted(("-" if d == -1 else d, *rest) for (d, *rest) in [brute([r], items)[0] for r in rows])
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {"d1"}


def test_a_very_long_text(spark):
    rng = random.Random(12)
    item = " ".join(rng.choice(WORDS) for _ in range(13))
    text = "filler word " * 150_000 + item + " more" * 10
    (row,) = D.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (300_023, 13, ["5"])


def test_main_path_is_native(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plan = D.find(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_drop_and_empty_tables(spark):
    docs = documents(spark)
    passage = awkward()[10][1]
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = D.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in kept.select("doc_id").collect()} == {8, 9, 10, None}
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.drop_contaminated(docs, none).count() == docs.count()
    assert D.find(spark.createDataFrame([], SCHEMA), bench).count() == 0
