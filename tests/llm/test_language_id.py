from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from graphmill.llm import language_id as L
from graphmill.llm.queries import op1_language_id
from tests.llm.common import SCHEMA, documents


def grams(texts: dict[str, list[str]]) -> pd.DataFrame:
    rows = {}
    for lang, own in texts.items():
        for t in own:
            b = t.encode()
            for i in range(len(b) - 3):
                key = (lang, int.from_bytes(b[i : i + 4], "big"))
                rows[key] = rows.get(key, 0) + 1
    return pd.DataFrame([(a, g, n) for (a, g), n in rows.items()], columns=["lang", "gram", "n"])


def code_length(model_counts: pd.DataFrame, lang: str, text: bytes) -> float:
    """PPM by its definition: contexts of three bytes and less, escape method C."""
    own = model_counts[model_counts.lang == lang]
    tree: dict[bytes, dict[int, int]] = {}
    for gram, n in zip(own.gram, own.n):
        b = int(gram).to_bytes(4, "big")
        for k in range(4):
            node = tree.setdefault(b[3 - k : 3], {})
            node[b[3]] = node.get(b[3], 0) + int(n)
    bits = 0.0
    for i, s in enumerate(text):
        k = min(i, 3)
        while True:
            node = tree.get(text[i - k : i])
            if node:
                total, kinds = sum(node.values()), len(node)
                if s in node:
                    bits += math.log2((total + kinds) / node[s])
                    break
                bits += math.log2((total + kinds) / kinds)
            if k == 0:
                bits += 8
                break
            k -= 1
    return bits


def test_code_lengths_are_ppm():
    rng = random.Random(3)
    make = lambda alphabet: "".join(rng.choice(alphabet) for _ in range(60))
    counts = grams({"aa": [make("abc ") for _ in range(20)], "bb": [make("bcdü ") for _ in range(20)]})
    model = L.build(counts)
    texts = ["abc abc", "bcd bcd bcd", "zz", "", "a", "ab", "abz abc", "üb", *[make("abcdz ") for _ in range(10)]]
    data = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, data)])
    got = model.code_lengths(np.frombuffer(b"".join(data), np.uint8), offsets)
    for k, b in enumerate(data):
        for j, lang in enumerate(model.languages):
            assert abs(got[k, j] - code_length(counts, lang, b)) < 1e-3, (texts[k], lang)


def test_every_context_is_kept():
    """Over 8,192 contexts of three bytes, in several scripts; a text longer than a piece of four megabytes."""
    rng = random.Random(5)
    scripts = {"aa": "abcdefghijklmnopqrstuvwxyz ", "bb": "".join(map(chr, range(0x400, 0x450))) + " ", "cc": "".join(map(chr, range(0x4E00, 0x4F80)))}
    counts = grams({k: ["".join(rng.choice(v) for _ in range(400)) for _ in range(60)] for k, v in scripts.items()})
    assert len({g >> 8 for g in counts.gram}) > 8192
    model = L.build(counts)
    texts = ["".join(rng.choice(v) for _ in range(80)) for v in scripts.values() for _ in range(4)] + ["abc \u4e05\u0410", "\U0001f642" * 5]
    data = [t.encode() for t in texts]
    got = model.code_lengths(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    for k, b in enumerate(data):
        for j, lang in enumerate(model.languages):
            assert abs(got[k, j] - code_length(counts, lang, b)) < 1e-2, (texts[k], lang)
    long = ("abc def " * ((9 << 20) // 8)).encode()
    whole = model.code_lengths(np.frombuffer(long, np.uint8), np.array([0, len(long)]))[0]
    half = model.code_lengths(np.frombuffer(long[: 4 << 20], np.uint8), np.array([0, 4 << 20]))[0]
    one = model.code_lengths(np.frombuffer(long[:80], np.uint8), np.array([0, 80]))[0] - model.code_lengths(np.frombuffer(long[:72], np.uint8), np.array([0, 72]))[0]
    assert np.allclose(whole - half, one * ((5 << 20) // 8), rtol=1e-4)


def test_held_out_accuracy(spark, sf_dir):
    rows = op1_language_id(spark, sf_dir).where("held_out").toPandas()
    truth = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(truth, on="doc_id")
    assert len(both) > 20 and (both.lang == both.lang_pred).mean() >= 0.95
    assert ((both.score >= 0) & (both.score <= 1)).all()


def test_awkward_rows(spark):
    docs = documents(spark)
    model = L.train(docs)
    rows = L.predict(spark, docs, model).toPandas()
    assert len(rows) == docs.count()
    pred = rows.dropna(subset=["doc_id"]).set_index("doc_id").lang_pred
    assert all(pred[[0, 1, 2, 16]] == "und") and pred[3] == "en"
    kept = L.keep_known(spark, docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()}.isdisjoint({0, 1, 2, 16})


def test_no_labels_and_empty(spark):
    docs = documents(spark).drop("lang").selectExpr("*", "CAST(NULL AS STRING) AS lang")
    assert L.train(docs) is None
    assert {r.lang_pred for r in L.predict(spark, docs, None).collect()} == {"und"}
    empty = spark.createDataFrame([], SCHEMA)
    assert L.train(empty) is None and L.keep_known(spark, empty, None).count() == 0


def test_no_language_is_lost_and_none_is_over_the_bound(spark, monkeypatch):
    """Rows that share one doc_id or have none, rows that are all equal, and an id whose hash is low."""
    read = []
    monkeypatch.setattr(L, "build", lambda counts: read.append(counts))
    german = [(i, f"der kurze satz {i}", "de") for i in range(50)]
    schema = "doc_id long, text string, lang string"
    for english in ([(None, f"words {i} of", "en") for i in range(600)], [(7, f"words {i} of", "en") for i in range(600)], [(7, "words of", "en")] * 600):
        L.train(spark.createDataFrame(german + english, schema).repartition(3), rows_per_language=40)
        counts = read.pop()
        assert set(counts["lang"]) == {"de", "en"}
        texts = {lang: {t for _, t, k in german + english if k == lang} for lang in ("de", "en")}
        for lang, own in texts.items():  # each text has one gram more than bytes - 4, each is read once at most
            assert 0 < counts[counts.lang == lang].n.sum() <= 40 * max(len(t.encode()) for t in own)
    L.train(spark.createDataFrame(german, schema), rows_per_language=10_000)
    want = grams({"de": [t for _, t, _ in german]})
    got = read.pop()
    assert sorted(map(tuple, got[["lang", "gram", "n"]].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_a_task_holds_little_beside_its_batch():
    """Short rows and one very long one: what scoring them takes doesn't grow with the batch."""
    import tracemalloc

    from graphmill.llm.textarrays import flat

    counts = pd.DataFrame({"lang": ["a", "b"] * 50, "gram": [0x61626364 + i for i in range(100)], "n": [1] * 100})
    model = L.build(counts)
    for texts in (["some plain words of a text " * 80] * 2000, ["some plain words of a text " * 160_000]):
        buffer, offsets = flat(pa.array(texts))
        tracemalloc.start()
        bits = model.code_lengths(buffer, offsets)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert bits.shape == (len(texts), 2) and (bits > 0).all() and peak < 40e6
