from __future__ import annotations

import re

import numpy as np

import corpus_pipeline as P
from graphmill.llm.queries import VOCABULARY
from graphmill.llm.tokens import Encoder
from tests.llm.test_bagminhash import brute as near_classes
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_substring_dedup import brute as repeats


def test_stages_against_brute_force(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    results = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        path = str(tmp_path / name)
        out.write.parquet(path)
        results[name] = (docs.toPandas(), spark.read.parquet(path).toPandas())
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == columns

    before, after = results["language_id"]
    assert set(after.doc_id) == {d for d, t in zip(before.doc_id, before.text) if t and any(c.isalpha() for c in t)}

    before, after = results["near_dedup"]
    assert set(after.doc_id) == set(near_classes(list(zip(before.doc_id, before.text))).values())

    before, after = results["substring_dedup"]
    kept = {d: k for d, k, _, _ in repeats(list(zip(before.doc_id, before.text)))}
    assert {d: " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)) for d, t in zip(after.doc_id, after.text)} == kept

    before, after = results["decontamination"]
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet").toPandas()
    bad = {d for d, n, hit, _ in contaminated(list(zip(before.doc_id, before.text)), list(zip(bench.item_id, bench.text))) if hit and 20 * hit >= n}
    assert set(after.doc_id) == set(before.doc_id) - bad

    before, after = results["packing"]
    encoder = Encoder(VOCABULARY)
    after = after.sort_values(["doc_id", "start"])
    got = {d: np.concatenate([np.frombuffer(x, "<u4") for x in g.ids]).tolist() for d, g in after.groupby("doc_id")}
    assert got == {d: [*encoder.encode(t).tolist(), 1] for d, t in zip(before.doc_id, before.text)}


def test_run(spark, sf_dir):
    out = P.run(spark, sf_dir)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def test_awkward_and_empty_tables(spark, sf_dir, tmp_path):
    """Null and repeated ids, null texts, ties, clashing columns: each stage keeps the columns and the defined rows."""
    from tests.llm.common import SCHEMA, awkward

    rows = [*awkward(), (5, "another text under an id that is there already, in words enough", "en", *[None] * 7)]
    for name, own in (("rows", rows), ("none", [])):
        docs = spark.createDataFrame(own, SCHEMA)
        for stage, run in P.STAGES:
            out = run(spark, docs, sf_dir)
            if stage != "packing":
                assert out.columns == docs.columns
            path = str(tmp_path / f"{name}-{stage}")
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            if stage == "near_dedup":
                texts = [r.text for r in docs.where("doc_id = 5").collect()]
                assert not own or sorted(t[:7] for t in texts) == sorted([rows[5][1][:7], "another"])
        assert docs.isEmpty() == (not own)
