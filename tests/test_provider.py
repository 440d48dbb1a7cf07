"""A provider that counts: each key is asked once, also after a wave has died; failures are tried again."""

from __future__ import annotations

import os
import uuid
from collections import Counter

import pytest

from graphmill.operators import provider as P
from graphmill.workspace import folder

SCHEMA = "key string, rank double, payload string"


def _counting(log, refuse=lambda payloads: False, deny=()):
    def provider(payloads):
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(payloads))
        if refuse(payloads):
            raise RuntimeError("busy")
        return [None if p in deny else p.upper() for p in payloads]

    return provider


def _calls(log):
    return [open(f"{log}/{name}").read().split("\n") for name in os.listdir(log)]


def _rows(spark, n=90):
    rows = [(f"k{i}", float(n - i), f"p{i}") for i in range(n)]
    return spark.createDataFrame(rows + [(f"k{i}", 1000.0, "other") for i in range(0, n, 3)] + [(None, 1.0, "lost"), ("last", None, "plast")], SCHEMA).repartition(5)


def test_each_key_once_in_batches_by_rank(spark, tmp_path):
    path = folder(spark, "provider")
    done, failed = P.answered(_rows(spark), _counting(tmp_path), path, size=10, wave=40, parallel=2)
    assert {r["key"]: r["answer"] for r in done.collect()} == {f"k{i}": f"P{i}" for i in range(90)} | {"last": "PLAST"}
    assert failed.count() == 0
    calls = _calls(tmp_path)
    assert Counter(p for c in calls for p in c) == Counter([f"p{i}" for i in range(90)] + ["plast"])
    assert max(map(len, calls)) == 10 and all(len(set(c)) == len(c) for c in calls)
    again, _ = P.answered(_rows(spark), _counting(tmp_path), path)
    assert again.count() == 91 and len(_calls(tmp_path)) == len(calls)


def test_failures_are_tried_again_in_smaller_batches(spark, tmp_path):
    provider = _counting(tmp_path, refuse=lambda payloads: len(payloads) > 5, deny=("p7",))
    done, failed = P.answered(_rows(spark, 30), provider, folder(spark, "provider"), size=8, tries=3, parallel=2)
    assert done.count() == 30 and [(r["key"], r["reason"]) for r in failed.collect()] == [("k7", "no answer")]
    assert {len(c) for c in _calls(tmp_path)} <= set(range(1, 9))


def test_a_killed_wave_loses_only_itself(spark, tmp_path, monkeypatch):
    path, written = folder(spark, "provider"), []
    real = P.checkpointed

    def dies(df):
        if "answer" in df.columns:
            written.append(1)
            if len(written) == 3:
                raise KeyboardInterrupt
        return real(df)

    monkeypatch.setattr(P, "checkpointed", dies)
    with pytest.raises(KeyboardInterrupt):
        P.answered(_rows(spark), _counting(tmp_path), path, size=10, wave=25, parallel=2)
    before = P.stored(spark, path).count()
    assert 30 <= before < 91
    monkeypatch.setattr(P, "checkpointed", real)
    done, _ = P.answered(_rows(spark), _counting(tmp_path), path, size=10, wave=25, parallel=2)
    assert done.count() == 91
    assert set(Counter(p for c in _calls(tmp_path) for p in c).values()) == {1}


def test_empty_table_and_wrong_number_of_answers(spark, tmp_path):
    done, failed = P.answered(spark.createDataFrame([], SCHEMA), _counting(tmp_path), folder(spark, "provider"))
    assert done.count() == 0 == failed.count() and _calls(tmp_path) == []
    done, failed = P.answered(_rows(spark, 3), lambda payloads: payloads[1:], folder(spark, "provider"), tries=1)
    assert done.count() == 0 and failed.count() == 4 and "answers to" in failed.first()["reason"]
