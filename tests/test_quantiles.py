"""Exact quantiles by brackets against sorted lists, with a key that has half of all rows, ties and short groups."""

from __future__ import annotations

import random

import pytest

from graphmill.operators import aggregates as A


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_brackets_find_the_value_at_the_index(spark, q):
    rng = random.Random(4)
    groups = {
        "hot": [rng.lognormvariate(0, 3) for _ in range(6000)],
        "ties": [float(rng.choice([1, 1, 1, 2, 3])) for _ in range(3000)],
        "mixed": [5.0] * 2000 + [rng.random() * 10 for _ in range(1500)],
        "one": [3.5],
        "two": [2.0, -1.0],
        "equal": [7.0] * 500,
    }
    rows = [(k, v) for k, own in groups.items() for v in own] + [("none", None), (None, 1.0)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc string, x double").repartition(4)
    got = {r["doc"]: (r["n"], r["top"], r["quantile"]) for r in A.quantiles(frame, "doc", "x", q, ranked=50).collect()}
    assert got == {k: (len(own), max(own), sorted(own)[int((len(own) - 1) * q)]) for k, own in groups.items()}


def test_empty(spark):
    assert A.quantiles(spark.createDataFrame([], "doc string, x double"), "doc", "x", 0.5).collect() == []
