from __future__ import annotations

import numpy as np

from graphmill.llm import quality as Q
from graphmill.llm.queries import op8_bradley_terry_quality
from tests.llm.common import SCHEMA, documents


def test_ranking_is_learnt_from_pairs():
    rng = np.random.Generator(np.random.PCG64(5))
    x = rng.normal(size=(600, 6))
    label = (x[:, 0] - 0.5 * x[:, 3] + 0.3 * rng.normal(size=600) > 0.3).astype(int)
    model = Q.fit(x, label)
    s = model.scores(x)
    good, poor = s[label == 1], s[label == 0]
    assert (good[:, None] > poor[None]).mean() > 0.95
    assert abs((s >= 0.5).mean() - label.mean()) < 0.02  # the quantile


def test_held_out_accuracy(spark, sf_dir):
    rows = op8_bradley_terry_quality(spark, sf_dir).where("held_out").toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    both = rows.merge(labels, on="doc_id")
    assert len(both) > 10 and (both.predicted == both.quality).mean() >= max(0.9, both.quality.mean())


def test_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(5, 1), (8, 1), (11, 0), (17, 0), (17, 0), (3, None), (None, 1), (999, 1)], "doc_id long, label int")
    model = Q.train(docs, labels)
    rows = Q.score(spark, docs, model).toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all() and set(rows.predicted) <= {0, 1}
    assert Q.train(docs, labels.where("label = 1")) is None
    assert {r.score for r in Q.score(spark, docs, None).collect()} == {0.5}
    assert Q.score(spark, spark.createDataFrame([], SCHEMA), model).count() == 0


def test_clashing_labels_ties_and_long_texts(spark):
    """A doc_id with both labels counts for neither; equal texts tie; string ids and a very long text are scored."""
    docs = documents(spark)
    labels = [(5, 1), (8, 1), (11, 0), (17, 0)]
    clash = [(13, 0), (13, 1), (14, 1), (14, 0)]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, label int")
    a, b = Q.train(docs, make(labels)), Q.train(docs, make(labels + clash))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold
    long = "Some plain words of a text. " * 200_000
    rows = spark.createDataFrame([("a", long, 1), ("b", long, 2), ("c", None, 3), ("d", "", 4)], "doc_id string, text string, score int")
    got = {r.doc_id: r.score for r in Q.score(spark, rows, a).collect()}
    assert got["a"] == got["b"] and got["c"] == got["d"] and all(0 <= s <= 1 for s in got.values())


def test_loss_and_quantile_by_their_definitions():
    """The weights make the pairwise logistic loss stationary; the threshold leaves the labelled share above it."""
    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.normal(size=(80, 3))
    label = (x[:, 1] + rng.normal(size=80) > 0).astype(int)
    model = Q.fit(x, label, pairs=500, seed=9)
    z = (x - x.mean(0)) / x.std(0)
    draw = np.random.Generator(np.random.PCG64(9))
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    pairs = list(zip(good[draw.integers(0, len(good), 500)], poor[draw.integers(0, len(poor), 500)]))

    def loss(w):
        return sum(np.log1p(np.exp(-(z[a] - z[b]) @ w)) for a, b in pairs) / 500 + Q.RIDGE / 2 * w @ w

    best = loss(model.weights)
    for k in range(3):
        for step in (-1e-3, 1e-3):
            assert loss(model.weights + step * np.eye(3)[k]) >= best - 1e-12
    assert abs((model.scores(x) >= 0.5).mean() - label.mean()) <= 1 / 80 + 1e-9


def test_an_id_with_many_rows_stays_within_the_bound(spark, monkeypatch):
    read = []
    monkeypatch.setattr(Q, "fit", lambda x, label, prevalence: read.append(label))
    docs = [(1, f"good text number {i}") for i in range(500)] + [(2, "poor")] * 300 + [(i, f"text {i}") for i in range(3, 9)]
    labels = [(1, 1), (2, 0), *((i, i % 2) for i in range(3, 9))]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    Q.train(make(docs, "doc_id long, text string").repartition(3), make(labels, "doc_id long, label int"), rows_per_label=20)
    label = read.pop()
    assert 0 < (label == 0).sum() <= 20 and 0 < (label == 1).sum() <= 20 and (label == 1).sum() == 20


def test_every_labelled_row_trains(spark, monkeypatch):
    """In small cells, too, each row is in a pair; a rare label's rows stand in several; the threshold is that of all rows."""
    monkeypatch.setattr(Q, "CELL", 64)
    monkeypatch.setattr(Q, "LEAST", 4)
    monkeypatch.setattr(Q, "RANKED", 10)
    rows = [(i, f"{'good words, many ' * (i % 7 + 1)} {i}" if i % 9 else f"$$ ## {i}", int(i % 9 > 0)) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    model = Q.train(frame.select("doc_id", "text"), frame.select("doc_id", "label"))
    predicted = {r.doc_id: r.predicted for r in Q.score(spark, frame, model).collect()}
    assert sum(predicted[i] == label for i, _, label in rows) >= 590
    assert abs(sum(predicted.values()) - sum(r[2] for r in rows)) <= 8
    a, b = Q._pairs(np.array([1] * 10 + [0] * 3), 1)
    assert sorted(a) == list(range(10)) and set(b) == {10, 11, 12}


def test_threshold_by_brackets(spark, monkeypatch):
    rng = np.random.Generator(np.random.PCG64(2))
    rows = [(int(rng.random() < 0.8), float(round(rng.normal(), 2))) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "label int, rating double")
    whole = Q._threshold(frame, 0.7)
    monkeypatch.setattr(Q, "RANKED", 5)
    assert Q._threshold(frame, 0.7) == whole
    weigh = {k: v / sum(r[0] == k for r in rows) for k, v in ((1, 0.7), (0, 0.3))}
    assert abs(sum(weigh[label] for label, rating in rows if rating > whole) - 0.7) < 0.02


def test_few_labels_are_joined_as_many_are(spark):
    """By one plan at every size: no broadcast of labels, however few."""
    labels = spark.createDataFrame([(5, 1), (11, 0)], "doc_id long, label int")
    plan = Q._labelled(documents(spark), labels)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
