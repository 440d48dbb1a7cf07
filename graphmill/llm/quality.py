"""Quality scores by Bradley-Terry pairwise ranking.

The model says that document a is preferred to b with probability
sigmoid(w . x(a) - w . x(b)).  Every labelled row trains: rows are dealt to cells by a
hash, and within a cell each is in a pair with a row of the other label.  w minimises the logistic loss on the feature
differences of preference pairs (one document labelled 1, one labelled 0) with an L2
term, by Newton steps over sums that the tasks return.  A document's rating is w . x; the threshold is the quantile
of the labelled ratings that leaves the labelled share of 1 above it, and the score
is sigmoid(rating - threshold), so 0.5 is the threshold.

Features are frequencies of pairs of neighbouring byte classes, of words and lines,
over the whole text, and how its length and its compressibility by repeats look;
they come from a few array passes over a batch of texts.

Defined cases
    A null text scores as an empty one.  Without labels of both kinds every score is
    0.5.  A null label is none, and a doc_id with labels of both kinds has none.
    Repeated rows are scored each; equal texts have equal scores.  A doc_id with
    several texts lends its label to each.  Very long texts are read whole.  doc_id
    may have any plain type.  Columns besides doc_id, text and the label are not
    read.  An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.llm.textarrays import blocks, flat, spans, tidy, word_hashes
from graphmill.workspace import checkpointed

#: Preference pairs at least, where the rows give as many; more rows give more.
PAIRS = 20_000
#: Rows of a cell, and rows of either label in it, about; a rare label's rows stand in several cells.
CELL, LEAST = 8192, 64
#: Ratings that the driver puts in order, at most, once the threshold's bracket is as narrow.
RANKED = 100_000
RIDGE = 1e-3
_CLASSES = 20


def _byte_classes() -> np.ndarray:
    out = np.full(256, 0, np.uint8)  # control
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A] = 1, 2, 3
    out[0x80:0xC0], out[0xC0:] = 4, 5
    for k, group in enumerate((" \t", "\n\r", ".", ",", "!", "?", "-_", ":;", "'\"`", "()[]{}", "<>/\\|", "#", "$%&", "*+=~^@"), 6):
        out[[ord(c) for c in group]] = k
    return out


_CLASS = _byte_classes()
N_FEATURES = _CLASSES * _CLASSES + 5


def features(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x N_FEATURES."""
    out = np.zeros((len(offsets) - 1, N_FEATURES), np.float32)
    for i, j in blocks(offsets):
        b, o = buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        n = j - i
        kinds = _CLASS[b].astype(np.int64)
        row = np.repeat(np.arange(n), np.diff(o))
        pair = kinds[:-1] * _CLASSES + kinds[1:] + row[:-1] * (_CLASSES * _CLASSES)
        count = np.bincount(pair[row[:-1] == row[1:]], minlength=n * _CLASSES * _CLASSES).reshape(n, -1)
        size = np.diff(o)
        out[i:j, : _CLASSES * _CLASSES] = np.sqrt(count / np.maximum(size - 1, 1)[:, None])
        start, end, first = spans(b, o)
        words = np.diff(first)
        total = np.concatenate([[0], np.cumsum(end - start)])
        tail = out[i:j, _CLASSES * _CLASSES :]
        tail[:, 0] = np.log1p(size) / 10
        tail[:, 1] = np.diff(total[first]) / np.maximum(words, 1) / 10
        code = word_hashes(b, start, end)
        owner = np.repeat(np.arange(n), words)
        tail[:, 2] = 1 - _distinct(code, owner, n) / np.maximum(words, 1)
        if len(code) > 1:
            two = code[:-1] * np.uint64(3) + code[1:]
            same = owner[:-1] == owner[1:]
            tail[:, 3] = 1 - _distinct(two[same], owner[:-1][same], n) / np.maximum(words - 1, 1)
        tail[:, 4] = words == 0
    return out


def _distinct(code: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.append(True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1]))[: len(code)]
    return np.bincount(owner[new], minlength=n)


@dataclass
class Model:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    threshold: float

    def ratings(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(self.threshold - self.ratings(x), -500, 500)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, prevalence: float | None = None, seed: int = 5) -> Model | None:
    """x: rows x features; None if the labels are all of one kind."""
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    if not len(good) or not len(poor):
        return None
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, np.inf)  # a constant feature says nothing
    z = (x - mean) / scale
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = good[rng.integers(0, len(good), pairs)], poor[rng.integers(0, len(poor), pairs)]
    d = (z[a] - z[b]).astype(np.float64)
    w = np.zeros(d.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # of the wrong order
        gradient = -(d * p[:, None]).mean(0) + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    ratings = z @ w
    share = len(good) / len(label) if prevalence is None else prevalence
    weight = np.where(label == 1, share / len(good), (1 - share) / len(poor))
    order = np.argsort(ratings, kind="stable")
    below = np.cumsum(weight[order])
    k = min(int(np.searchsorted(below, 1 - share)), len(order) - 1)
    lower = ratings[order[max(k - 1, 0)]]
    return Model(w, mean, scale, float((ratings[order[k]] + lower) / 2))


def _extract(batches):
    for batch in batches:
        x = features(*flat(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("_hash"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float32()), N_FEATURES).cast(pa.list_(pa.float32()))], ["label", "_hash", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


def _cells(batches):
    """(cell, label, own, x) of each cell; rows are in order of their cell."""
    kept = []
    for batch in batches:
        cell = batch.column("_cell").to_numpy()
        label, own, x = batch.column("label").to_numpy(), batch.column("_own").to_numpy(zero_copy_only=False), _matrix(batch.column("x"))
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1), len(cell)]
        for i, j in zip(cuts, cuts[1:]):
            if kept and kept[0][0] != cell[i]:
                yield kept[0][0], *(np.concatenate([k[m] for k in kept]) for m in (1, 2, 3))
                kept = []
            if j > i:
                kept.append((cell[i], label[i:j], own[i:j], x[i:j]))
    if kept:
        yield kept[0][0], *(np.concatenate([k[m] for k in kept]) for m in (1, 2, 3))


def _summed(table: DataFrame, of) -> list[np.ndarray]:
    """The sum of arrays that `of` gives for each cell (label, own, x); tasks return one row each, a few for each core."""

    def run(batches):
        first, total = None, None
        for cell, label, own, x in _cells(batches):
            parts = of(label, own, x)
            first = cell if first is None else first
            total = parts if total is None else [a + b for a, b in zip(total, parts)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(first)]), pa.array([[np.asarray(t, np.float64).ravel() for t in total]], pa.list_(pa.list_(pa.float64())))], ["cell", "parts"])

    few = table.coalesce(4 * table.sparkSession.sparkContext.defaultParallelism)
    rows = sorted(few.mapInArrow(tidy(run), "cell long, parts array<array<double>>").toArrow().to_pylist(), key=lambda r: r["cell"])
    return [sum(np.array(r["parts"][k]) for r in rows) for k in range(len(rows[0]["parts"]))] if rows else []


def _pairs(label: np.ndarray, shifts: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (good, poor) of a cell: each row of the commoner label with `shifts` rows of the other, all of these in turn."""
    good, poor = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    few, many = sorted((good, poor), key=len)
    if not len(few):
        return few, few
    i = np.arange(len(many))
    j = np.concatenate([(i + k) % len(few) for k in range(min(shifts, len(few)))])
    many, few = np.tile(many, min(shifts, len(few))), few[j]
    return (many, few) if len(good) > len(poor) else (few, many)


def _threshold(ratings: DataFrame, share: float) -> float:
    """The middle between the first rating by whose order the labels' weights sum to more than 1 - share, and the one before it.

    Each label weighs its share.  Ratings are counted in bins, and the bin that matters again, until few are left.
    """
    n = {r["label"]: r["n"] for r in ratings.groupBy("label").agg(F.count("*").alias("n")).collect()}
    weigh, most = {1: share / n[1], 0: (1 - share) / n[0]}, 1 - share + 1e-9
    low, high = ratings.agg(F.min("rating"), F.max("rating")).first()
    below, before = 0.0, None  # weight and greatest rating below the bracket
    while True:
        inside = ratings.where(F.col("rating").between(low, high))
        if low == high or inside.count() <= RANKED:
            break
        place = F.least(F.floor((F.col("rating") - low) / (high - low) * 4096), F.lit(4095))
        bins = inside.groupBy(place.alias("bin")).agg(F.min("rating").alias("low"), F.max("rating").alias("high"), F.count_if(F.col("label") == 1).alias("good"), F.count_if(F.col("label") == 0).alias("poor")).orderBy("bin").collect()
        for b in bins:
            weight = b["good"] * weigh[1] + b["poor"] * weigh[0]
            if below + weight > most or b is bins[-1]:
                low, high = b["low"], b["high"]
                break
            below, before = below + weight, b["high"]
    if low == high:  # very many equal ratings: the one before is the same unless the very first of them decides
        first = weigh[inside.agg(F.min("label")).first()[0]]
        return float((low + before) / 2 if before is not None and below + first > most else low)
    got = sorted((r["rating"], r["label"]) for r in inside.collect())
    reached = below + np.cumsum([weigh[label] for _, label in got])
    k = min(int(np.searchsorted(reached, most, side="right")), len(got) - 1)
    lower = got[k - 1][0] if k else got[0][0] if before is None else before
    return float((got[k][0] + lower) / 2)


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, label, _hash of the rows with a label (doc_id, label); a shuffle at any size, so that its cost grows as the input."""
    return docs.select("doc_id", "text").join(labels.hint("merge"), "doc_id").select("text", "label", F.xxhash64("doc_id", "text").alias("_hash"))


def train(docs: DataFrame, labels: DataFrame, rows_per_label: int | None = None) -> Model | None:
    """A model from texts (doc_id, text) and labels (doc_id, label in 0, 1): from all distinct rows (doc_id, text) with a label.

    rows_per_label: a caller's bound; then the model is fit on that many rows of each label at most, those whose hashes
    are lowest, by fit().
    """
    labels = labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
    labels = labels.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_high")).where("label = _high").drop("_high")
    sizes = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    prevalence = sizes[1] / (sizes[0] + sizes[1])
    rows = _labelled(docs, labels)
    seen = rows.mapInArrow(tidy(_extract), "label int, _hash long, x array<float>")
    seen = checkpointed(seen.groupBy("label", "_hash").agg(F.first("x").alias("x")))
    if rows_per_label:
        rank = F.row_number().over(Window.partitionBy("label").orderBy("_hash"))
        got = seen.withColumn("_rank", rank).where(F.col("_rank") <= rows_per_label).orderBy("label", "_hash").select("label", "x").toArrow()
        return fit(_matrix(got.column("x").combine_chunks()), got.column("label").to_numpy(), prevalence=prevalence) if len(got) else None
    n = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    cells = -(-sum(n.values()) // CELL)
    copies = F.when(F.col("label") == 1, min(cells, -(-LEAST * cells // n[1]))).otherwise(min(cells, -(-LEAST * cells // n[0])))
    placed = seen.withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    placed = placed.select("label", "_hash", "x", (F.col("_copy") == 0).alias("_own"), F.pmod(F.xxhash64("_hash") % cells + F.col("_copy"), F.lit(cells)).alias("_cell"))
    table = checkpointed(placed.repartition(cells, "_cell").sortWithinPartitions("_cell", "label", "_hash"))

    count, total, squares = _summed(table, lambda label, own, x: [own.sum(), x[own].sum(0, np.float64), (x[own].astype(np.float64) ** 2).sum(0)])
    mean = total / count
    scale = np.sqrt(np.maximum(squares / count - mean**2, 0))
    scale = np.where(scale > 1e-6, scale, np.inf)  # a constant feature says nothing
    shifts = -(-PAIRS // max(n.values()))
    w = np.zeros(N_FEATURES)

    def sums(label, own, x):
        z = (x - mean) / scale
        a, b = _pairs(label, shifts)
        gradient, hessian = np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES))
        for i in range(0, len(a), CELL):
            d = z[a[i : i + CELL]] - z[b[i : i + CELL]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))  # of the wrong order
            gradient += (d * p[:, None]).sum(0)
            hessian += (d * (p * (1 - p))[:, None]).T @ d
        return [len(a), gradient, hessian]

    for _ in range(25):
        pairs, gradient, hessian = _summed(table, sums)
        step = np.linalg.solve(hessian.reshape(N_FEATURES, -1) / pairs + RIDGE * np.eye(N_FEATURES), RIDGE * w - gradient / pairs)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    model = Model(w, mean, scale, 0.0)

    def rated(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(model.ratings(_matrix(batch.column("x"))))], ["label", "rating"])

    ratings = checkpointed(seen.select("label", "x").mapInArrow(tidy(rated), "label int, rating double"))
    model.threshold = _threshold(ratings, prevalence)
    return model


def score(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, predicted of every row; one pass, no shuffle."""
    if model is None:
        return docs.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            s = shared.value.scores(features(*flat(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s.astype(np.float64)), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double, predicted int")
