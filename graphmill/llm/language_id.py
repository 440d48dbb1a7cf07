"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to three bytes with counts of the
byte that follows.  The code length of a text under a language is the sum, over
its bytes, of -log2 of PPM's probability (escape method C, no exclusion): if the
longest known context has seen the byte, count / (total + kinds); else the price
of an escape, -log2(kinds / (total + kinds)), and the same with the next shorter
context, down to 8 bits for a byte never seen.  A context never seen costs
nothing.  Statistics are frozen after training, so the code length of a byte is a
function of it and the three bytes before it, and a whole text is scored by table
lookups over its byte array.  Every context of the labelled sample is kept: the
tables hold what occurs in it and are looked up by hashing.

Defined cases
    A null text, or one without any letter, is `und` with score 0.
    Equal code lengths: the language that sorts first.
    No labelled row at all: every text with a letter is `und` with score 0.
    A null or blank lang is not a label.  Repeated rows are scored each.  Columns
    besides doc_id, text and lang are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.llm.textarrays import blocks, flat, tidy

UNKNOWN = "und"
#: Labelled rows of each language that train the model; the only bound on what it learns from.
ROWS_PER_LANGUAGE = 1500
#: A text that costs more bits a byte than this under every language is in none of them.
UNIFORM_BITS = 8.0
_COUNTS = "lang string, gram long, n long"


class _Index:
    """Position, from 1, of each of some different 32-bit keys in their order; 0 for other keys."""

    def __init__(self, keys: np.ndarray):
        keys = keys.astype(np.uint32)
        self.n = len(keys)
        self.bits = max(4, int(4 * len(keys) + 1).bit_length())
        self.keys, self.at = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.at[slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.at[slot[won]] = keys[left[won]], left[won] + 1
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, slot = left[rest], self._next(slot[rest])

    def __len__(self) -> int:
        return self.n

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def _next(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & ((1 << self.bits) - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.at[slot]
        left = np.flatnonzero((self.keys[slot] != keys) & (out > 0))
        slot = slot[left]
        while len(left):
            slot = self._next(slot)
            here = self.at[slot]
            out[left] = here
            on = (self.keys[slot] != keys[left]) & (here > 0)
            left, slot = left[on], slot[on]
        return out


@dataclass
class Model:
    """Tables of a trained model.

    Rows of `bits`, the code length of a byte for each language: order 0, order 1, then each three and each four bytes
    of the sample.  A row of three or four bytes that a language has not seen holds its escapes, too.
    """

    languages: list[str]
    threes: _Index  # rows of three bytes
    fours: _Index  # rows of four bytes
    pairs: np.ndarray  # of the 65,536 contexts of two bytes: row of `leave_two`, 0 if never seen
    contexts: _Index  # contexts of three bytes: row of `leave_three`
    bits: np.ndarray  # row x language
    leave_two: np.ndarray  # context x language: price of an escape, the first row being 0
    leave_three: np.ndarray

    ORDER1, ORDER2 = 256, 256 + 65536

    def code_lengths(self, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of every row under every language."""
        out = np.zeros((len(offsets) - 1, len(self.languages)))
        piece = 1 << 18
        for i, j in blocks(offsets, piece):
            b, o = buffer[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if len(b) <= piece:
                self._add(b, o, 0, out[i:j])
                continue
            for at in range(0, len(b), piece):  # one very long row
                left = min(at, 3)
                own = b[at - left : at + piece]
                self._add(own, np.array([0, len(own)]), left, out[i:j])
        return out

    def _add(self, b: np.ndarray, o: np.ndarray, left: int, out: np.ndarray) -> None:
        """left: bytes at the start that are context only."""
        n = len(b)
        if not n:
            return
        s = b.astype(np.uint32)
        start = np.unique(o[:-1][o[:-1] < n])
        depth = np.full(n, 3, np.int8)  # bytes of context
        for k in (2, 1, 0):
            own = start + k
            depth[own[own < n]] = k
        gram = s.copy()
        for k in (1, 2, 3):
            gram[k:] |= s[:-k] << np.uint32(8 * k)
        row = np.where(depth > 0, self.ORDER1 + (gram & np.uint32(0xFFFF)).astype(np.int64), s.astype(np.int64))
        deep = np.flatnonzero(depth == 3)
        four = self.fours.find(gram[deep])
        row[deep[four > 0]] = self.ORDER2 + len(self.threes) + four[four > 0] - 1
        escaped = deep[four == 0]
        lower = np.union1d(escaped, np.flatnonzero(depth == 2))
        three = self.threes.find(gram[lower] & np.uint32(0xFFFFFF))
        row[lower[three > 0]] = self.ORDER2 + three[three > 0] - 1
        lowest = lower[three == 0]
        cost = np.take(self.bits, row, axis=0)
        cost[escaped] += self.leave_three[self.contexts.find(gram[escaped] >> np.uint32(8))]
        cost[lowest] += self.leave_two[self.pairs[(gram[lowest] >> np.uint32(8)) & np.uint32(0xFFFF)]]
        cost[:left] = 0
        full = o[1:] > o[:-1]
        out[full] += np.add.reduceat(cost, o[:-1][full], axis=0, dtype=np.float64)


def _ppm(context: np.ndarray, contexts: int, n: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each (context, byte) that is seen n times by one language, and the price of leaving each context.

    lower: what a byte that the language has not seen costs after the escape.
    """
    total, kinds = np.bincount(context, n, contexts), np.bincount(context, n > 0, contexts)
    with np.errstate(divide="ignore", invalid="ignore"):
        leave = np.where(total > 0, np.log2((total + kinds) / np.maximum(kinds, 1)), 0.0)
        bits = np.where(n > 0, np.log2((total + kinds)[context] / n), leave[context] + lower)
    return bits, leave


def build(counts: pd.DataFrame) -> Model:
    """counts: lang, gram (four bytes, the first is the highest), n."""
    languages = sorted(counts["lang"].unique())
    grams, index = np.unique(counts["gram"].to_numpy(np.int64), return_inverse=True)
    table = np.zeros((len(languages), len(grams)))
    np.add.at(table, (np.searchsorted(languages, counts["lang"].to_numpy(str)), index), counts["n"].to_numpy(float))

    threes, in_three = np.unique(grams & 0xFFFFFF, return_inverse=True)
    contexts, in_context = np.unique(grams >> 8, return_inverse=True)
    twos, in_two = np.unique(threes >> 8, return_inverse=True)
    pairs = np.zeros(65536, np.int32)
    pairs[twos] = np.arange(1, len(twos) + 1)
    every = np.arange(65536)
    bits = np.zeros((Model.ORDER2 + len(threes) + len(grams), len(languages)), np.float32)
    leave_two, leave_three = (np.zeros((len(x) + 1, len(languages)), np.float32) for x in (twos, contexts))
    for k in range(len(languages)):
        n3 = np.bincount(in_three, table[k], len(threes))
        n1 = np.bincount(threes & 0xFFFF, n3, 65536)
        zero, _ = _ppm(np.zeros(256, np.int64), 1, np.bincount(threes & 0xFF, n3, 256), np.full(256, 8.0))
        one, _ = _ppm(every >> 8, 256, n1, zero[every & 0xFF])
        three, leave_two[1:, k] = _ppm(in_two, len(twos), n3, one[threes & 0xFFFF])
        four, leave_three[1:, k] = _ppm(in_context, len(contexts), table[k], three[in_three])
        bits[:, k] = np.concatenate([zero, one, three, four])
    return Model(languages, _Index(threes), _Index(grams), pairs, _Index(contexts), bits, leave_two, leave_three)


def _count(batches):
    for batch in batches:
        lang = np.array(batch.column("lang").to_pylist(), object)
        for name in sorted(set(lang)):
            own = batch.column("text").filter(pa.array(lang == name))
            buffer, offsets = flat(own)
            codes = []
            for i, j in blocks(offsets, 1 << 20):
                b = buffer[offsets[i] : offsets[j]].astype(np.int64)
                if len(b) < 4:
                    continue
                code = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                inner = offsets[i + 1 : j] - offsets[i]
                cross = (inner[:, None] - np.arange(1, 4)).ravel()
                code = np.delete(code, np.unique(cross[(cross >= 0) & (cross < len(code))]))
                codes.append(np.unique(code, return_counts=True))
            if codes:  # blocks are small, so that a task is; a batch has a row for each of its grams all the same
                gram, at = np.unique(np.concatenate([c for c, _ in codes]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n for _, n in codes])).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(gram)), "gram": gram, "n": n})


def train(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Model | None:
    """A model from rows (doc_id, text, lang); None if no row has a label.

    Of each language, the rows_per_language distinct rows (doc_id, text) whose hashes are lowest are counted, whole;
    equal rows count once.  However many rows share an id or have none, no language is left out and none has more.
    """
    labelled = labelled.where(F.col("text").isNotNull() & (F.trim("lang") != "")).select("text", "lang", F.xxhash64("doc_id", "text").alias("_hash"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("_hash").alias("n")).collect()  # a row for each language
    if not sizes:
        return None
    near = F.lit(None).cast("double")
    for row in sizes:  # three times as many as are wanted, so that these aren't ranked among all
        near = F.when(F.col("lang") == row["lang"], F.lit(min(1.0, 3.0 * rows_per_language / max(1, row["n"])))).otherwise(near)
    low = (F.col("_hash").cast("double") / 2.0**64 + 0.5) <= near
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    distinct = labelled.select("lang", "_hash").where(low).distinct()
    cuts = distinct.withColumn("_rank", rank).where(F.col("_rank") <= rows_per_language).groupBy("lang").agg(F.max("_hash").alias("cut")).collect()
    cut = F.lit(None).cast("long")
    for row in cuts:
        cut = F.when(F.col("lang") == row["lang"], F.lit(row["cut"])).otherwise(cut)
    sample = labelled.where(F.col("_hash") <= cut).groupBy("lang", "_hash").agg(F.min("text").alias("text")).select("lang", "text")
    counts = sample.mapInArrow(tidy(_count), _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    return build(counts) if len(counts) else None


def _predict(batch: pa.RecordBatch, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language (-1: none), score and bits a byte of the rows."""
    buffer, offsets = flat(batch.column("text"))
    bits = model.code_lengths(buffer, offsets)
    best = bits.argmin(1)
    least = bits.min(1)
    score = 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(1)
    has_letter = batch.column("has_letter").to_numpy(zero_copy_only=False).astype(bool)
    return np.where(has_letter, best, -1), np.where(has_letter, score, 0.0), least / np.maximum(np.diff(offsets), 1)


def _letter() -> Column:
    return F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))


def predict(spark: SparkSession, docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score, bits_per_byte (null for `und`) of every row; one pass, no shuffle."""
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for batch in batches:
            best, score, bits = _predict(batch, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(bits, mask=best < 0)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _letter().alias("has_letter")).mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double, bits_per_byte double")


def keep_known(spark: SparkSession, docs: DataFrame, model: Model | None, most_bits: float = UNIFORM_BITS) -> DataFrame:
    """The rows, all columns, whose text is in a learned language: not `und`, and at most most_bits a byte.

    With no model nothing can be rejected but texts without letters.
    """
    if model is None:
        return docs.where(_letter())
    shared = spark.sparkContext.broadcast(model)
    schema, names = docs.schema, docs.columns

    def run(batches):
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(names.index("text")), batch.column(len(names))], ["text", "has_letter"])
            best, _, bits = _predict(texts, shared.value)
            kept = pa.Table.from_batches([batch]).select(list(range(len(names)))).filter(pa.array((best >= 0) & (bits <= most_bits)))
            yield from kept.to_batches()

    return docs.select("*", _letter().alias("_has_letter")).mapInArrow(tidy(run), schema)
