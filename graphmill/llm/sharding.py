"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows are dealt to P parts by a hash of their id, size and checksum.  A P x S matrix says how many rows
each part sends to each shard; it is drawn from the distribution that a uniformly
random permutation of all rows would give it (a multivariate hypergeometric draw
for each part, from what the shards still lack), so its row sums are the parts'
sizes and its column sums the shards' sizes, exactly.  Each part then orders its
rows at random and sends the first of them to shard 0, the next to shard 1, and so
on; each shard orders what it got at random again.  All randomness comes from
hashes of ids and a seed, so a task that runs again makes the same rows.

Only ids, sizes and checksums travel, never texts.  P is bounded (PARTS), so the
matrix is, too; the orders are made in cells of about CELL rows, so no task holds a
shard.

Defined cases
    Shard sizes differ by one row at most; the first shards are the larger ones.
    A null id hashes like any value, and ids have any plain type.  Rows with equal
    id, size and checksum are interchangeable: they are counted before they are
    dealt out, then numbered, and the number is hashed, too, so however many they
    are, they are spread over parts and cells.  Ranks with equal hashes go by id,
    size, checksum and number.  Texts of any length count by their bytes.  Columns
    besides doc_id and text aren't read.  A null text has size 8 and the checksum of no bytes.
    An empty table gives no rows.  More shards than rows leave shards empty.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphmill.workspace import checkpointed

SEED = 17
#: Most parts, and the rows in a part below that.
PARTS, PART_ROWS = 4096, 20_000
#: Rows that are put in order together within a shard, about.
CELL = 50_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Number of good ones among draws from good + bad.  Exact to double precision at any size."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    n = good + bad  # invert the distribution function over the values within 40 standard deviations of the mean
    mean = draws * good / n
    reach = 40 * math.sqrt(max(mean * (bad / n) * ((n - draws) / (n - 1)), 1.0)) + 40
    a, b = max(low, int(mean - reach)), min(high, int(mean + reach))
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    weight = np.concatenate([[0.0], np.cumsum(step)])
    weight = np.cumsum(np.exp(weight - weight.max()))
    return a + int(np.searchsorted(weight, rng.random() * weight[-1], side="right"))


def communication_matrix(parts: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Rows that each part sends to each shard; row sums `parts`, column sums as equal as can be."""
    total = sum(parts)
    lack = [total // shards + (s < total % shards) for s in range(shards)]
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((len(parts), shards), np.int64)
    for p, rows in enumerate(parts):
        left, pool = rows, sum(lack)
        for s in range(shards):
            n = _hypergeometric(rng, lack[s], pool - lack[s], left)
            pool -= lack[s]
            out[p, s] = n
            lack[s] -= n
            left -= n
    return out


def _random(seed: int) -> Column:
    return F.xxhash64("doc_id", "size", "text_crc32", "_copy", F.lit(seed))


def shard(spark: SparkSession, docs: DataFrame, shards: int = 24, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; slots run from 0 without a gap in each shard."""
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(binary) + F.lit(8)).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    rows = checkpointed(rows.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n"))
    total = rows.count()
    parts = max(1, min(PARTS, math.ceil(total / PART_ROWS)))
    part = F.pmod(_random(seed), F.lit(parts)).cast("int")
    sizes = dict.fromkeys(range(parts), 0) | {r["part"]: r["count"] for r in rows.select(part.alias("part")).groupBy("part").count().collect()}
    matrix = communication_matrix([sizes[p] for p in range(parts)], shards, seed)

    # Order within a part: cells of a part by the top of the random number, then a rank within the cell.
    placed = rows.withColumn("_part", part).withColumn("_r", _random(seed + 1))
    placed = _ranked(placed, ["_part"], max(1, math.ceil(total / parts / CELL)), "_rank")
    ends = np.cumsum(matrix, 1)
    bounds = spark.createDataFrame([(p, [int(x) for x in ends[p]]) for p in range(parts)], "_part int, _ends array<long>")
    placed = placed.join(F.broadcast(bounds), "_part")  # at most PARTS rows
    placed = placed.withColumn("shard", F.size(F.filter("_ends", lambda e: e <= F.col("_rank"))).cast("int")).drop("_ends", "_rank", "_part", "_r")

    placed = placed.withColumn("_r", _random(seed + 2))
    placed = _ranked(placed, ["shard"], max(1, math.ceil(total / shards / CELL)), "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot")


def _ranked(rows: DataFrame, by: list[str], cells: int, name: str) -> DataFrame:
    """Rank from 0 of each row in its group by (_r, doc_id, ...), with no task that holds more than a cell of a group."""
    order = ["_r", "doc_id", "size", "text_crc32", "_copy"]
    if cells == 1:
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    rows = rows.withColumn("_cell", F.shiftright(F.shiftrightunsigned("_r", 33) * F.lit(cells), 31).cast("int"))
    counts = rows.groupBy(*by, "_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "_cell", before.alias("_before"))
    ranked = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(*order)) - 1)
    return ranked.join(counts, [*by, "_cell"]).withColumn(name, (F.col("_before") + F.col("_in")).cast("long")).drop("_before", "_in", "_cell")
