"""Rows answered by an outside provider: in batches, by rank, each distinct key once, failures tried again.

Results lie in a folder, so a key that has an answer is never asked again, whichever call of `answered` asked it.  The
keys that lack one are cut into waves by rank; a wave is one job, and what it got is kept before the next begins, so a
driver or executor that dies costs at most the wave it was in.  Within a wave a task takes its keys in order of rank and
hands them to the provider `size` at a time.

A batch that the provider refuses (it raises, or answers None for a key) is written as failed with the reason, and its
keys are tried again in the next round, in batches half as large, so one bad key does not hold up its neighbours for
good.  After `tries` rounds what still fails is returned with its reason, and a later call tries it again.

Of several rows of one key the one of the least rank, then payload, is sent.  Rows with a null key are left out; a null
rank comes last.  An empty table calls nothing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.workspace import checkpointed

#: Keys of a wave.
WAVE = 100_000
SCHEMA = "key string, answer string, reason string"


def _call(provider: Callable[[list], list], size: int):
    """Hands a task's rows over, `size` at a time; they come in order of rank."""

    def asked(keys: list, payloads: list) -> pd.DataFrame:
        try:
            answers, reason = list(provider(payloads)), "no answer"
            if len(answers) != len(payloads):
                raise ValueError(f"{len(answers)} answers to {len(payloads)} payloads")
        except Exception as error:  # whatever the provider's own failures are
            answers, reason = [None] * len(payloads), f"{type(error).__name__}: {error}"[:300]
        return pd.DataFrame({"key": keys, "answer": answers, "reason": [None if a is not None else reason for a in answers]}, dtype=object)

    def run(batches):
        keys, payloads = [], []
        for batch in batches:
            keys += batch["key"].tolist()
            payloads += batch["payload"].tolist()
            while len(keys) >= size:
                yield asked(keys[:size], payloads[:size])
                keys, payloads = keys[size:], payloads[size:]
        if keys:
            yield asked(keys, payloads)

    return run


def stored(spark: SparkSession, path: str) -> DataFrame:
    """key, answer of what has been answered so far."""
    rows = spark.read.schema(f"{SCHEMA}, ok boolean").option("recursiveFileLookup", "false").option("ignoreMissingFiles", "true").parquet(f"{path}/results")
    return rows.where("ok").select("key", "answer").dropDuplicates(["key"])


def answered(rows: DataFrame, provider: Callable[[list], list], path: str, size: int = 20, tries: int = 3, wave: int = WAVE, parallel: int = 8) -> tuple[DataFrame, DataFrame]:
    """(key, answer) of the rows' keys, and (key, reason) of those that still fail.

    rows: key, rank, payload, all strings but rank, the least first.  parallel: calls at a time.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], f"{SCHEMA}, ok boolean").write.mode("append").partitionBy("ok").parquet(f"{path}/results")
    wanted = rows.where("key IS NOT NULL").select("key", F.coalesce(F.col("rank").cast("double"), F.lit(float("inf"))).alias("rank"), "payload")
    wanted = wanted.groupBy("key").agg(F.min(F.struct("rank", "payload")).alias("_first")).select("key", "_first.rank", "_first.payload")
    wanted = checkpointed(wanted)
    failed = None
    for attempt in range(tries):
        left = checkpointed(wanted.join(stored(spark, path).select("key"), "key", "left_anti"))
        n = left.count()
        if not n:
            failed = None
            break
        waves = -(-n // wave)
        cuts = left.agg(F.percentile_approx("rank", [(i + 1) / waves for i in range(waves - 1)] or [1.0], 10_000)).first()[0] if waves > 1 else []
        bounds = [None, *sorted(set(cuts)), None]
        failed = None
        for low, high in zip(bounds, bounds[1:]):
            own = left if low is None else left.where(F.col("rank") > low)
            own = own if high is None else own.where(F.col("rank") <= high)
            calls = own.repartitionByRange(parallel, "rank", "key").sortWithinPartitions("rank", "key").select("key", "payload")
            got = checkpointed(calls.mapInPandas(_call(provider, max(1, size >> attempt)), SCHEMA))
            got.where("reason IS NULL").withColumn("ok", F.lit(True)).write.mode("append").partitionBy("ok").parquet(f"{path}/results")
            bad = got.where("reason IS NOT NULL").select("key", "reason")
            failed = bad if failed is None else failed.unionByName(bad)
    done = stored(spark, path).join(wanted.select("key"), "key", "left_semi")
    return done, failed if failed is not None else spark.createDataFrame([], "key string, reason string")
