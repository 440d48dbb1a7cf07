"""Progress events and sessions as streams.

Each function takes a streaming (or static) DataFrame and returns one; nothing is
started here except by the helpers that take a checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def progress_source(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Events of Parquet files that arrive in a folder; ts as an instant, which watermarks need."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def latest_status(events: DataFrame) -> DataFrame:
    """task_id, status, at: newest event of each task; state is a row a task."""
    newest = F.max_by(F.struct(F.col("event_type").alias("status"), F.col("ts").alias("at")), F.struct("ts", "event_id"))
    return events.groupBy(F.col("user_id").alias("task_id")).agg(newest.alias("s")).select("task_id", "s.status", "s.at")


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by window and type; a window is dropped from state once it is later than the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


_STATE = T.StructType([T.StructField("status", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("retries", T.LongType())])
_TRANSITIONS = "task_id long, from_status string, to_status string, retries long"


def _next(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    status, at, retries = state.get if state.exists else (None, None, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])  # a task's events of one trigger
    out = []
    for row in rows.itertuples():
        if status is not None and row.event_type != status:
            retries += row.event_type == "error"
            out.append((key[0], status, row.event_type, retries))
        status, at = row.event_type, row.ts
    state.update((status, at.to_pydatetime(), int(retries)))
    yield pd.DataFrame(out, columns=["task_id", "from_status", "to_status", "retries"])


def transitions(events: DataFrame) -> DataFrame:
    """Status changes of each task with its number of errors so far; state is the last status, not the history."""
    return events.groupBy("user_id").applyInPandasWithState(_next, _TRANSITIONS, _STATE, "append", "NoTimeout")


def barrier(workers: DataFrame) -> DataFrame:
    """run, ready, missing: whether all active workers of a run have completed."""
    active, done = F.collect_set(F.when(F.col("active"), F.col("worker"))), F.collect_set(F.when(F.col("completed"), F.col("worker")))
    return workers.groupBy("run").agg(F.array_sort(F.array_except(active, done)).alias("missing")).select("run", (F.size("missing") == 0).alias("ready"), "missing")


def embed_as_you_go(rows: DataFrame, provider: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Embeds each micro-batch and writes it under its batch id, so a batch that is done again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        provider(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming DataFrame over what its source holds now, into Parquet, and reads the result.

    With mode `complete` or `update` the last micro-batch's rows replace those of equal batch id, and the newest
    value of a key is the caller's to pick.
    """
    spark = df.sparkSession
    if mode == "append":
        query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    else:

        def write(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/b{batch_id:06d}")

        query = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "append":
        return spark.read.schema(df.schema).parquet(path)
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch_id", T.IntegerType())])).option("recursiveFileLookup", "true").parquet(path)
