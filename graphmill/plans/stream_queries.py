"""Queries that run Structured Streaming over the events table, to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphmill.catalog import Catalog
from graphmill.plans.oracle import MESSAGES
from graphmill.plans.registry import query
from graphmill.streaming import progress as P
from graphmill.streaming import tasks as S
from graphmill.workspace import folder


def _stream(c: Catalog) -> DataFrame:
    """The table as a stream: a streaming source reads folders, so the rows are written to one first."""
    path = folder(c.spark, "events")
    c.table("events").write.parquet(path)
    return P.progress_source(c.spark, path)


@query("SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY user_id")
def stream_latest_status(c: Catalog) -> DataFrame:
    found = P.drained(P.latest_status(_stream(c)), folder(c.spark, "latest"), folder(c.spark, "state"), "update")
    newest = F.max_by("status", "batch_id")
    return found.groupBy("task_id").agg(newest.alias("status"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windowed_counts(c: Catalog) -> DataFrame:
    """Complete mode: every window as it stands at the end of the stream."""
    found = P.drained(P.windowed_counts(_stream(c)), folder(c.spark, "windows"), folder(c.spark, "state"), "complete")
    last = found.agg(F.max("batch_id").alias("_b"))
    return found.join(F.broadcast(last)).where("batch_id = _b").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""WITH o AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT before AS from_status, event_type AS to_status, count(*) AS n FROM o WHERE before IS NOT NULL AND before <> event_type GROUP BY ALL""")
def stream_transitions(c: Catalog) -> DataFrame:
    found = P.drained(P.transitions(_stream(c)), folder(c.spark, "transitions"), folder(c.spark, "state"))
    return found.groupBy("from_status", "to_status").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT user_id % 100 AS run, event_type AS worker FROM events), a AS (SELECT DISTINCT run, worker FROM w), d AS (SELECT DISTINCT run, worker FROM w WHERE worker IN ('click', 'view', 'signup')) SELECT run, count(*) FILTER (d.worker IS NULL) = 0 AS ready, coalesce(string_agg(a.worker, ',' ORDER BY a.worker) FILTER (d.worker IS NULL), '') AS missing FROM a LEFT JOIN d USING (run, worker) GROUP BY run""")
def worker_barrier(c: Catalog) -> DataFrame:
    w = c.table("events").select((F.col("user_id") % 100).alias("run"), F.col("event_type").alias("worker"), F.lit(True).alias("active"), F.col("event_type").isin("click", "view", "signup").alias("completed"))
    return P.barrier(w).select("run", "ready", F.array_join("missing", ",").alias("missing"))


@query("""WITH r AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS errors FROM events) SELECT user_id AS task_id, event_type AS status, errors AS retries FROM r WHERE k = 1 AND event_type = 'error' AND errors <= 3""")
def resumable_tasks(c: Catalog) -> DataFrame:
    """Tasks whose last state is an error and that have retries left."""
    own = Window.partitionBy("user_id")
    rows = c.table("events").withColumns({"k": F.row_number().over(own.orderBy(F.desc("ts"), F.desc("event_id"))), "errors": F.count_if(F.col("event_type") == "error").over(own)})
    return rows.where("k = 1 AND event_type = 'error' AND errors <= 3").select(F.col("user_id").alias("task_id"), F.col("event_type").alias("status"), F.col("errors").alias("retries"))


@query(f"WITH {MESSAGES} SELECT session_id, count(*) AS n, max(sequence) AS last_sequence, count(*) FILTER (role = 'assistant') AS answers FROM messages GROUP BY session_id")
def session_counters(c: Catalog) -> DataFrame:
    return c.messages().groupBy("session_id").agg(F.count("*").alias("n"), F.max("sequence").alias("last_sequence"), F.count_if(F.col("role") == "assistant").alias("answers"))


@query()
def stream_retries(c: Catalog) -> DataFrame:
    """Retries a day after an error and later, failures, ends and expiries of users' tasks, up to the last event.

    Tests hold the stream against a replay by hand.  A last row beyond the others moves the watermark past them.
    """
    path = folder(c.spark, "events")
    events = c.table("events")
    events.write.parquet(path)
    last = events.agg(F.max("ts").alias("ts")).where("ts IS NOT NULL")
    closing = last.select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.lit(None).cast("long").alias("user_id"), *(F.lit(None).cast(t).alias(n) for n, t in (("event_type", "string"), ("value", "double"), ("props", "string"))))
    closing.coalesce(1).write.mode("append").parquet(path)
    stream = P.progress_source(c.spark, path).where("user_id IS NOT NULL OR event_id = -1").select(F.coalesce("user_id", F.lit(-1)).alias("task_id"), "event_id", "ts", F.col("event_type").alias("status"))
    policy = S.Policy(ended=("purchase",), delay=86_400, expiry=10 * 86_400)
    with S.state_store(c.spark):
        return P.drained(S.retries(stream, policy, late="1 day"), folder(c.spark, "retries"), folder(c.spark, "state")).where("task_id >= 0")


@query(f"WITH {MESSAGES}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY sequence DESC, role DESC, content DESC) AS back, count(*) OVER (PARTITION BY session_id) AS n FROM messages) SELECT session_id, (least(n, 4) - back + 1)::INT AS place, sequence, role FROM r WHERE back <= 4")
def stream_histories(c: Catalog) -> DataFrame:
    """The last four messages of each session, kept in state."""
    path = folder(c.spark, "messages")
    c.messages().write.parquet(path)
    schema = c.messages().schema
    with S.state_store(c.spark):
        found = P.drained(S.histories(c.spark.readStream.schema(schema).parquet(path), 4), folder(c.spark, "histories"), folder(c.spark, "state"), "update")
    newest = found.groupBy("session_id").agg(F.max("batch_id").alias("batch_id"))
    return found.join(newest, ["session_id", "batch_id"]).select("session_id", "place", "sequence", "role")
