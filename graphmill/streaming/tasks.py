"""Tasks and sessions with state and time: retries after a delay, expiry, the last messages of a session.

Both run on Spark's stateful processing (a RocksDB state store), so state lies in the checkpoint and survives lost
executors.  A task's events are kept by their time until the watermark has passed them, then applied in order; so what
comes out does not depend on how the events were split into micro-batches, as long as none is later than `late`.
Nothing in the state grows with a task's history: events go once they are applied, and an expired task's state is gone.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "task_id long, at timestamp, action string, attempt int"


@contextmanager
def state_store(spark: SparkSession):
    """Queries that are started within use the state store that stateful processing needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@dataclass(frozen=True)
class Policy:
    """What becomes of a task.

    An error is tried again `delay` seconds later, twice as long each time, and fails the task after `most` retries.
    Another event before that calls the retry off.  A task without any event for `expiry` seconds expires; one that has
    ended (`ended`), failed or expired is forgotten.
    """

    error: str = "error"
    ended: tuple[str, ...] = ("completed",)
    delay: float = 60.0
    most: int = 3
    expiry: float = 3600.0


@dataclass
class Task:
    """A task's state between events; times in milliseconds, 0 is none.  Each step returns (at, action, attempt) rows."""

    policy: Policy
    errors: int = 0
    due: int = 0
    expires: int = 0

    def passed(self, until: int) -> list[tuple[int, str, int]]:
        """What its clocks do up to and with a time."""
        out = []
        while (clock := min((x for x in (self.due, self.expires) if x), default=0)) and clock <= until:
            if clock == self.due:
                out.append((clock, "retry", self.errors))
                self.due = 0
            else:
                out.append((clock, "expired", self.errors))
                self.errors = self.due = self.expires = 0
        return out

    def event(self, at: int, status: str) -> list[tuple[int, str, int]]:
        out = self.passed(at - 1)
        self.due, self.expires = 0, at + round(self.policy.expiry * 1000)
        if status in self.policy.ended:
            out.append((at, "ended", self.errors))
            self.errors = self.expires = 0
        elif status == self.policy.error:
            self.errors += 1
            if self.errors > self.policy.most:
                out.append((at, "failed", self.errors - 1))
                self.errors = self.expires = 0
            else:
                self.due = at + round(self.policy.delay * 1000 * 2 ** (self.errors - 1))
        return out


class _Retries(StatefulProcessor):
    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ats array<long>, ids array<long>, statuses array<string>")
        self.task = handle.getValueState("task", "errors int, due long, expires long, done long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Keeps the events, and asks for one timer at the first of them: each call to the state store is a round trip."""
        first = None
        for frame in rows:
            ats = frame["at_ms"].tolist()
            self.waiting.appendValue((ats, frame["event_id"].tolist(), frame["status"].tolist()))
            first = min(ats) if first is None else min(first, *ats)
        if first is not None:
            self.handle.registerTimer(first)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Applies all events that the watermark has passed, and the clocks in between."""
        now, fired = timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        errors, due, expires, done = self.task.get() or (0, 0, 0, -1)
        if fired <= done:  # applied by an earlier timer of this batch
            return
        events = sorted(e for ats, ids, statuses in self.waiting.get() for e in zip(ats, ids, statuses))
        task, out = Task(self.policy, errors, due, expires), []
        ready = bisect.bisect_right(events, now, key=lambda e: e[0])
        for at, _, status in events[:ready]:
            out += task.event(at, status)
        out += task.passed(now)
        left = events[ready:]
        if left:
            self.waiting.put([tuple(map(list, zip(*left)))])
        elif events:
            self.waiting.clear()
        clocks = [x for x in (task.due, task.expires, left[0][0] if left else 0) if x]
        if clocks:
            self.task.update((task.errors, task.due, task.expires, now))
            self.handle.registerTimer(min(clocks))
        else:
            self.task.clear()
        if out:
            yield pd.DataFrame({"task_id": key[0], "at": pd.to_datetime([x[0] for x in out], unit="ms", utc=True), "action": [x[1] for x in out], "attempt": [x[2] for x in out]}).astype({"attempt": "int32"})

    def close(self) -> None:
        pass


def retries(events: DataFrame, policy: Policy, late: str = "1 hour") -> DataFrame:
    """task_id, at, action, attempt: retry, failed, ended and expired of tasks.  events: task_id, event_id, ts, status.

    Rows without task or time are left out; those of one time go by event_id.  Start it within state_store().
    """
    rows = events.where("task_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("task_id", "event_id", "ts", F.coalesce("status", F.lit("")).alias("status"), F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("task_id").transformWithStateInPandas(_Retries(policy), OUT, "Append", "EventTime")


def replayed(events: DataFrame, policy: Policy) -> DataFrame:
    """The same rows from a table of events, by a fold over each task in order of time; clocks run up to the last event of all."""
    end = events.agg(F.unix_millis(F.max("ts"))).first()[0]
    rows = events.where("task_id IS NOT NULL AND ts IS NOT NULL").select("task_id", "event_id", F.coalesce("status", F.lit("")).alias("status"), F.unix_millis("ts").alias("at_ms"))
    rows = rows.repartition("task_id").sortWithinPartitions("task_id", "at_ms", "event_id")

    def run(batches):
        own, task = None, Task(policy)
        for batch in batches:
            out = []
            for key, status, at in zip(batch["task_id"], batch["status"], batch["at_ms"]):
                if key != own:
                    out += [(own, *x) for x in task.passed(end)]
                    own, task = key, Task(policy)
                out += [(key, *x) for x in task.event(at, status)]
            yield _frame(out)
        yield _frame([(own, *x) for x in task.passed(end)])

    return rows.mapInPandas(run, OUT)


def _frame(out: list[tuple]) -> pd.DataFrame:
    columns = list(zip(*out)) or [[], [], [], []]
    return pd.DataFrame({"task_id": pd.Series(columns[0], dtype="int64"), "at": pd.to_datetime(pd.Series(columns[1], dtype="int64"), unit="ms", utc=True), "action": pd.Series(columns[2], dtype="str"), "attempt": pd.Series(columns[3], dtype="int32")})


class _History(StatefulProcessor):
    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "sequence long, role string, content string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = list(self.last.get()) if self.last.exists() else []
        for frame in rows:
            new = [(int(s), r, c) for s, r, c in zip(frame["sequence"], frame["role"], frame["content"])]
            kept = sorted([*kept, *new], key=lambda m: (m[0], m[1] or "", m[2] or ""))[-self.keep :]
        self.last.put([tuple(m) for m in kept])
        yield pd.DataFrame({"session_id": key[0], "place": pd.Series(range(1, len(kept) + 1), dtype="int32"), "sequence": [m[0] for m in kept], "role": [m[1] for m in kept], "content": [m[2] for m in kept]})

    def close(self) -> None:
        pass


def histories(messages: DataFrame, keep: int = 20) -> DataFrame:
    """session_id, place, sequence, role, content: the last messages of each session that a micro-batch has changed.

    State is `keep` messages a session.  The newest micro-batch's rows of a session are its history.
    """
    rows = messages.where("session_id IS NOT NULL AND sequence IS NOT NULL")
    return rows.groupBy("session_id").transformWithStateInPandas(_History(keep), "session_id long, place int, sequence long, role string, content string", "Update", "None")
