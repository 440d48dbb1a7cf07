"""Streams with state and time against a replay of the whole table, in several splits into micro-batches."""

from __future__ import annotations

import datetime
import random

import pandas as pd
import pytest

from graphmill.streaming import progress as P
from graphmill.streaming import tasks as S
from graphmill.workspace import folder

POLICY = S.Policy(delay=40, most=2, expiry=600)
START = datetime.datetime(2026, 1, 1)
SCHEMA = "task_id long, event_id long, ts timestamp, status string"


def _events(seed=3, n=160):
    rng = random.Random(seed)
    rows = [(rng.randrange(9), i, START + datetime.timedelta(seconds=i * 17 + rng.randrange(-30, 30)), rng.choice(["running", "error", "error", "error", "completed", None])) for i in range(n)]
    rows[51:51] = [(None, 900, START, "error"), (3, 901, rows[50][2], "error")]  # no task; two events at one time
    return rows + [(-1, 999, START + datetime.timedelta(days=3), "running")]


def _by_hand(rows):
    """Retry, failure, end and expiry of each task, one event after another."""
    out, last = [], max(r[2] for r in rows)
    for task in {r[0] for r in rows if r[0] is not None}:
        errors, due, dies = 0, None, None

        def clocks(until, task=task):
            nonlocal errors, due, dies
            for at, what in sorted((x, k) for x, k in ((due, "retry"), (dies, "expired")) if x is not None and x < until):
                if what == "retry" and due is not None:
                    out.append((task, at, "retry", errors))
                    due = None
                elif what == "expired":
                    out.append((task, at, "expired", errors))
                    errors, due, dies = 0, None, None

        for _, _, ts, status in sorted((r for r in rows if r[0] == task), key=lambda r: (r[2], r[1])):
            clocks(ts)
            due, dies = None, ts + datetime.timedelta(seconds=600)
            if status == "completed":
                out.append((task, ts, "ended", errors))
                errors, dies = 0, None
            elif status == "error":
                errors += 1
                if errors > 2:
                    out.append((task, ts, "failed", errors - 1))
                    errors, dies = 0, None
                else:
                    due = ts + datetime.timedelta(seconds=40 * 2 ** (errors - 1))
        clocks(last + datetime.timedelta(milliseconds=1))
    return sorted(out)


@pytest.fixture
def stateful(spark):
    with S.state_store(spark):
        yield spark


def _streamed(spark, rows, parts, schema, name):
    """The rows as files, one a micro-batch."""
    path = folder(spark, name)
    for k in range(parts):
        spark.createDataFrame(rows[k * len(rows) // parts : (k + 1) * len(rows) // parts], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_replay_by_hand(spark):
    rows = _events()
    got = sorted((r["task_id"], r["at"], r["action"], r["attempt"]) for r in S.replayed(spark.createDataFrame(rows, SCHEMA), POLICY).collect())
    assert got == _by_hand(rows) and {g[2] for g in got} == {"retry", "failed", "ended", "expired"}


@pytest.mark.parametrize("parts", [1, 5])
def test_any_split_gives_the_replay(stateful, parts):
    rows = _events()
    stream = S.retries(_streamed(stateful, rows, parts, SCHEMA, "events"), POLICY, late="2 minutes")
    got = P.drained(stream, folder(stateful, "actions"), folder(stateful, "state")).collect()
    closed = rows[-1][2] - datetime.timedelta(minutes=2)
    assert sorted((r["task_id"], r["at"], r["action"], r["attempt"]) for r in got) == [x for x in _by_hand(rows) if x[1] <= closed]


def test_last_messages(stateful):
    rng = random.Random(1)
    rows = [(rng.randrange(5), i, rng.choice(["user", "assistant"]), f"text {i}") for i in range(60)] + [(None, 1, "user", "x"), (2, None, "user", "x"), (2, 5, None, None)]
    rng.shuffle(rows)
    schema = "session_id long, sequence long, role string, content string"
    found = P.drained(S.histories(_streamed(stateful, rows, 4, schema, "messages"), 6), folder(stateful, "histories"), folder(stateful, "state"), "update").toPandas()
    assert found.batch_id.nunique() > 1
    for session in range(5):
        own = found[found.session_id == session]
        own = own[own.batch_id == own.batch_id.max()].sort_values("place")
        want = sorted((r for r in rows if r[0] == session and r[1] is not None), key=lambda r: (r[1], r[2] or "", r[3] or ""))[-6:]
        assert list(own.sequence) == [r[1] for r in want] and list(own.place) == list(range(1, len(want) + 1))


class _Counted:
    """A task's state in memory, which counts the calls that would be round trips to the state store."""

    def __init__(self):
        self.calls, self.rows, self.value, self.timers = 0, [], None, set()

    def getListState(self, name, schema):
        return self

    getMapState = getValueState = getListState

    def appendValue(self, row):
        self.calls += 1
        self.rows.append(row)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


def test_a_tasks_events_of_a_batch_are_few_calls():
    store = _Counted()
    processor = S._Retries(POLICY)
    processor.init(store)
    frame = pd.DataFrame({"at_ms": range(5000, 15000), "event_id": range(10_000), "status": ["error"] * 10_000})
    list(processor.handleInputRows((1,), iter([frame]), None))
    assert store.calls == 2 and store.timers == {5000} and len(store.rows[0][0]) == 10_000
