"""The status machine of jobs as a stream: legal and illegal moves, time-outs, ended jobs forgotten.

A job's state is its status and, while it runs or waits for review, a deadline. An event that may follow moves the job, another is
given out as illegal and changes nothing. A job that reaches its deadline without a legal move fails at that moment, whether the
clock of the events passes it (a timer) or a later event shows it first. A completed job's state is deleted; so is that of one
that failed or was cancelled and was not queued again within `forget`, by another timer. A job that is not known starts by being queued. Jobs
known from before come in as a table (user_id, status, ms), whose deadlines count from their ms.

Times are whole milliseconds. Events of one batch are taken by time, ties by event_id; batches are taken as they come, so the result is
that of one fold in order of time as long as files are. Rows without key, time or a known status are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tallyframe.operators.state import FOLLOWS

OUT = "user_id long, ms long, event_id long, before string, after string, verdict string"
MOVE = Row(*(c.split()[0] for c in OUT.split(", ")))
#: Statuses with a deadline, and those that are forgotten after a while.
WAITING, IDLE = ("running", "needs_review"), ("failed", "cancelled")


class Machine:
    """The rules, for one job: moves give rows (ms, event_id, before, after, verdict)."""

    def __init__(self, limit: int, forget: int, status: str | None = None, due: int | None = None):
        self.limit, self.forget, self.status, self.due = limit, forget, status, due

    def enter(self, status: str, ms: int) -> None:
        self.status = None if status == "completed" else status
        self.due = ms + self.limit if status in WAITING else ms + self.forget if status in IDLE else None

    def passed(self, ms: int) -> Iterator[tuple]:
        """What deadlines before ms bring about."""
        while self.due is not None and ms > self.due:
            at, before = self.due, self.status
            if before in WAITING:
                self.enter("failed", at)
                yield at, None, before, "failed", "timed_out"
            else:
                self.status = self.due = None
                yield at, None, before, None, "forgotten"

    def event(self, ms: int, event_id: int, status: str) -> Iterator[tuple]:
        yield from self.passed(ms)
        before = self.status
        legal = status == "queued" if before is None else status in FOLLOWS[before]
        if legal:
            self.enter(status, ms)
        yield ms, event_id, before, status, "moved" if legal else "illegal"


class JobMachine(StatefulProcessor):
    """One Machine a key, kept in the state store; its deadline is the key's one timer. Rows come as they are: a pandas frame for each
    key would cost more than its moves."""

    def __init__(self, limit: int, forget: int):
        self.limit, self.forget = limit, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", "status string, due long")

    def _load(self) -> Machine:
        status, due = self.state.get() if self.state.exists() else (None, None)
        return Machine(self.limit, self.forget, status, due)

    def _keep(self, m: Machine, was: int | None) -> None:
        if m.status is None:
            self.state.clear()
        else:
            self.state.update((m.status, m.due))
        if m.due != was:
            if was is not None:
                self.handle.deleteTimer(was + 1)
            if m.due is not None:
                self.handle.registerTimer(m.due + 1)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        m = Machine(self.limit, self.forget)
        m.enter(initialState["status"], initialState["ms"])
        self._keep(m, None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        m = self._load()
        was, out = m.due, []
        for ms, event_id, status in sorted((r["ms"], r["event_id"], r["status"]) for r in rows):
            out += m.event(ms, event_id, status)
        self._keep(m, was)
        yield from (MOVE(key[0], *r) for r in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        m = self._load()
        out = list(m.passed(max(int(expiredTimerInfo.getExpiryTimeInMs()), int(timerValues.getCurrentWatermarkInMs()))))  # all that is due by now
        # the timer that has come is gone; a new deadline needs a new one
        if m.status is None:
            self.state.clear()
        else:
            self.state.update((m.status, m.due))
            if m.due is not None:
                self.handle.registerTimer(m.due + 1)
        yield from (MOVE(key[0], *r) for r in out)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Sets the state store that timers need, and puts back what was set before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, was)


def moves(events: DataFrame, limit: int, forget: int, late: str = "1 hour", known: DataFrame | None = None) -> DataFrame:
    """What happens to each job. events: a stream of user_id, ts (timestamp), event_id, status."""
    held = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull() & F.col("status").isin(*FOLLOWS)).withWatermark("ts", late)
    held = held.select("user_id", "ts", "event_id", "status", F.unix_millis("ts").alias("ms"))
    first = None if known is None else known.select("user_id", "status", "ms").groupBy("user_id")
    return held.groupBy("user_id").transformWithState(JobMachine(limit, forget), OUT, "Append", "EventTime", first)
