"""The status machine as a stream against a fold over the same events, also after a restart in mid-log."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from tallyframe.operators.state import FOLLOWS
from tallyframe.streaming import events as E
from tallyframe.streaming import machine as M

SCHEMA = "user_id long, ts timestamp, event_id long, status string"
LIMIT, FORGET = 50_000, 200_000
BASE = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def fold(events, known, watermark):
    """By plain rules, job by job: status and deadline in two variables."""
    out = []
    for user in sorted({e[0] for e in events} | set(known)):
        status, due = (known[user][0], known[user][1] + LIMIT) if user in known else (None, None)
        mine = sorted((ms, i, s) for u, ms, i, s in events if u == user)
        for ms, i, s in [*mine, (watermark, None, None)]:
            if due is not None and ms > due and status in ("running", "needs_review"):
                out.append((user, due, None, status, "failed", "timed_out"))
                status, due = "failed", due + FORGET
            if due is not None and ms > due and status in ("failed", "cancelled"):
                out.append((user, due, None, status, None, "forgotten"))
                status = due = None
            if s is None:
                continue
            if s == "queued" if status is None else s in FOLLOWS[status]:
                out.append((user, ms, i, status, s, "moved"))
                due = ms + LIMIT if s in ("running", "needs_review") else ms + FORGET if s in ("failed", "cancelled") else None
                status = None if s == "completed" else s
            else:
                out.append((user, ms, i, status, s, "illegal"))
    return out


def made(seed, n=400):
    rng = random.Random(seed)
    start = int(BASE.timestamp() * 1000)
    after = {None: ["queued"], **{k: list(v) or ["queued"] for k, v in FOLLOWS.items()}}
    events, last = [], {}
    for i in range(n):
        user = rng.randrange(12)
        s = rng.choice(after[last.get(user)]) if rng.random() < 0.8 else rng.choice(list(FOLLOWS))
        last[user] = s
        events.append((user, start + i * 3000 + rng.randrange(3000), i, s))
    return events


def write(spark, folder, events, name):
    rows = [(u, BASE + dt.timedelta(milliseconds=ms - int(BASE.timestamp() * 1000)), i, s) for u, ms, i, s in events]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder, known):
    rows = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)
    first = spark.createDataFrame([(u, s, ms) for u, (s, ms) in known.items()], "user_id long, status string, ms long")
    return M.moves(rows, LIMIT, FORGET, "10 seconds", first)


def key(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def test_as_a_fold_over_a_restart(spark, tmp_path):
    events = made(1)
    known = {0: ("running", events[0][1] - 10), 3: ("failed", events[0][1]), 99: ("needs_review", events[0][1])}
    known_fold = {u: v for u, v in known.items() if u != 3}
    with M.rocksdb(spark):
        folder, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
        for part in range(2):
            write(spark, folder, events[part * 100 : part * 100 + 100], f"a{part}")
        E.drained(stream(spark, folder, known), folder=out)
        for part in range(2, 4):  # a new query over the same checkpoint
            write(spark, folder, events[part * 100 : part * 100 + 100], f"a{part}")
        got = [tuple(r) for r in E.drained(stream(spark, folder, known), folder=out).collect()]
    watermark = events[-1][1] - 10_000
    want = fold([e for e in events if e[0] != 3], known_fold, watermark)
    assert key(r for r in got if r[0] != 3) == key(want)
    verdicts = {r[5] for r in got}
    assert verdicts == {"moved", "illegal", "timed_out", "forgotten"} and any(r[0] == 99 for r in got)


@pytest.mark.parametrize("seed", range(5))
def test_rules_as_a_fold(seed):
    events = made(seed, 200)
    watermark = events[-1][1] + 10 * FORGET
    got = []
    for user in {e[0] for e in events}:
        m = M.Machine(LIMIT, FORGET)
        for ms, i, s in sorted((ms, i, s) for u, ms, i, s in events if u == user):
            got += [(user, *r) for r in m.event(ms, i, s)]
        got += [(user, *r) for r in m.passed(watermark)]
    assert key(got) == key(fold(events, {}, watermark))


def test_moves_are_rows():
    """A job's rows are taken and given as rows; a pandas frame for each job took most of the time."""
    from types import SimpleNamespace as Of

    kept = {}
    state = Of(exists=lambda: "s" in kept, get=lambda: kept["s"], update=lambda v: kept.update(s=v), clear=lambda: kept.pop("s", None))
    job = M.JobMachine(LIMIT, FORGET)
    job.init(Of(getValueState=lambda *_: state, registerTimer=lambda at: kept.update(due=at), deleteTimer=lambda at: kept.pop("due")))
    got = list(job.handleInputRows((7,), iter([{"ms": 5, "event_id": 2, "status": "running"}, {"ms": 3, "event_id": 1, "status": "queued"}]), None))
    assert [r.asDict() for r in got] == [dict(user_id=7, ms=m, event_id=e, before=b, after=a, verdict="moved") for m, e, b, a in ((3, 1, None, "queued"), (5, 2, "queued", "running"))]
    assert kept == {"s": ("running", 5 + LIMIT), "due": 6 + LIMIT}
