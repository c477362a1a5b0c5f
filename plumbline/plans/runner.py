"""The loop that works a queue off, and the check of a session's progress."""

from __future__ import annotations

import logging
import signal
import threading
import time
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, functions as F

from ..core import Written
from . import canary, queue as Q

log = logging.getLogger(__name__)
STOPPED, DRAINED, UNHEALTHY = 0, 3, 4
OUTCOMES = ("completed", "preempted", "failed")


@contextmanager
def beating(beat: Callable[[], None], every: float) -> Iterator[None]:
    """Calls beat at even times while the block runs. A beat that raises is logged, and the next one is tried."""
    done = threading.Event()

    def loop() -> None:
        while not done.wait(every):
            try:
                beat()
            except Exception:
                log.exception("a heartbeat failed")

    thread = threading.Thread(target=loop, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()


def stop_on_signal(number: int = signal.SIGTERM) -> Callable[[], bool]:
    """A `stopped` for run() that says so once the process has got the signal; jobs may ask it too, and give up as preempted."""
    got = threading.Event()
    signal.signal(number, lambda *_: got.set())
    return got.is_set


def run(
    queue: DataFrame, jobs: Mapping[str, Callable[[Row], str]], owner: str, ttl: float, *, checks: Mapping[str, Callable[[], bool]] | None = None,
    refill: Callable[[DataFrame], DataFrame | None] | None = None, stopped: Callable[[], bool] = lambda: False, now: Callable[[], float] = time.time, wait: Callable[[], None] = lambda: time.sleep(30.0),
) -> tuple[int, DataFrame]:
    """Claims entries and runs their kind's job until the queue is drained (3) or `stopped` says so (0); (code, queue).

    Checks that fail end it before the first claim (4). A job returns an outcome; one that
    raises, returns something else or whose kind is unknown has failed. With nothing to
    claim, entries that can't be satisfied fail, then `refill` may give new entries, and
    otherwise `wait` is called. While a job runs its claim is renewed every third of ttl. Each state is written, so lineage doesn't grow.
    """
    if checks is not None:
        try:
            canary.assert_healthy(checks)
        except canary.Halt:
            log.exception("not started")
            return UNHEALTHY, queue
    out, columns = Written(queue.sparkSession, "runner"), queue.columns
    state, last = out.put(queue)

    turn = threading.RLock()

    def put(change: Callable[[DataFrame], DataFrame]) -> None:
        nonlocal state, last
        with turn:
            old, (state, last) = last, out.put(change(state).select(columns))
            out.drop(old)

    while not stopped():
        at = float(now())
        first = Q.claimable(state, at, ttl).orderBy("pos").first()
        if first is None:
            put(Q.fail_unsatisfiable)
            new = refill(state) if refill else None
            if new is not None and not new.isEmpty():
                put(lambda q, new=new: Q.extended(q, new))
                continue
            if Q.is_drained(state).first().drained:
                return DRAINED, state
            wait()
            continue
        put(lambda q, at=at: Q.claim_next(q, owner, at, ttl))
        try:
            with beating(lambda name=first["name"]: put(lambda q: Q.heartbeat(q, name, owner, float(now()))), ttl / 3):
                outcome = jobs[first["kind"]](first)
            if outcome not in OUTCOMES:
                raise ValueError(f"no such outcome: {outcome!r}")
        except Exception:
            log.exception("%s failed", first["name"])
            outcome = "failed"
        put(lambda q, name=first["name"], outcome=outcome: Q.release(q, name, owner, outcome))
    return STOPPED, state


def session_progress(sessions: DataFrame, checkpoints: DataFrame, slack: float = 60.0) -> DataFrame:
    """sessions (name, started) with `newest` and `stale`: no checkpoint (name, written), or none since `slack` seconds before the start."""
    newest = checkpoints.groupBy("name").agg(F.max("written").alias("newest"))
    return sessions.join(newest, "name", "left").withColumn("stale", F.col("newest").isNull() | (F.col("newest") < F.col("started") - slack))


def slice_minutes(session: float, buffer: float) -> float:
    """What is left of a session for the runner."""
    if session <= buffer:
        raise ValueError(f"a session of {session} minutes leaves nothing beyond its buffer of {buffer}")
    return session - buffer
