"""Claims of queue entries as a stream with timers: who doesn't renew a claim in time loses it, without any row or polling driver.

Events (name, owner, kind, outcome, at): a `claim`, a `beat` or a `release` of an entry,
at event time in epoch seconds. State per entry: status, owner and last beat. A claim sets a
timer of processing time, a beat moves it, and where it runs out the entry is pending
again and a row says so. Rules are those of plans.queue: an entry that runs can be claimed only by
nobody else, beats and releases of others are errors in the row, and outcomes are
`completed`, `preempted` and `failed`.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.queue import DONE, FAILED, PENDING, RUNNING

EVENTS = "name string, owner string, kind string, outcome string, at double"
CLAIMS = "name string, owner string, status string, event string, retries int"
STATE = "status string, owner string, retries int, timer long"
#: Kinds of events, and what a row may say happened.
CLAIM, BEAT, RELEASE = "claim", "beat", "release"
EXPIRED, REFUSED = "expired", "refused"
AFTER = {"completed": DONE, "preempted": PENDING}
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def transition(state: tuple, owner: str, kind: str, outcome: str | None, most: int) -> tuple[tuple, str]:
    """((status, owner, retries), event) after an event of an entry."""
    status, holder, retries = state
    if kind == CLAIM and status == PENDING:
        return (RUNNING, owner, retries), CLAIM
    if status != RUNNING or holder != owner or kind not in (BEAT, RELEASE):
        return state, REFUSED
    if kind == BEAT:
        return state, BEAT
    if outcome == "failed":
        return (PENDING if retries < most else FAILED, None, retries + 1), RELEASE
    return ((AFTER[outcome], None, retries), RELEASE) if outcome in AFTER else (state, REFUSED)


class Claims(StatefulProcessor):
    def __init__(self, ttl: float, most: int):
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("claim", STATE)

    def held(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (PENDING, None, 0, 0)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *state, timer = self.held()
        now, out, state = timerValues.getCurrentProcessingTimeInMs(), [], tuple(state)
        for r in pd.concat(rows).sort_values("at", kind="stable").itertuples(index=False):
            state, event = transition(state, r.owner, r.kind, r.outcome, self.most)
            out.append((key[0], state[1], state[0], event, state[2]))
            if event in (CLAIM, BEAT, RELEASE) and timer:
                self.handle.deleteTimer(timer)
                timer = 0
            if event in (CLAIM, BEAT):
                timer = now + int(self.ttl * 1000)
                self.handle.registerTimer(timer)
        self.state.update((*state, timer))
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in CLAIMS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, _, retries, timer = self.held()
        if status == RUNNING and timer == expiredTimerInfo.getExpiryTimeInMs():
            self.state.update((PENDING, None, retries, 0))
            yield pd.DataFrame([(key[0], None, PENDING, EXPIRED, retries)], columns=[c.split(" ")[0] for c in CLAIMS.split(", ")])


def claims(events: DataFrame, ttl: float, max_retries: int = 2) -> DataFrame:
    """What each event did, and a row for each claim that ran out. A claim lives for ttl seconds after it or its last beat was seen."""
    return events.groupBy("name").transformWithStateInPandas(Claims(ttl, max_retries), CLAIMS, "Append", "ProcessingTime")


@contextmanager
def configured(spark: SparkSession) -> Iterator[None]:
    """State with timers needs the RocksDB store; other streams of the session keep theirs."""
    before = spark.conf.get(PROVIDER[0], None)
    spark.conf.set(*PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER[0]) if before is None else spark.conf.set(PROVIDER[0], before)
