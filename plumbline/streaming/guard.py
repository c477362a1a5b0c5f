"""Metric logs, and the loss guard: a keyed fold of a log, as a batch and as a stream with equal results.

State per run: the moving average of the loss, its best value and that value's step, how
many steps in a row were worse than the best by the tolerance, and rollbacks so far. A step
is `new_best`, `ok`, a `rollback` to the best average, or `exhausted` where no rollback is
left. A new best counts at any step; worse steps count from the warm-up's end on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core import file_system

LOG = "run string, step bigint, loss double"
OUT = "run string, step bigint, loss double, ema_loss double, best_ema double, best_step bigint, worsening int, rollbacks int, event string"
STATE = "ema double, best double, best_step bigint, worsening int, rollbacks int"
NEW = (None, None, 0, 0, 0)
FIELDS = "run string, step bigint, epoch bigint, loss double, lr double, grad_norm double, ema_loss double, best_ema double, event string"


@dataclass(frozen=True)
class GuardConfig:
    decay: float = 0.9
    tolerance: float = 0.02
    patience: int = 25
    warmup: int = 40
    most: int = 3


def step(state: tuple, at: int, loss: float | None, cfg: GuardConfig) -> tuple[tuple, str | None]:
    """The next state and the event. A line without a loss, or with one that isn't a number, changes nothing and is no event."""
    if loss is None or loss != loss:
        return state, None
    ema, best, best_step, worse, rollbacks = state
    ema = loss if ema is None else cfg.decay * ema + (1 - cfg.decay) * loss
    if best is None or ema < best:
        return (ema, ema, at, 0, rollbacks), "new_best"
    if at < cfg.warmup:
        return (ema, best, best_step, worse, rollbacks), "ok"
    worse = worse + 1 if ema > best * (1 + cfg.tolerance) else 0
    if worse < cfg.patience:
        return (ema, best, best_step, worse, rollbacks), "ok"
    if rollbacks >= cfg.most:
        return (ema, best, best_step, worse, rollbacks), "exhausted"
    return (best, best, best_step, 0, rollbacks + 1), "rollback"


def guard_batch(log: DataFrame, cfg: GuardConfig = GuardConfig()) -> DataFrame:
    """The events of (run, step, loss). Runs are sorted and folded a batch at a time, so a run of any length fits."""
    names = [c.split(" ")[0] for c in OUT.split(", ")]

    def run(batches):
        at, state = None, NEW
        for b in batches:
            out = []
            for who, k, loss in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if who != at:
                    at, state = who, NEW
                state, event = step(state, k, loss, cfg)
                out.append((*state, event))
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=names)

    rows = log.select(F.col("run").cast("string"), F.col("step").cast("long"), F.col("loss").cast("double"))
    return rows.repartition("run").sortWithinPartitions("run", "step").mapInArrow(run, OUT)


def guard_stream(log: DataFrame, cfg: GuardConfig = GuardConfig()) -> DataFrame:
    """The same over a stream, whose files or batches bring each run's steps in order."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        at = tuple(None if pd.isna(v) else v for v in state.get) if state.exists else NEW
        rows = pd.concat(batches).sort_values("step")
        out = []
        for r in rows.itertuples(index=False):
            at, event = step(at, int(r.step), r.loss, cfg)
            out.append((r.run, r.step, r.loss, *at, event))
        state.update(at)
        yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in OUT.split(", ")]).astype({"best_step": "Int64"})

    return log.groupBy("run").applyInPandasWithState(run, OUT, STATE, "append", "NoTimeout")


def read_log(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """A JSON-lines metric log; lines bring the fields they have. A stream reads a file per batch and resumes from its checkpoint."""
    return (spark.readStream.option("maxFilesPerTrigger", 1) if streaming else spark.read).schema(FIELDS).json(path)


def append_log(spark: SparkSession, path: str, **fields: object) -> None:
    """One line more, in a file of its own, whose name sorts behind all that are there: appends never rewrite a file, so a reader sees whole lines only."""
    fs, folder = file_system(spark, path)
    fs.mkdirs(folder)
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"part-{len(fs.listStatus(folder)):09d}.json")
    out = fs.create(name, False)
    try:
        out.write(bytearray((json.dumps(fields) + "\n").encode()))
    finally:
        out.close()


def write_log(events: DataFrame, path: str, checkpoint: str):
    """A streamed log or its guard's events, appended as JSON lines; the stream's handle."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def sampled(rows: DataFrame, ts: str, value: str, seconds: int = 60, key: str | None = None) -> DataFrame:
    """(window start, n, mean, max) of a gauge over fixed periods, as a sampler of that period reports it."""
    keys = [F.window(ts, f"{seconds} seconds").getField("start").alias("at"), *([F.col(key)] if key else [])]
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("most"))


def running_ema(log: DataFrame, decay: float = 0.9) -> DataFrame:
    """(run, ema_loss) after all steps: the average of guard_batch without its rollbacks."""
    events = guard_batch(log, GuardConfig(decay=decay, warmup=2**62))
    return events.groupBy("run").agg(F.max_by("ema_loss", "step").alias("ema_loss"))


def last_values(log: DataFrame, *names: str) -> DataFrame:
    """(run, last_step, last_<name>): the largest step and the value of each field in the last line that has it."""
    return log.groupBy("run").agg(F.max("step").alias("last_step"), *(F.max_by(n, F.when(F.col(n).isNotNull(), F.col("step"))).alias(f"last_{n}") for n in names))


def running_best(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """`is_best`: the value is strictly above 0 and all before it."""
    from pyspark.sql import Window as W

    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("is_best", F.col(value) > F.coalesce(F.max(value).over(before), F.lit(0.0)))
