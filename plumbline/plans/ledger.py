"""The result ledger and the planner's choices on it."""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..core import ranked

STATUSES = ("done", "failed", "pruned")


def config_hash(config: dict) -> str:
    """SHA-1 of the config as JSON with sorted keys."""
    return hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def upserted(ledger: DataFrame, new: DataFrame, key: str = "config_hash", seq: str = "seq", kept: tuple[str, ...] = ("id", "config_json")) -> DataFrame:
    """A row per key: the one with the largest seq, but `kept` columns from the first."""
    both = ledger.unionByName(new)
    last = both.groupBy(key).agg(F.max_by(F.struct(*(c for c in both.columns if c != key)), seq).alias("l"), *(F.min_by(c, seq).alias(f"first_{c}") for c in kept if c in both.columns))
    return last.select(*(F.col(key) if c == key else F.col(f"first_{c}").alias(c) if c in kept else F.col(f"l.{c}").alias(c) for c in both.columns))


def frontier(ledger: DataFrame, metric: Column, k: int, largest: bool = True, tie: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The top k rows that have the metric, of any status; NaN last, ties by tie."""
    rows = ledger.withColumn("metric", metric).where("metric IS NOT NULL").withColumn("nan", F.isnan("metric"))
    return rows.orderBy("nan", F.desc("metric") if largest else F.asc("metric"), *tie).limit(k).drop("nan")


def promoted(ledger: DataFrame, rung: str, metric: str, eta: int = 3, largest: bool = True, tie: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """The best max(1, n // eta) rows of each rung."""
    if eta < 2:
        raise ValueError("eta must be at least 2")
    order = F.desc(metric) if largest else F.asc(metric)
    rows = ranked(ledger.where(F.col(metric).isNotNull()), rung, [order, *map(F.col, tie)]).withColumn("place", F.col("place").cast("int"))
    return rows.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / eta))).drop("n")


def novel(candidates: DataFrame, ledger: DataFrame, order: str = "pos") -> DataFrame:
    """Candidates whose config isn't in the ledger, the first of equal ones."""
    first = candidates.withColumn("r", F.row_number().over(W.partitionBy("config_hash").orderBy(order))).where("r = 1").drop("r")
    return first.join(ledger.select("config_hash").distinct(), "config_hash", "left_anti")


def experiment_name(hypothesis: Column, kind: Column, config: Column) -> Column:
    return F.concat_ws("-", F.lower(hypothesis), kind, F.substring(config, 1, 10))


@dataclass(frozen=True)
class Param:
    """Values, or a range from low to high."""

    name: str
    values: tuple = ()
    low: float | None = None
    high: float | None = None
    log: bool = False
    whole: bool = False

    def __post_init__(self):
        ranged = self.low is not None and self.high is not None
        if bool(self.values) == ranged or (self.log and (not ranged or self.low <= 0)):
            raise ValueError(f"{self.name} needs either values or a range, and a range above 0 for log")

    def draw(self, r: random.Random):
        if self.values:
            return r.choice(self.values)
        v = math.exp(r.uniform(math.log(self.low), math.log(self.high))) if self.log else r.uniform(self.low, self.high)
        return round(v) if self.whole else v


def raised(config: str, steps: int) -> str:
    """A config's canonical JSON with other max_steps."""
    return json.dumps({**json.loads(config), "max_steps": steps}, sort_keys=True, default=str)


def checked_rungs(rungs: tuple[int, ...], eta: int) -> None:
    if not rungs or len(set(rungs)) < len(rungs):
        raise ValueError(f"rungs must be some and distinct, not {rungs}")
    if eta < 2:
        raise ValueError("eta must be at least 2")


def promotions(ledger: DataFrame, hypothesis: str, rungs: tuple[int, ...], metric: str, eta: int = 3, largest: bool = False) -> DataFrame:
    """(id, rung, place, config_json, config_hash) of the configs of the next rung that the ledger (id, hypothesis, status,
    config_json, config_hash, created_at and the metric) calls for and doesn't know.

    Of each rung but the last the best max(1, n // eta) of the hypothesis' n done rows are
    raised; rows without the metric rank last, and steps that are no rung count as the first.
    """
    checked_rungs(rungs, eta)
    steps = F.get_json_object("config_json", "$.max_steps").try_cast("double")
    at = F.array_position(F.array(*(F.lit(float(r)) for r in rungs)), steps)
    rows = ledger.where((F.col("status") == "done") & (F.col("hypothesis") == hypothesis)).withColumn("rung", F.greatest(F.coalesce(at, F.lit(0)) - 1, F.lit(0)).cast("int"))
    value = F.when(~F.isnan(metric), F.col(metric))
    order = [F.col("__value").desc_nulls_last() if largest else F.col("__value").asc_nulls_last(), F.col("created_at"), F.col("id")]
    rows = rows.where(F.col("rung") < len(rungs) - 1).select("id", "rung", "created_at", "config_json", value.alias("__value"))
    rows = ranked(rows, "rung", order).withColumn("place", F.col("place").cast("int"))
    best = rows.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") / eta))).select("id", "rung", "place", "config_json")

    # the canonical text is Python's; batches of configs go to it
    @F.pandas_udf("string")
    def up(configs: pd.Series, places: pd.Series) -> pd.Series:
        return pd.Series([raised(c, rungs[r + 1]) for c, r in zip(configs, places, strict=True)], dtype=object)

    best = best.withColumn("config_json", up("config_json", "rung"))
    best = best.withColumn("config_hash", F.sha1("config_json"))
    return best.join(ledger.select("config_hash").distinct(), "config_hash", "left_anti").select("id", "rung", "place", "config_json", "config_hash")


def propose(ledger: DataFrame, space: list[Param], kind: str, hypothesis: str, rungs: tuple[int, ...], metric: str, budget: int, eta: int = 3, largest: bool = False, seed: int = 0, most: int | None = 200, base: dict | None = None) -> list[dict]:
    """Successive halving: promotions first, in the order of rungs and places, then fresh draws over base, none of them known; [] without budget.

    A hypothesis of `most` rows gets no fresh draws. One job answers all that the ledger is asked.
    """
    checked_rungs(rungs, eta)
    if budget <= 0:
        return []
    r, drawn = random.Random(seed), {}
    for _ in range(max(20 * budget, 50)):
        config = {**(base or {}), **{p.name: p.draw(r) for p in space}, "max_steps": rungs[0]}
        drawn.setdefault(config_hash(config), config)
    up = promotions(ledger, hypothesis, rungs, metric, eta, largest).orderBy("rung", "place").limit(budget).select("rung", "place", "config_json", "config_hash")
    nothing = [F.lit(None).cast("int").alias("rung"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("config_json")]
    known = ledger.where(F.col("config_hash").isin([*drawn])).select(*nothing, "config_hash")
    count = ledger.where(F.col("hypothesis") == hypothesis).agg(F.count("*").cast("int").alias("place")).select(nothing[0], "place", nothing[2], F.lit(None).cast("string").alias("config_hash"))
    answer = up.unionByName(known).unionByName(count).collect()
    found = {x.config_hash: json.loads(x.config_json) for x in sorted((x for x in answer if x.rung is not None), key=lambda x: (x.rung, x.place))}
    seen = {x.config_hash for x in answer if x.rung is None and x.config_hash}
    if most is None or next(x.place for x in answer if x.config_hash is None) < most:
        found |= {h: c for h, c in drawn.items() if h not in seen and h not in found}
    return [{"name": f"{hypothesis.lower()}-{kind}-{h[:10]}", "kind": kind, "config": c, "config_hash": h} for h, c in [*found.items()][:budget]]


# What is searched, over which steps, where a profile names nothing else.
SPACE = (Param("rank", values=(4, 8, 16, 32)), Param("learning_rate", low=5e-5, high=5e-4, log=True))
RUNGS = (250, 1000, 4000)


def default_scheduler(seed: int = 0) -> Scheduler:
    """Successive halving of the default space by the smallest average loss, three entries at a time."""
    return Scheduler([lambda ledger, budget: propose(ledger, [*SPACE], "lora", "H8", RUNGS, "ema_loss", budget, seed=seed)], 2, 3)


class Scheduler:
    """Fills a queue whose pending entries are fewer than `low` with up to `batch` proposals of one planner, the next one in turn that has any."""

    def __init__(self, planners: list[Callable[[DataFrame, int], list[dict]]], low: int = 2, batch: int = 4):
        if not planners:
            raise ValueError("a scheduler needs a planner")
        self.planners, self.low, self.batch, self.next = planners, low, batch, 0

    def proposals(self, queue: DataFrame, ledger: DataFrame) -> list[dict]:
        if queue.agg(F.count_if(F.col("status") == "pending").alias("n")).first().n >= self.low:
            return []
        for k in range(len(self.planners)):
            i = (self.next + k) % len(self.planners)
            if made := self.planners[i](ledger, self.batch):
                self.next = (i + 1) % len(self.planners)
                return made
        return []

    def refill(self, queue: DataFrame, ledger: DataFrame) -> DataFrame | None:
        """Entries for Q.extended, or None."""
        rows = [(i, p["name"], p["kind"], json.dumps(p["config"], sort_keys=True, default=str), [], "pending", 0, 2, None, None) for i, p in enumerate(self.proposals(queue, ledger))]
        return queue.sparkSession.createDataFrame(rows, queue.schema) if rows else None


def recorded(rows: DataFrame) -> DataFrame:
    """rows for the ledger; fails on a status that isn't known."""
    bad = ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False))
    return rows.withColumn("status", F.when(bad, F.raise_error(F.concat(F.lit("no such status: "), F.coalesce("status", F.lit("null"))))).otherwise(F.col("status")))


def scanned(ledger: DataFrame, hypothesis: str | None = None) -> DataFrame:
    """The ledger, or one hypothesis of it, by age, with its config as a variant."""
    rows = ledger if hypothesis is None else ledger.where(F.col("hypothesis") == hypothesis)
    return (rows.withColumn("config", F.try_parse_json("config_json")) if "config_json" in rows.columns else rows).orderBy("created_at", "id")


def counted(ledger: DataFrame, hypothesis: str | None = None) -> DataFrame:
    """(hypothesis, n), or of one hypothesis only."""
    rows = ledger if hypothesis is None else ledger.where(F.col("hypothesis") == hypothesis)
    return rows.groupBy("hypothesis").agg(F.count("*").alias("n"))


def sweep(axes: list[DataFrame]) -> DataFrame:
    """The product of small axis tables, the last one fastest; each brings an index column of its own to order by."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(F.broadcast(a))  # axes are lists in a config
    return out


#: Fixed labels of the sweeps' axes; others are named by what stands behind their last dot.
LABELS = {"lora.rank": "r", "curriculum.schedule": "cur", "datagen.vocab_mode": "vocab"}


@dataclass(frozen=True)
class Axis:
    key: str
    values: tuple

    def __post_init__(self):
        if not self.key or not self.values:
            raise ValueError("an axis needs a key and values")


def grid(spark: SparkSession, name: str, kind: str, axes: list[Axis], requires: tuple[str, ...] = (), max_retries: int = 2) -> DataFrame:
    """Queue entries of a sweep's points, the last axis fastest."""
    if not name or not kind or not axes:
        raise ValueError("a grid needs a name, a kind and axes")
    said = lambda a, v: f"{label(a.key)}{'' if isinstance(v, (int, float)) and not isinstance(v, bool) else '='}{v}"
    rows = []
    for i, point in enumerate(product(*(a.values for a in axes))):
        config = json.dumps({a.key: v for a, v in zip(axes, point, strict=True)}, sort_keys=True, default=str)
        rows.append((i, "-".join([name, *map(said, axes, point)]), kind, config, list(requires), "pending", 0, max_retries, None, None))
    return spark.createDataFrame(rows, "pos int, name string, kind string, config string, requires array<string>, status string, retries int, max_retries int, owner string, heartbeat double")


def default_grid(spark: SparkSession) -> DataFrame:
    """The sweep of twelve arms where none is named. Its axes and what it requires."""
    axes = [Axis("lora.rank", (8, 16, 32)), Axis("curriculum.schedule", ("curriculum", "uniform")), Axis("datagen.vocab_mode", ("wide", "narrow"))]
    return grid(spark, "lora", "lora", axes, ("datagen-mini",))



def label(key: str) -> str:
    return LABELS.get(key, key.rsplit(".", 1)[-1])


def axis_label(key: Column) -> Column:
    """The same of a column."""
    known = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, key), F.substring_index(key, ".", -1))


def coordinate(label: str | Column, value: Column, numeric: bool) -> Column:
    """label and value, with = between them unless the value is a number."""
    label = F.lit(label) if isinstance(label, str) else label
    return F.concat(label, F.lit("" if numeric else "="), value.cast("string"))


def setting(config: Column, key: str, default: Column) -> Column:
    """A key of a map, or the default where it is absent."""
    return F.coalesce(F.try_element_at(config, F.lit(key)), default)


def merged(*configs: Column) -> Column:
    """Maps put over each other: of a repeated key the last value counts."""
    keys = F.array_distinct(F.concat(*(F.map_keys(c) for c in configs)))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(*(F.try_element_at(c, k) for c in reversed(configs)))))


def unknown_keys(config: Column, known: tuple[str, ...]) -> Column:
    """The map's keys that aren't known, sorted."""
    return F.array_sort(F.array_except(F.map_keys(config), F.array(*map(F.lit, known))))


def kept_checkpoints(dirs: DataFrame, keep: int, pointed: str | None) -> DataFrame:
    """The newest `keep` step folders and the one that is pointed to."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    return dirs.orderBy(F.desc("name")).limit(keep).unionAll(dirs.where(F.col("name") == F.lit(pointed))).distinct()


def held_out(categories: DataFrame, share: float) -> DataFrame:
    """`split`: the first max(1, round(share * n)) categories by SHA-1 are held out; halves round to even."""
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    rows = categories.select("category").distinct().withColumn("h", F.sha1("category"))
    first = rows.orderBy("h").limit(max(1, round(share * rows.count()))).agg(F.max("h").alias("last"))
    return rows.join(F.broadcast(first)).select("category", F.when(F.col("h") <= F.col("last"), "holdout").otherwise("train").alias("split"))  # one row
