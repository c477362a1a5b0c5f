"""What training reads and reports: epochs over shards, masks, rates, averages, and a checked config."""

from __future__ import annotations

import dataclasses
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import numbered

#: Labels of tokens that the loss leaves out. A fixed value.
IGNORED = -100


@dataclass(frozen=True)
class TrainConfig:
    epochs: int = 120
    batch_size: int = 32
    learning_rate: float = 1e-3
    weight_decay: float = 1e-4
    label_smoothing: float = 0.1
    warmup_epochs: int = 5

    def __post_init__(self):
        if min(self.epochs, self.batch_size) <= 0:
            raise ValueError("epochs and batch_size must be above 0")
        if not 0 < self.warmup_epochs < self.epochs:
            raise ValueError("the warm-up must end within the epochs")

    @classmethod
    def of(cls, config: dict) -> TrainConfig:
        """From a config's keys, each as its default's type."""
        known = {f.name: type(f.default) for f in dataclasses.fields(cls)}
        if unknown := sorted({*config} - {*known}):
            raise ValueError(f"no such settings: {unknown}")
        return cls(**{k: known[k](v) for k, v in config.items()})


def checked_split(split: str) -> str:
    if split not in ("train", "test"):
        raise ValueError(f"a split is train or test, not {split!r}")
    return split


def rate(epoch: Column, cfg: TrainConfig = TrainConfig()) -> Column:
    """The learning rate of an epoch: a line from a tenth up through the warm-up, then half a cosine down."""
    w, n = cfg.warmup_epochs, cfg.epochs - cfg.warmup_epochs
    return cfg.learning_rate * F.when(epoch < w, 0.1 + 0.9 * epoch / w).otherwise((1 + F.cos(math.pi * (epoch - w) / n)) / 2)


def masked_labels(ids: Column, prompt: Column, pad: int | None) -> Column:
    """Token ids with the prompt's and padding's replaced by IGNORED."""
    hidden = lambda x, i: (i < prompt) if pad is None else (i < prompt) | (x == pad)
    return F.transform(ids, lambda x, i: F.when(hidden(x, i), IGNORED).otherwise(x))


def mean_loss(loss: Column) -> Column:
    """The average over batches, 0 without any."""
    return F.coalesce(F.sum(loss), F.lit(0.0)) / F.greatest(F.count(loss), F.lit(1))


def accuracy(predicted: Column, label: Column) -> Column:
    return F.count_if(predicted == label) / F.greatest(F.count("*"), F.lit(1))


def epochs(samples: DataFrame, n: int, seed: int = 0, split: str | None = "train", skip: int = 0) -> DataFrame:
    """Samples (shard, pos, split, ...) of n epochs with `epoch` and `at`, their place in training order from 0.

    Each epoch has its own order of shards, a permutation seeded by seed + epoch; rows of
    other splits don't count, and the first `skip` of those that do are left out. The order
    follows from the shards' counts; no row is ranked beyond its shard.
    """
    spark = samples.sparkSession
    # a missing split is train
    rows = samples if split is None else samples.where(F.coalesce("split", F.lit("train")) == split)
    names = [r.shard for r in samples.select("shard").distinct().orderBy("shard").collect()]  # one a shard
    if not names:
        raise FileNotFoundError("there are no shards")
    order = [(e, names[int(i)], k) for e in range(n) for k, i in enumerate(np.random.default_rng(seed + e).permutation(len(names)))]
    order = spark.createDataFrame(order, f"epoch int, shard {samples.schema['shard'].dataType.simpleString()}, turn int")
    counts = rows.groupBy("shard").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("epoch", "turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per shard and epoch
    starts = order.join(counts, "shard").withColumn("start", before).drop("n", "turn")
    within = rows.withColumn("__r", F.row_number().over(W.partitionBy("shard").orderBy("pos")) - 1)
    return within.join(F.broadcast(starts), "shard").withColumn("at", F.col("start") + F.col("__r")).where(F.col("at") >= skip).drop("start", "__r")


def resumed(samples: DataFrame, order: list[str], done: int) -> DataFrame:
    """The first rows by `order` left out: what a run that took `done` of them before has yet to take. No task has all rows."""
    return numbered(samples, order, "__r").where(F.col("__r") > done).drop("__r")
