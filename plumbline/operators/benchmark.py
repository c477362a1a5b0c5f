"""Benchmark records: grids of voids and noise, made frames, measures of each, and medians over seeds."""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core import spread
from ..functions.columns import NAN, or_nan, ratio
from . import compose, mesh, shape
from .geometry import stable_z
from .raster import DEFAULT, FilterConfig, mask_kernel

# The published protocol's grid, map, spikes and shapes.
VOIDS, NOISES, SEEDS = (0.10, 0.30, 0.50, 0.70, 0.85), (0.005, 0.015, 0.030, 0.050), 5
SIDE, DEPTH, SPIKES, SPIKE = 100, 2.0, 60, 0.6
CELLS = ((0.30, 0.010), (0.30, 0.020), (0.50, 0.010), (0.50, 0.020), (0.50, 0.030), (0.70, 0.010), (0.70, 0.030))
SHAPES = (("ball", (1.0,), "sphere-like"), ("ball", (0.5,), "sphere-like"), ("box", (1, 1, 1), "box-like / compact"), ("box", (1, 2, 1), "box-like / compact"), ("tube", (0.1, 5.0), "elongated"), ("tube", (0.2, 4.0), "elongated"))


def cross(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """The product of short lists, the last one fastest; with its number as `cell`."""
    out = None
    for name, values in axes.items():
        a = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"__{name} long, {name} {'double' if isinstance(values[0], float) else 'string' if isinstance(values[0], str) else 'long'}")
        out = a if out is None else out.crossJoin(F.broadcast(a))  # lists of a protocol
    number = F.lit(0).cast("long")
    for name, values in axes.items():
        number = number * len(values) + F.col(f"__{name}")
    return out.withColumn("cell", number).drop(*(f"__{n}" for n in axes))


def rmse_ratio(before: Column, after: Column) -> Column:
    """How many times smaller the error has become; NaN where nothing is left of it or either is unknown."""
    return F.when(before.isNull() | F.isnan(before), NAN).otherwise(ratio(before, after))


def sigma_error(found: Column, true: Column) -> Column:
    """The relative error of a noise estimate; NaN without noise."""
    return F.when(~(true > 0) | true.isNull() | F.isnan(true), NAN).otherwise(F.abs(found - true) / true)


def known_median(c: Column) -> Column:
    """The median of what is neither null nor NaN; NaN of nothing."""
    return or_nan(F.median(F.when(~F.isnan(c), c)))


def made(void_ratio: float, noise: float, seed: int, side: int = SIDE, depth: float = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(truth, a noisy map of it with exactly int(n * void_ratio) voids)."""
    r = np.random.default_rng(seed)
    truth = np.full((side, side), depth)
    out = np.maximum(truth + r.normal(0, noise, truth.shape), 0)
    out.flat[r.choice(out.size, int(out.size * void_ratio), replace=False)] = 0
    return truth, out


RUNS = "void_ratio double, noise_std double, seed long, z_error_cm double, rmse_before double, rmse_after double, mae_after double, bias_after double, sigma_hat double, flag_rate double, timing_ms double"


def measured(grid: DataFrame, cfg: FilterConfig = DEFAULT) -> DataFrame:
    """The filter's measures on one made map for each row (void_ratio, noise_std, seed) of grid."""

    def one(void: float, noise: float, seed: int) -> tuple:
        truth, bad = made(void, noise, seed)
        ok, start = bad > 0, time.perf_counter()
        mask, sigma, _ = mask_kernel(bad, cfg)
        z = stable_z(bad, (0, 0, *bad.shape[::-1]), cfg)
        spent = time.perf_counter() - start
        clean = ok & ~mask
        off = lambda where: (bad - truth)[where]
        rms = lambda d: float(np.sqrt((d**2).mean())) if len(d) else NAN
        mean = lambda d: float(d.mean()) if len(d) else NAN
        return (
            void, noise, seed, NAN if z is None else abs(z - DEPTH) * 100, rms(off(ok)), rms(off(clean)), mean(np.abs(off(clean))), mean(off(clean)),
            float(np.median(sigma[ok])) if ok.any() else NAN, float((mask & ok).sum() / ok.sum()) if ok.any() else NAN, spent * 1000,
        )

    def run(it):
        for pdf in it:
            yield pd.DataFrame([one(*r) for r in pdf.itertuples(index=False)], columns=[c.split(" ")[0] for c in RUNS.split(", ")])

    return spread(grid.select("void_ratio", "noise_std", "seed")).mapInPandas(run, RUNS)


def sweep_record(runs: DataFrame) -> DataFrame:
    """Per cell (void_ratio, noise_std) the medians over seeds of measured()'s columns; the ratio is that of the two medians."""
    found = runs.withColumn("sigma_rel_err", sigma_error(F.col("sigma_hat"), F.col("noise_std")))
    names = ("z_error_cm", "rmse_before", "rmse_after", "mae_after", "bias_after", "sigma_rel_err", "flag_rate", "timing_ms")
    cells = found.groupBy("void_ratio", "noise_std").agg(*(known_median(F.col(n)).alias(n) for n in names))
    return cells.withColumn("rmse_ratio", rmse_ratio(F.col("rmse_before"), F.col("rmse_after")))


SPIKED = "void_ratio double, noise_std double, seed long, n long, precision double, recall double, f1 double, retention double"


def spiked(grid: DataFrame, cfg: FilterConfig = DEFAULT) -> DataFrame:
    """How well the mask finds SPIKES spikes in a made map for each row of grid; maps with fewer valid pixels have no row."""

    def one(void: float, noise: float, seed: int) -> tuple | None:
        _, bad = made(void, noise, seed)
        ok = bad > 0
        if ok.sum() < SPIKES:
            return None
        truth = np.zeros(bad.shape, bool)
        truth.flat[np.random.default_rng(seed + 100).choice(np.flatnonzero(ok), SPIKES, replace=False)] = True
        mask = mask_kernel(bad + SPIKE * truth, cfg)[0]
        part = lambda a, b: float((a & b & ok).sum() / (b & ok).sum()) if (b & ok).any() else NAN
        p, r = part(truth, mask), part(mask, truth)
        return void, noise, seed, int(ok.sum()), p, r, 2 * p * r / (p + r) if p + r > 0 else NAN, 1 - part(mask, ~truth)

    def run(it):
        for pdf in it:
            yield pd.DataFrame([x for x in (one(*r) for r in pdf.itertuples(index=False)) if x], columns=[c.split(" ")[0] for c in SPIKED.split(", ")])

    return spread(grid.select("void_ratio", "noise_std", "seed")).mapInPandas(run, SPIKED)


def outlier_record(runs: DataFrame) -> DataFrame:
    """Per cell the medians over seeds of spiked()'s measures."""
    return runs.groupBy("void_ratio", "noise_std").agg(*(known_median(F.col(n)).alias(n) for n in ("precision", "recall", "f1", "retention")))


def shape_accuracy(rows: DataFrame) -> DataFrame:
    """(n, accuracy) of rows (expected, predicted): a prediction is right if it holds what is expected, whatever the case."""
    from ..functions.parsing import contains_folded

    return rows.agg(F.count("*").alias("n"), F.avg(F.coalesce(contains_folded(F.col("predicted"), F.col("expected")), F.lit(False)).cast("double")).alias("accuracy"))


def shapes(spark: SparkSession) -> DataFrame:
    """(shape, expected, predicted, compactness, aspect_ratio) of the protocol's bodies."""
    rows = []
    for kind, size, expected in SHAPES:
        d = mesh.described(*compose.primitive(kind, size, 30))
        rows.append((f"{kind} {size}", expected, d["compactness"], d["aspect_ratio"]))
    df = spark.createDataFrame(rows, "shape string, expected string, compactness double, aspect_ratio double")
    return df.withColumn("predicted", shape.shape_label(F.col("compactness"), F.col("aspect_ratio")))


def colour_limits(px: DataFrame, value: str, low: float = 2, high: float = 98) -> DataFrame:
    """(frame_id, lo, hi): percentiles of a value over valid pixels; 0 and 1 without any."""
    q = F.percentile(F.when(F.col("depth") > 0, F.col(value)), F.array(F.lit(low / 100), F.lit(high / 100)))
    return px.groupBy("frame_id").agg(q.alias("q")).select("frame_id", F.coalesce(F.get("q", F.lit(0)), F.lit(0.0)).alias("lo"), F.coalesce(F.get("q", F.lit(1)), F.lit(1.0)).alias("hi"))


def true_z(px: DataFrame) -> DataFrame:
    """(frame_id, z_true): the median of positive depths, infinite ones too; null without any."""
    return px.groupBy("frame_id").agg(F.median(F.when(F.col("depth") > 0, F.col("depth"))).alias("z_true"))
