"""Error, detection and distance measures, and grouped evaluation reports."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, StructType

from ..core import Written
from .mesh import nearest_k

from ..functions.columns import NAN, or_nan, ratio


def error_measures(p: Column, t: Column, where: Column | None = None) -> dict[str, Column]:
    """rmse, mae and bias where both are positive (or `where` holds); NaN over nothing."""
    ok = where if where is not None else (p > 0) & (t > 0)
    d = F.when(ok, p - t)
    return {"rmse": or_nan(F.sqrt(F.avg(d * d))), "mae": or_nan(F.avg(F.abs(d))), "bias": or_nan(F.avg(d))}


def detection_measures(flagged: Column, truth: Column, valid: Column | None = None) -> dict[str, Column]:
    """Counts, precision, recall, f1 and false positive rate; NaN for empty denominators."""
    ok = valid if valid is not None else F.lit(True)
    tp, fp, fn, tn = (F.count_if(ok & a & b) for a, b in ((flagged, truth), (flagged, ~truth), (~flagged, truth), (~flagged, ~truth)))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = F.when(F.isnan(precision) | F.isnan(recall) | (precision + recall == 0), NAN).otherwise(2 * precision * recall / (precision + recall))
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": precision, "recall": recall, "f1": f1, "fpr": ratio(fp, fp + tn), "retention": 1 - ratio(fp, fp + tn)}


#: Points of a cloud that may be sent to all tasks: 24 bytes each.
MAX_SENT = 100_000


def near(a: DataFrame, b: DataFrame, cell: float) -> DataFrame:
    """(id, d): the distance of each point of a to the nearest of b in the 27 cells around it, by an equi-join; exact up to `cell`."""
    dist = F.sqrt(F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2) + F.pow(F.col("z") - F.col("bz"), 2))
    at = lambda c: F.floor(F.col(c) / cell)
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip((i, j, k), "ijk", strict=True))) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1))))
    tried = a.select("id", "x", "y", "z", around.alias("o")).select("id", "x", "y", "z", *((at(c) + F.col(f"o.{n}")).alias(f"g{c}") for c, n in zip("xyz", "ijk", strict=True)))
    other = b.select(*(F.col(c).alias(f"b{c}") for c in "xyz")).select("*", *(at(f"b{c}").alias(f"g{c}") for c in "xyz"))
    return tried.join(other, ["gx", "gy", "gz"]).groupBy("id").agg(F.min(dist).alias("d"))


def nearest(a: DataFrame, b: DataFrame, cell: float | None = None) -> DataFrame:
    """Each point of a (id, x, y, z) with `d`, its distance to the nearest point of b; null if b is empty.

    With `cell` only distances up to cell are needed, and points further away may get null.
    Without it, a cloud b of up to MAX_SENT points is sent to the tasks, which sort it into
    slabs; a larger one is met in grid cells that double until each point has its nearest.
    """
    if cell is not None:
        return a.join(near(a, b, cell), "id", "left")
    facts = b.agg(F.count("*").alias("n"), *(F.max(c).alias(f"{c}1") for c in "xyz"), *(F.min(c).alias(f"{c}0") for c in "xyz")).first()
    if facts.n == 0:
        return a.withColumn("d", F.lit(None).cast("double"))
    if facts.n <= MAX_SENT:
        p = np.array([tuple(r) for r in b.select("x", "y", "z").collect()], float)

        def run(it):
            for pdf in it:
                yield pdf.assign(d=nearest_k(p, 1, pdf[["x", "y", "z"]].to_numpy(float))[:, 0]) if len(pdf) else pdf.assign(d=np.zeros(0))

        return a.mapInPandas(run, StructType([*a.schema.fields]).add("d", DoubleType()))
    out, found = Written(a.sparkSession, "nearest"), None
    both = a.select(*"xyz").unionAll(b.select(*"xyz")).agg(*(F.max(c).alias(f"{c}1") for c in "xyz"), *(F.min(c).alias(f"{c}0") for c in "xyz")).first()
    reach = max(both[f"{c}1"] - both[f"{c}0"] for c in "xyz") * 2 or 1.0
    cell, (left, _) = reach / 2 / max(facts.n ** (1 / 3), 1), out.put(a.select("id", *"xyz"))
    while not left.isEmpty():
        cell = min(cell, reach)
        got, _ = out.put(near(left, b, cell).where(F.lit(cell >= reach) | (F.col("d") <= cell)))
        found = got if found is None else found.unionAll(got)
        left, _ = out.put(left.join(got.select("id"), "id", "left_anti"))
        cell *= 2
    return a.join(found, "id", "left") if found is not None else a.withColumn("d", F.lit(None).cast("double"))


def cloud_distances(a: DataFrame, b: DataFrame, radius: float, sample: int | None = None, seed: int = 0) -> DataFrame:
    """With sample, of at most so many points of each cloud, drawn by a hash. One row: chamfer, hausdorff (NaN if a cloud is empty) and coverage of b within radius (0 if one is empty)."""
    if sample is not None:
        a, b = (x.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "id").cast("binary")), "id").limit(sample) for x in (a, b))
    ab = nearest(a, b).agg(F.avg("d").alias("m1"), F.max("d").alias("x1"))
    ba = nearest(b, a).agg(F.avg("d").alias("m2"), F.max("d").alias("x2"), F.avg(F.coalesce((F.col("d") <= radius).cast("double"), F.lit(0.0))).alias("cov"))
    return ab.join(ba).select(or_nan((F.col("m1") + F.col("m2")) / 2).alias("chamfer"), or_nan(F.when(F.col("x1").isNotNull() & F.col("x2").isNotNull(), F.greatest("x1", "x2"))).alias("hausdorff"), F.coalesce("cov", F.lit(0.0)).alias("coverage"))


def evaluation_report(rows: DataFrame, thresholds: tuple[float, ...] = (0.0, 0.5)) -> DataFrame:
    """Per detector, source, lifter and severity threshold: n, accuracy at 0.5 and medians. A row counts under each threshold it reaches."""
    reached = F.filter(F.array(*(F.lit(t) for t in thresholds)), lambda t: F.col("severity") >= t)
    ok = F.col("success")
    out = rows.withColumn("threshold", F.explode(reached)).groupBy("detector", "source", "lifter", "threshold").agg(
        F.count("*").alias("n"), F.avg((F.col("iou_2d") >= 0.5).cast("double")).alias("acc"), F.median("iou_2d").alias("median_iou_2d"),
        or_nan(F.median(F.when(ok, F.col("z_err_cm")))).alias("median_z_err_cm"), or_nan(F.median(F.when(ok, F.col("iou_3d")))).alias("median_iou_3d"),
    )
    # a fixed form: readers of reports look groups up by this key
    key = F.concat(F.concat_ws("|", "detector", "source", "lifter"), F.lit("_sev>="), F.format_string("%.1f", "threshold"))
    return out.withColumn("key", key)


def flattened(report: DataFrame, stats: list[str]) -> DataFrame:
    """One map of `key__stat` entries over all groups; null values are left out, NaN stays."""
    entries = F.array(*(F.struct(F.concat("key", F.lit(f"__{s}")).alias("k"), F.col(s).cast("double").alias("v")) for s in stats))
    return report.select(F.explode(entries).alias("e")).where("e.v IS NOT NULL").select("e.k", "e.v")


def cells(rows: DataFrame, line: str, column: str, values: list, cell: Column) -> DataFrame:
    """A grid of one aggregate: a line per value of `line`, a column per given value of `column`; null where a cell has no row."""
    return rows.groupBy(line).pivot(column, values).agg(cell)


def timing_summary(rows: DataFrame, total: str = "total") -> DataFrame:
    """Mean, population deviation and share of all stages but the total, from (stage, ms)."""
    a = rows.groupBy("stage").agg(F.avg("ms").alias("mean_ms"), F.stddev_pop("ms").alias("std_ms"))
    part = F.sum(F.when(F.col("stage") != total, F.col("mean_ms"))).over(W.partitionBy())
    return a.withColumn("share_pct", F.when(F.col("stage") == total, 100.0).otherwise(100 * F.col("mean_ms") / part))
