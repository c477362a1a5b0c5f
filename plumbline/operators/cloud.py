"""Nearest neighbours inside clouds of any size, over grid cells that many tasks share.

Points (cloud_id, pt_id, x, y, z) lie in cells of their cloud, of k points on average. A point asks
the block of 27 cells around it; each cell, in parts of bounded size, answers with its k best, and the best of all
answers count if none outside the block can be nearer. Points that aren't done ask cells of
twice the side, until all are, or the block holds the whole cloud. No row or task has a cloud.

Points with a null or non-finite coordinate take no part. Equal points are neighbours at distance 0;
a cloud of fewer than k + 1 points gives the neighbours there are. A cell's parts are dealt to
tasks by hash; the work of a crowded cell grows with the square of its points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..core import Written, spread
from .mesh import nearest_k

#: Points of a cell that a task holds at once.
PART = 50_000
CELL = ["cloud_id", "cx", "cy", "cz", "part"]


def answers(k: int, kind: pa.Schema):
    """Over rows sorted by cell part, its points first: the k + 1 smallest distances of each point that asks."""

    def found(points: list, asked: list) -> Iterator[pa.RecordBatch]:
        if points and asked:
            ids, xyz = zip(*asked, strict=True)
            near = nearest_k(np.array(points), k + 1, np.array(xyz))
            yield pa.RecordBatch.from_arrays([pa.array([i[0] for i in ids], kind.field("cloud_id").type), pa.array([i[1] for i in ids], kind.field("pt_id").type), pa.array(near.tolist(), pa.list_(pa.float64()))], ["cloud_id", "pt_id", "d"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, points, asked = None, [], []
        for batch in batches:
            for *cell, asks, pt, x, y, z in zip(*(batch.column(c).to_pylist() for c in (*CELL, "asks", "pt_id", "x", "y", "z")), strict=True):
                if cell != now or len(asked) >= 4096:
                    yield from found(points, asked)
                    now, points, asked = cell, points if cell == now else [], []
                if asks:
                    asked.append(((cell[0], pt), (x, y, z)))
                else:
                    points.append((x, y, z))
        yield from found(points, asked)

    return run


def nearest_others(points: DataFrame, k: int) -> DataFrame:
    """(cloud_id, pt_id, d): each point's distances to its k nearest others, ascending."""
    if k < 1:
        raise ValueError("k must be positive")
    out = Written(points.sparkSession, "neighbours")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = points.select("cloud_id", "pt_id", *(F.col(c).cast("double").alias(c) for c in "xyz")).where(finite("x") & finite("y") & finite("z"))
    ends = rows.groupBy("cloud_id").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{e}") for c in "xyz" for f, e in ((F.min, "lo"), (F.max, "hi"))))
    extent = F.greatest(*(F.col(f"{c}_hi") - F.col(f"{c}_lo") for c in "xyz"))
    side = F.when(extent > 0, extent / F.ceil(F.pow(F.col("n") / F.lit(float(k)), F.lit(1 / 3)))).otherwise(1.0)
    ends = ends.withColumn("side", side)
    rows, _ = out.put(rows.join(ends, "cloud_id"))
    kind = to_arrow_schema(rows.select("cloud_id", "pt_id").schema)
    schema = f"cloud_id {rows.schema['cloud_id'].dataType.simpleString()}, pt_id {rows.schema['pt_id'].dataType.simpleString()}, d array<double>"
    asking, done, level = rows, [], 0
    while True:
        size = F.col("side") * float(2**level)
        at = lambda c: F.floor((F.col(c) - F.col(f"{c}_lo")) / size).alias(f"c{c}")  # noqa: B023, E731
        there = rows.select("cloud_id", "pt_id", *"xyz", *map(at, "xyz"))
        crowd = there.groupBy(CELL[:4]).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        held = there.join(crowd, CELL[:4]).select("*", F.pmod(F.xxhash64("pt_id"), "parts").cast("int").alias("part"), F.lit(0).alias("asks")).drop("parts")
        around = asking.select("cloud_id", "pt_id", *"xyz", *map(at, "xyz"))
        for c in "xyz":
            around = around.withColumn(f"c{c}", F.explode(F.sequence(F.col(f"c{c}") - 1, F.col(f"c{c}") + 1)))
        around = around.join(crowd, CELL[:4]).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("asks")).drop("parts")
        both = spread(held.unionByName(around), *CELL).sortWithinPartitions(*CELL, "asks")
        best = both.mapInArrow(answers(k, kind), schema).groupBy("cloud_id", "pt_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 2, k).alias("d"))  # the first is the point itself

        low, high = (lambda c: F.col(c) - (F.floor((F.col(c) - F.col(f"{c}_lo")) / size) - 1) * size - F.col(f"{c}_lo")), (lambda c: (F.floor((F.col(c) - F.col(f"{c}_lo")) / size) + 2) * size + F.col(f"{c}_lo") - F.col(c))  # noqa: B023, E731
        reach = F.least(*(f(c) for c in "xyz" for f in (low, high)))
        all_of = F.lit(True)
        for c in "xyz":
            all_of &= (F.col(c) - F.col(f"{c}_lo") <= low(c)) & (F.col(f"{c}_hi") - F.col(c) < high(c))
        judged, _ = out.put(asking.join(best, ["cloud_id", "pt_id"]).withColumn("sure", all_of | ((F.size("d") == k) & (F.get("d", F.lit(k - 1)) <= reach * (1 - 1e-9)))))
        done.append(judged.where("sure").select("cloud_id", "pt_id", "d"))
        asking, level = judged.where("NOT sure").drop("d", "sure"), level + 1
        if asking.isEmpty():
            break
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def mean_distance(d: str = "d") -> Column:
    """The mean of a point's distances."""
    return F.aggregate(d, F.lit(0.0), lambda a, x: a + x) / F.size(d)


def neighbour_distances(points: DataFrame) -> DataFrame:
    """(cloud_id, mean_nn): the mean distance to the nearest other point, .05 for a single one."""
    near = nearest_others(points, 1)
    return near.groupBy("cloud_id").agg(F.coalesce(F.avg(F.get("d", F.lit(0))), F.lit(0.05)).alias("mean_nn"))


def unstrayed(points: DataFrame, k: int = 20, deviations: float = 2.0) -> DataFrame:
    """(cloud_id, pt_id) of the points whose mean distance to their k nearest others is at most the cloud's mean plus so many deviations. A single point stays."""
    near, _ = Written(points.sparkSession, "strays").put(nearest_others(points, k).select("cloud_id", "pt_id", F.when(F.size("d") > 0, mean_distance()).alias("m")))
    limits = near.groupBy("cloud_id").agg((F.avg("m") + deviations * F.coalesce(F.stddev_samp("m"), F.lit(0.0))).alias("most"))
    return near.join(limits, "cloud_id").where("m IS NULL OR m <= most").select("cloud_id", "pt_id")
