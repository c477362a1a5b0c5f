"""Sensor corruption of long rasters: noise, voids along edges and voids anywhere.

Draws come from an MD5 of seed, frame and pixel, so reruns, other partitionings and a lost
executor's recomputation give the same frame. A frame's pixels are ranked within the
frame, whose size the sensor bounds.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .raster import gradient

#: A depth step of more than so many metres a pixel is an edge.
EDGE = 0.05


def draw(seed: int) -> Column:
    """32 hex digits for each pixel."""
    return F.md5(F.concat_ws("|", F.lit(str(int(seed))), "frame_id", "v", "u").cast("binary"))


def unit(digits: Column, at: int) -> Column:
    """Eleven hex digits as a number over 0, at most 1."""
    return (F.conv(F.substring(digits, at, 11), 16, 10).cast("double") + 1) / float(16**11)


def normal(digits: Column) -> Column:
    """A standard normal value from the digits behind the first ten."""
    return F.sqrt(-2 * F.log(unit(digits, 11))) * F.cos(2 * math.pi * unit(digits, 22))


def edge_voids(px: DataFrame, bleed: int, limit: float = EDGE) -> DataFrame:
    """`edge`: a step of more than limit lies in the bleed x bleed square around the pixel. bleed is 1 at least; an even square reaches further back."""
    bleed = max(int(bleed), 1)
    back, ahead = -(bleed // 2), bleed - 1 - bleed // 2
    px = gradient(px).withColumn("edge", F.greatest(F.abs("gv"), F.abs("gu")) > limit).drop("gu", "gv")
    for line, at in (("v", "u"), ("u", "v")):
        px = px.withColumn("edge", F.max("edge").over(W.partitionBy("frame_id", line).orderBy(at).rangeBetween(back, ahead)))
    return px.withColumn("edge", F.coalesce("edge", F.lit(False)))


def corrupted(px: DataFrame, void_ratio: float, noise: float, bleed: int, seed: int = 0) -> DataFrame:
    """`corrupted`: valid depths get noise that grows with the square of depth, cut at 0; then come voids at
    edges of the clean frame, then voids drawn from all pixels, as many as edges leave of the frame's share."""
    px = edge_voids(px, bleed).withColumn("__d", draw(seed))
    all_of, z = W.partitionBy("frame_id"), F.col("depth")
    budget = F.floor(F.count("*").over(all_of) * F.lit(float(void_ratio))) - F.sum(F.col("edge").cast("int")).over(all_of)
    px = px.withColumn("__budget", budget).withColumn("__r", F.row_number().over(all_of.orderBy("__d", "v", "u")))
    noisy = F.when(z > 0, F.greatest(F.lit(0.0), z + float(noise) * z * z * normal(F.col("__d")))).otherwise(F.greatest(F.lit(0.0), z))
    return px.withColumn("corrupted", F.when(F.col("edge") | (F.col("__r") <= F.col("__budget")), 0.0).otherwise(noisy)).drop("__d", "__r", "__budget")


def injected(px: DataFrame, void_ratio: float, noise: float, seed: int = 0) -> DataFrame:
    """`injected`: of a frame's n valid depths exactly floor(n * ratio) become voids; the others get even noise, cut at 0."""
    z = F.col("depth")
    px = px.withColumns({"__d": draw(seed), "__ok": z > 0})
    n = F.count_if("__ok").over(W.partitionBy("frame_id"))
    px = px.withColumns({"__n": F.floor(n * F.lit(float(void_ratio))), "__r": F.row_number().over(W.partitionBy("frame_id", "__ok").orderBy("__d", "v", "u"))})
    kept = F.greatest(F.lit(0.0), z + float(noise) * normal(F.col("__d")))
    return px.withColumn("injected", F.when(~F.col("__ok"), z).when(F.col("__r") <= F.col("__n"), 0.0).otherwise(kept)).drop("__d", "__ok", "__n", "__r")
