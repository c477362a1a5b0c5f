"""Projection, boxes and lifting."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..core import spread
from ..functions.columns import NAN
from .raster import DEFAULT, FilterConfig, mask_kernel, restore_kernel


@dataclass(frozen=True)
class Intrinsics:
    fx: float
    fy: float
    cx: float
    cy: float

    def __post_init__(self):
        if self.fx == 0 or self.fy == 0:
            raise ValueError("fx and fy must not be zero")

    @staticmethod
    def from_fov(width: int, height: int, degrees: float) -> Intrinsics:
        f = 0.5 * width / float(np.tan(np.radians(degrees) / 2))
        return Intrinsics(f, f, width / 2, height / 2)


def backproject(px: DataFrame, k: Intrinsics | None, depth: str = "depth") -> DataFrame:
    """`x`, `y`, `z`; without intrinsics the pixel grid itself. Zero depth gives the origin."""
    z = F.col(depth).cast("double")
    if k is None:
        return px.withColumns({"x": F.col("u").cast("double"), "y": F.col("v").cast("double"), "z": z})
    return px.withColumns({"x": (F.col("u") - k.cx) * z / k.fx, "y": (F.col("v") - k.cy) * z / k.fy, "z": z})


def valid_points(points: DataFrame) -> DataFrame:
    """Positive z; infinity passes."""
    return points.where(F.col("z") > 0)


def z_buffer(points: DataFrame, k: Intrinsics, width: int, height: int) -> DataFrame:
    """(cloud_id, v, u, depth): the nearest z of each pixel; coordinates are cut toward zero."""
    u, v = (F.col("x") * k.fx / F.col("z") + k.cx).cast("int"), (F.col("y") * k.fy / F.col("z") + k.cy).cast("int")
    hit = points.where("z > 0").select("cloud_id", u.alias("u"), v.alias("v"), "z")
    return hit.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height)).groupBy("cloud_id", "v", "u").agg(F.min("z").alias("depth"))


def checked_box(df: DataFrame) -> DataFrame:
    """Fails on a box with a negative corner or without area."""
    bad = (F.col("x_min") < 0) | (F.col("y_min") < 0) | (F.col("x_max") <= F.col("x_min")) | (F.col("y_max") <= F.col("y_min"))
    return df.withColumn("x_min", F.when(bad, F.raise_error(F.lit("a box needs corners of at least 0 and some area"))).otherwise(F.col("x_min")))


def inside(df: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Boxes cut to their image; fails on one that lies outside."""
    df = clamped(df, width, height)
    return df.withColumn("x_min", F.when(~F.col("inside"), F.raise_error(F.lit("a box lies outside its image"))).otherwise(F.col("x_min"))).drop("inside")


def clamped(df: DataFrame, width: int | Column, height: int | Column) -> DataFrame:
    """Boxes cut to the image, with `inside` false where nothing remains."""
    width, height = (F.lit(n) if isinstance(n, int) else n for n in (width, height))
    df = df.withColumns({
        "x_min": F.least(F.greatest("x_min", F.lit(0)), width), "y_min": F.least(F.greatest("y_min", F.lit(0)), height),
        "x_max": F.least(F.greatest("x_max", F.lit(0)), width), "y_max": F.least(F.greatest("y_max", F.lit(0)), height),
    })
    return df.withColumn("inside", (F.col("x_max") > F.col("x_min")) & (F.col("y_max") > F.col("y_min")))


def frustum_box(x_min: Column, y_min: Column, x_max: Column, y_max: Column, z_min: Column, z_max: Column, k: Intrinsics) -> dict[str, Column]:
    """The axis-aligned extents of a box's corners at both depths."""
    out = {}
    for axis, a, b, c, f in (("x", x_min, x_max, k.cx, k.fx), ("y", y_min, y_max, k.cy, k.fy)):
        corners = [(e - c) * z / f for e in (a, b) for z in (z_min, z_max)]
        out |= {f"{axis}_lo": F.least(*corners), f"{axis}_hi": F.greatest(*corners)}
    return out | {"z_lo": F.least(z_min, z_max), "z_hi": F.greatest(z_min, z_max)}


#: Boxes that one copy of their frame serves.
BOXES_A_FRAME = 128


def per_box(frames: DataFrame, boxes: DataFrame, kernel: Callable, names: str, slow: bool = False) -> DataFrame:
    """kernel(depth, box) over the boxes (frame_id, box_id, x_min ...) of dense frames (frame_id, h, w, depth): (box_id, frame_id, names).

    A frame travels once for each BOXES_A_FRAME of its boxes, however many it has. Boxes for
    which the kernel gives None have no row, nor have those without a frame. With slow, the
    rows are spread over all tasks first.
    """
    n = boxes.groupBy("frame_id").agg(F.ceil(F.count("*") / BOXES_A_FRAME).cast("long").alias("chunks"))
    corner = ["box_id", "x_min", "y_min", "x_max", "y_max"]
    lists = boxes.join(n, "frame_id").groupBy("frame_id", F.pmod(F.xxhash64("box_id"), F.col("chunks")).alias("chunk")).agg(F.collect_list(F.struct(*corner)).alias("boxes"))
    both = frames.select("frame_id", "h", "w", "depth").join(lists, "frame_id").select("frame_id", "h", "w", "depth", *(F.col(f"boxes.{c}").alias(c) for c in corner))
    schema = StructType.fromDDL(f"box_id long, frame_id long, {names}")
    kind = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            out = []
            for i in range(b.num_rows):
                depth = b.column("depth")[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(b.column("h")[i].as_py(), b.column("w")[i].as_py())
                frame = b.column("frame_id")[i].as_py()
                for box_id, *box in zip(*(b.column(c)[i].as_py() for c in corner), strict=True):
                    if (got := kernel(depth, tuple(box))) is not None:
                        out.append((box_id, frame, *got))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(kind)], schema=kind)

    return (spread(both, "frame_id", "box_id") if slow else both).mapInArrow(run, schema)


def cut(depth: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The pixels of a box, cut to the image; maybe none."""
    h, w = depth.shape
    x0, y0, x1, y1 = box
    return depth[min(max(y0, 0), h) : min(max(y1, 0), h), min(max(x0, 0), w) : min(max(x1, 0), w)]


def usable(depth: np.ndarray) -> np.ndarray:
    return depth[np.isfinite(depth) & (depth > 0)]


def around(depth: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """Valid depths of the ring around a box, half its longer side wide, as far as the image goes."""
    h, w = depth.shape
    x0, y0, x1, y1 = box
    pad = max(y1 - y0, x1 - x0) // 2
    ring = np.zeros(depth.shape, bool)
    clip = lambda a, n: min(max(a, 0), n)
    ring[clip(y0 - pad, h) : clip(y1 + pad, h), clip(x0 - pad, w) : clip(x1 + pad, w)] = True
    ring[clip(y0, h) : clip(y1, h), clip(x0, w) : clip(x1, w)] = False
    return usable(depth[ring])


def middle(x: np.ndarray) -> float | None:
    return float(np.median(x)) if len(x) else None


def stable_z(depth: np.ndarray, box: tuple[int, int, int, int], cfg: FilterConfig = DEFAULT) -> float | None:
    """The median depth of a box without its outliers; of the ring around where too few pixels are valid; None if that has none."""
    part = cut(depth, box)
    ok = np.isfinite(part) & (part > 0)
    if not part.size:
        return None
    if not ok.any() or ok.mean() < cfg.tau:
        return middle(around(depth, box))
    if min(part.shape) < 9:
        return middle(part[ok])
    inner = part[ok & ~mask_kernel(part, cfg)[0]]
    return middle(inner if len(inner) else part[ok])


def crop_stats(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box_id, frame_id, n_pixels, inlier_ratio, z_est) of each box that holds pixels."""

    def one(depth, box):
        part = cut(depth, box)
        return (part.size, len(usable(part)) / part.size, middle(usable(part))) if part.size else None

    return per_box(frames, boxes, one, "n_pixels long, inlier_ratio double, z_est double")


def ring_medians(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box_id, frame_id, z): the median of the ring around each box, null where it holds no valid pixel."""
    return per_box(frames, boxes, lambda depth, box: (middle(around(depth, box)),), "z double")


def stable_depths(frames: DataFrame, boxes: DataFrame, cfg: FilterConfig = DEFAULT) -> DataFrame:
    """(box_id, frame_id, z) by stable_z, null where neither box nor ring says anything."""
    return per_box(frames, boxes, lambda depth, box: (stable_z(depth, box, cfg),), "z double", slow=True)


def naive_lift(frames: DataFrame, boxes: DataFrame, k: Intrinsics) -> DataFrame:
    """boxes with the median, smallest and largest positive depth of each crop, and the extents they span; null without one."""

    def one(depth, box):
        z = usable(cut(depth, box))
        return (middle(z), float(z.min()), float(z.max())) if len(z) else None

    hit = per_box(frames, boxes, one, "z_est double, z_min double, z_max double").drop("frame_id")
    c = [F.col(n).cast("double") for n in ("x_min", "y_min", "x_max", "y_max", "z_min", "z_max")]
    return boxes.join(hit, "box_id", "left").withColumns(frustum_box(*c, k))


LIFT = "z_est double, z_min double, z_max double, inlier_ratio double, vertices array<array<double>>"


def lift_box(depth: np.ndarray, k: Intrinsics, box: tuple[int, int, int, int], cfg: FilterConfig = DEFAULT, percentiles: tuple[float, float] = (5, 95), least: int = 8) -> tuple | None:
    """(z_est, z_min, z_max, inlier_ratio, vertices): robust depth of the raw crop, extents of the restored one; None if the crop is too small or either has no depth."""
    if not 0 <= percentiles[0] < percentiles[1] <= 100:
        raise ValueError("percentiles must rise within 0 to 100")
    if depth.ndim != 2:
        raise ValueError(f"a depth map has two dimensions, not {depth.ndim}")
    h, w = depth.shape
    box = x0, y0, x1, y1 = max(box[0], 0), max(box[1], 0), min(box[2], w), min(box[3], h)
    if x1 <= x0 or y1 <= y0:
        raise ValueError("the box lies outside the image")
    if min(x1 - x0, y1 - y0) < least:
        return None
    part = depth[y0:y1, x0:x1].astype(float)
    z = stable_z(depth, box, cfg)
    done = usable(restore_kernel(part, cfg))
    if z is None or not len(done):
        return None
    lo, hi = (float(v) for v in np.percentile(done, percentiles))
    corners = [[(x - k.cx) * d / k.fx, (y - k.cy) * d / k.fy, d] for x in (x0, x1) for y in (y0, y1) for d in (lo, hi)]
    a, b = np.min(corners, 0), np.max(corners, 0)
    return z, lo, hi, len(usable(part)) / part.size, [[float((a, b)[i][0]), float((a, b)[j][1]), float((a, b)[m][2])] for m in (0, 1) for j in (0, 1) for i in (0, 1)]


def lift(frames: DataFrame, boxes: DataFrame, k: Intrinsics, cfg: FilterConfig = DEFAULT, percentiles: tuple[float, float] = (5, 95)) -> DataFrame:
    """Robust lifts of boxes on dense frames; boxes that can't be lifted have no row, and one outside the image is an error."""
    return per_box(frames, boxes, lambda depth, box: lift_box(depth, k, box, cfg, percentiles), LIFT, slow=True)


def iou_2d(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Of (x_min, y_min, x_max, y_max); 0 without a union."""
    side = lambda i: F.greatest(F.lit(0), F.least(a[i + 2], b[i + 2]) - F.greatest(a[i], b[i]))
    inter = side(0) * side(1)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter
    return F.when(union > 0, inter.cast("double") / union).otherwise(0.0)


def iou_3d(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Of axis-aligned boxes given as x_lo, x_hi and so on; negative extents count as 0."""
    inter = vol_a = vol_b = F.lit(1.0)
    for n in "xyz":
        inter *= F.greatest(F.lit(0.0), F.least(a[f"{n}_hi"], b[f"{n}_hi"]) - F.greatest(a[f"{n}_lo"], b[f"{n}_lo"]))
        vol_a *= F.greatest(F.lit(0.0), a[f"{n}_hi"] - a[f"{n}_lo"])
        vol_b *= F.greatest(F.lit(0.0), b[f"{n}_hi"] - b[f"{n}_lo"])
    union = vol_a + vol_b - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def instance_boxes(px: DataFrame) -> DataFrame:
    """The box of each instance's pixels (frame_id, instance, v, u); a frame without one gets (0, 0, 8, 8)."""
    seen = px.where("instance > 0").groupBy("frame_id", "instance").agg(F.min("u").alias("x_min"), F.min("v").alias("y_min"), (F.max("u") + 1).alias("x_max"), (F.max("v") + 1).alias("y_max"))
    frames = px.select("frame_id").distinct().join(seen, "frame_id", "left")
    return frames.select("frame_id", "instance", *(F.coalesce(c, F.lit(d)).alias(c) for c, d in (("x_min", 0), ("y_min", 0), ("x_max", 8), ("y_max", 8))))


def z_error_cm(est: Column, true: Column) -> Column:
    return F.when(est.isNull() | true.isNull(), NAN).otherwise(F.abs(est - true) * 100)
