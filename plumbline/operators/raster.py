"""Depth filtering on pixels (frame_id, v, u, depth) and on dense frames.

The dense form shuffles pixels once, to their frame, and runs numpy kernels a frame at a
time; production uses it. The long form uses windows partitioned by frame and line, and kernels
over tiles with a halo, so a frame that fits no task is spread over many; the two are
tested against each other.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import Written
from ..functions.columns import NAN, valid_depth


@dataclass(frozen=True)
class FilterConfig:
    """Fixed default values of the depth filter."""

    tau: float = 0.10
    k: float = 3.0
    sigma_floor: float = 0.002
    extreme: float = 0.5
    bins: int = 20
    density_min: float = 0.30
    density_kernel: int = 11
    diameter: int = 9
    sigma_color: float = 0.04
    sigma_space: float = 4.5
    morph_kernel: int = 5
    inpaint_radius: int = 5
    inpaint: str = "rings"


DEFAULT = FilterConfig()


def box_sum(px: DataFrame, k: int, **sums: Column) -> DataFrame:
    """k x k sums around each pixel, zeros outside: one window along u, then one along v."""
    r = k // 2
    along_u = W.partitionBy("frame_id", "v").orderBy("u").rangeBetween(-r, r)
    along_v = W.partitionBy("frame_id", "u").orderBy("v").rangeBetween(-r, r)
    px = px.withColumns({f"__{n}": F.sum(c).over(along_u) for n, c in sums.items()})
    return px.withColumns({n: F.sum(f"__{n}").over(along_v) for n in sums}).drop(*(f"__{n}" for n in sums))


def void_filled(px: DataFrame, k: int = DEFAULT.diameter) -> DataFrame:
    """`filled`: voids get the mean of the valid pixels around them, 0 if there are none."""
    ok = valid_depth(F.col("depth"))
    px = box_sum(px, k, s=F.when(ok, F.col("depth")).otherwise(0.0), n=ok.cast("int"))
    return px.withColumn("filled", F.when(ok, F.col("depth")).when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0)).drop("s", "n")


def local_density(px: DataFrame, k: int = DEFAULT.density_kernel) -> DataFrame:
    """`density`: valid pixels around each, divided by k * k also at borders."""
    px = box_sum(px, k, n=valid_depth(F.col("depth")).cast("int"))
    return px.withColumn("density", F.col("n") / float(k * k)).drop("n")


def median_3x3(px: DataFrame, value: str, name: str) -> DataFrame:
    """The median of the 3 x 3 pixels around each; beyond a border its own sample repeats."""
    along_u, along_v = W.partitionBy("frame_id", "v").orderBy("u"), W.partitionBy("frame_id", "u").orderBy("v")
    c = F.col(value)
    px = px.withColumn("__row", F.array(F.coalesce(F.lag(c).over(along_u), c), c, F.coalesce(F.lead(c).over(along_u), c)))
    row = F.col("__row")
    px = px.withColumn("__nine", F.concat(F.coalesce(F.lag(row).over(along_v), row), row, F.coalesce(F.lead(row).over(along_v), row)))
    return px.withColumn(name, F.get(F.array_sort("__nine"), F.lit(4))).drop("__row", "__nine")


def extremes(px: DataFrame, limit: float = DEFAULT.extreme) -> DataFrame:
    """`is_extreme` for valid pixels further than `limit` from the local median, and `defused`, with them replaced by it."""
    px = median_3x3(void_filled(px), "filled", "median")
    px = px.withColumn("is_extreme", valid_depth(F.col("depth")) & (F.abs(F.col("filled") - F.col("median")) > limit))
    return px.withColumn("defused", F.when(F.col("is_extreme"), F.col("median")).otherwise(F.col("filled"))).drop("median")


def local_mean(px: DataFrame, value: str = "defused", k: int = DEFAULT.diameter) -> DataFrame:
    """`smooth`: the mean around each pixel; the SQL-checkable stand-in for the bilateral kernel."""
    px = box_sum(px, k, s=F.col(value), n=F.lit(1))
    return px.withColumn("smooth", F.col("s") / F.col("n")).drop("s", "n")


def bilateral_kernel(image: np.ndarray, cfg: FilterConfig = DEFAULT) -> np.ndarray:
    """Edge-preserving mean over a disc, borders mirrored without the edge sample."""
    r = cfg.diameter // 2
    h, w = image.shape
    mode = "reflect" if min(h, w) > r else "symmetric"
    p = np.pad(image.astype(float), r, mode=mode) if min(h, w) else image.astype(float)
    out = np.empty((h, w))
    # two pixels weigh the same to each other, so half of the disc is enough; lines go in blocks that stay in a core's cache
    half = [(dv, du) for dv in range(r + 1) for du in range(-r, r + 1) if (dv > 0 or du > 0) and dv * dv + du * du <= r * r]
    for at in range(0, h, BLOCK):
        n = min(BLOCK, h - at)
        block = p[at : at + n + 2 * r]
        own = block[r : r + n, r : r + w]
        top, bottom, part = own.copy(), np.ones((n, w)), np.empty((n, w))
        for dv, du in half:
            right, left = max(du, 0), max(-du, 0)
            lines, cols = slice(r - dv, r + n), slice(r - right, r + w + left)
            g = block[lines.start + dv : lines.stop + dv, cols.start + du : cols.stop + du] - block[lines, cols]
            g *= g
            g *= -0.5 / cfg.sigma_color**2
            g -= (dv * dv + du * du) / (2 * cfg.sigma_space**2)
            np.exp(g, out=g)
            for weight, v, u in ((g[dv : dv + n, right : right + w], dv, du), (g[:n, left : left + w], -dv, -du)):
                bottom += weight
                np.multiply(weight, block[r + v : r + v + n, r + u : r + u + w], out=part)
                top += part
        np.divide(top, bottom, out=out[at : at + n])
    return out


#: Lines of a frame that bilateral_kernel takes at a time.
BLOCK = 16
#: Lines and columns of a tile; frames of any size are cut into such tiles.
TILE = 512


def per_tile(px: DataFrame, value: str, name: str, kernel: Callable[[np.ndarray], np.ndarray], halo: int, tile: int = TILE) -> DataFrame:
    """A numpy kernel over each frame of the long form, tile by tile, so that no task needs a whole frame.

    A pixel goes to its tile and to those whose halo it is in; a tile's kernel sees its halo, and only
    the tile's own pixels come back. Inside a frame the result is that of the whole frame if
    the kernel looks no further than the halo; at a frame's borders tiles end where the frame does, so the kernel's
    own rule for borders holds.
    """
    if not 0 <= halo <= tile:
        raise ValueError("a halo is at most as wide as a tile")
    schema = f"{px.drop(name).schema.simpleString()[7:-1]},{name}:double"
    own = {c: F.floor(F.col(c) / tile).cast("int") for c in "vu"}
    rows = px
    for c in "vu":
        around = F.array_distinct(F.array(*(F.floor((F.col(c) + d) / tile).cast("int") for d in (-halo, 0, halo))))
        rows = rows.withColumn(f"__t{c}", F.explode(F.filter(around, lambda x: x >= 0)))
    rows = rows.withColumn("__own", (F.col("__tv") == own["v"]) & (F.col("__tu") == own["u"]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v0, u0 = (max(0, int(pdf[f"__t{c}"].iloc[0]) * tile - halo) for c in "vu")
        v, u = pdf.v.to_numpy() - v0, pdf.u.to_numpy() - u0
        image = np.full((v.max() + 1, u.max() + 1), 0.0)
        image[v, u] = pdf[value]
        mine = pdf["__own"].to_numpy()
        out = pdf[mine].drop(columns=["__tv", "__tu", "__own"])
        return out.drop(columns=name, errors="ignore").assign(**{name: kernel(image)[v[mine], u[mine]] if mine.any() else np.zeros(0)})

    return rows.groupBy("frame_id", "__tv", "__tu").applyInPandas(run, schema)


def bilateral_smooth(px: DataFrame, value: str = "defused", cfg: FilterConfig = DEFAULT, tile: int = TILE) -> DataFrame:
    return per_tile(px, value, "smooth", lambda image: bilateral_kernel(image, cfg), cfg.diameter // 2, tile)


def closed_pixels(px: DataFrame, value: str = "depth", name: str = "closed", cfg: FilterConfig = DEFAULT, tile: int = TILE) -> DataFrame:
    """close_kernel over pixels: closing looks twice its radius far, and its fill the kernel's size."""
    k = cfg.morph_kernel
    return per_tile(px, value, name, lambda image: close_kernel(image, k), max(k, 0), tile)


def inpainted_pixels(px: DataFrame, value: str = "depth", name: str = "inpainted", cfg: FilterConfig = DEFAULT, tile: int = TILE) -> DataFrame:
    """inpaint_kernel over pixels, a ring of all voids at a time: the rounds are as many as the widest void is deep, and each is written."""
    out, r = Written(px.sparkSession, "inpainted"), cfg.inpaint_radius
    rows = px.withColumn(name, F.when(valid_depth(F.col(value)) & (F.abs(value) < float("inf")), F.col(value).cast("double")).otherwise(0.0))
    left, last = None, None
    while True:
        rows, path = out.put(rows)
        if last:
            out.drop(last)
        last, before = path, left
        left = rows.where(F.col(name) == 0).count()
        if not left or left == before:  # frames without a valid pixel stay void
            return rows
        rows = per_tile(rows, name, name, lambda image: ring_kernel(image, r), r, tile)


def restored_pixels(px: DataFrame, cfg: FilterConfig = DEFAULT, tile: int = TILE) -> DataFrame:
    """restore_kernel over pixels of frames of any size: (frame_id, v, u, depth, restored). Voids are filled by rings."""
    if cfg.inpaint != "rings":
        raise ValueError("only rings fill voids over tiles")
    marked = outlier_mask(px.select("frame_id", "v", "u", F.col("depth").cast("double").alias("depth")), lambda p: bilateral_smooth(p, cfg=cfg, tile=tile), cfg)
    kept = marked.select("frame_id", "v", "u", "depth", F.when(F.col("outlier"), 0.0).otherwise(F.col("depth")).alias("kept"))
    full = inpainted_pixels(closed_pixels(kept, "kept", "closed", cfg, tile), "closed", "full", cfg, tile)
    return bilateral_smooth(full, "full", cfg, tile).select("frame_id", "v", "u", "depth", F.col("smooth").alias("restored"))


def sigma_map(px: DataFrame, cfg: FilterConfig = DEFAULT) -> DataFrame:
    """`sigma` and `threshold` by depth bin, from `residual` and `density`.

    Samples are valid with enough density; bin i holds [b_i, b_i+1), so the largest depth
    is in none; a bin of under 5 samples is interpolated over bin index, flat at the ends;
    reading takes (b_i, b_i+1], clipped to the first and last bin.
    """
    n = cfg.bins
    good = valid_depth(F.col("depth")) & (F.col("density") >= cfg.density_min)
    ends = px.groupBy("frame_id").agg(F.min(F.when(good, F.col("depth"))).alias("lo"), F.max(F.when(good, F.col("depth"))).alias("hi"))
    ends = ends.select("frame_id", F.coalesce("lo", F.lit(0.0)).alias("lo"), F.coalesce("hi", F.lit(1.0)).alias("hi"))
    ends = ends.withColumn("hi", F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1.0).otherwise(F.col("hi")))
    edge = lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / float(n)
    guess = F.floor((F.col("depth") - F.col("lo")) / (F.col("hi") - F.col("lo")) * n).cast("int")
    # the guess may be off by rounding at an edge; the edges themselves decide
    low = F.when(F.col("depth") < edge(guess), guess - 1).when(F.col("depth") >= edge(guess + 1), guess + 1).otherwise(guess)
    read = F.when(F.col("depth") <= edge(guess), guess - 1).when(F.col("depth") > edge(guess + 1), guess + 1).otherwise(guess)
    px = px.join(ends, "frame_id")
    px = px.withColumn("bin", F.when(F.isnan("depth"), n - 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(n - 1), read))))
    seen = px.where(good).withColumn("bin", low).where((F.col("bin") >= 0) & (F.col("bin") < n))
    found = seen.groupBy("frame_id", "bin").agg(F.when(F.count("*") >= 5, F.median("residual") / 0.6745).alias("s"))
    grid = ends.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("bin")).join(found, ["frame_id", "bin"], "left")
    back = W.partitionBy("frame_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy("frame_id").orderBy("bin").rowsBetween(0, W.unboundedFollowing)
    spot = F.when(F.col("s").isNotNull(), F.col("bin"))
    grid = grid.select("frame_id", "bin", F.last("s", True).over(back).alias("s0"), F.last(spot, True).over(back).alias("b0"), F.first("s", True).over(ahead).alias("s1"), F.first(spot, True).over(ahead).alias("b1"))
    between = F.when(F.col("b0") == F.col("b1"), F.col("s0")).otherwise(F.col("s0") + (F.col("s1") - F.col("s0")) * (F.col("bin") - F.col("b0")) / (F.col("b1") - F.col("b0")))
    sigma = F.greatest(F.coalesce(between, F.col("s0"), F.col("s1"), F.lit(cfg.sigma_floor)), F.lit(cfg.sigma_floor))
    grid = grid.select("frame_id", "bin", sigma.alias("sigma"))
    return px.join(grid, ["frame_id", "bin"]).withColumn("threshold", F.col("sigma") * cfg.k).drop("lo", "hi", "bin")


def outlier_mask(px: DataFrame, smooth=bilateral_smooth, cfg: FilterConfig = DEFAULT) -> DataFrame:
    """`outlier`, `sigma`, `threshold` of each pixel; a frame without a valid pixel has none, and zero maps."""
    px = smooth(local_density(extremes(px, cfg.extreme), cfg.density_kernel))
    px = sigma_map(px.withColumn("residual", F.abs(F.col("depth") - F.col("smooth"))), cfg)
    ok = valid_depth(F.col("depth"))
    px = px.withColumn("outlier", F.col("is_extreme") | (ok & ~F.col("is_extreme") & (F.col("residual") > F.col("threshold"))))
    any_valid = F.max(ok).over(W.partitionBy("frame_id"))
    return px.withColumns({c: F.when(any_valid, F.col(c)).otherwise(0.0) for c in ("sigma", "threshold")})


def iqr_filter(px: DataFrame, multiple: float = 3.0) -> DataFrame:
    """`clean`: valid pixels outside the quartiles by more than `multiple` ranges become 0."""
    ok = valid_depth(F.col("depth"))
    q = px.where(ok).groupBy("frame_id").agg(F.percentile("depth", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    lo, hi = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    px = px.join(q, "frame_id", "left")
    bad = ok & ((F.col("depth") < lo - multiple * (hi - lo)) | (F.col("depth") > hi + multiple * (hi - lo)))
    return px.withColumn("clean", F.when(bad, 0.0).otherwise(F.col("depth"))).drop("q")


def robust_z(px: DataFrame, cfg: FilterConfig = DEFAULT, minimum_side: int = 9) -> DataFrame:
    """(frame_id, z) from pixels with `outlier`; null without valid pixels or where their share is under tau."""
    ok = valid_depth(F.col("depth"))
    a = px.groupBy("frame_id").agg(
        F.avg(ok.cast("double")).alias("share"), F.median(F.when(ok, F.col("depth"))).alias("raw"),
        F.median(F.when(ok & ~F.col("outlier"), F.col("depth"))).alias("inner"),
        F.least(F.max("v") - F.min("v") + 1, F.max("u") - F.min("u") + 1).alias("side"),
    )
    return a.select("frame_id", F.when((F.col("share") > 0) & (F.col("share") >= cfg.tau), F.when(F.col("side") >= minimum_side, F.coalesce("inner", "raw")).otherwise(F.col("raw"))).alias("z"))


def inject_rect(px: DataFrame, u0: int, v0: int, u1: int, v1: int) -> DataFrame:
    """The rectangle's pixels become 0; bounds are clamped to the image, and an inverted one changes nothing."""
    return px.withColumn("depth", F.when((F.col("u") >= max(u0, 0)) & (F.col("u") < u1) & (F.col("v") >= max(v0, 0)) & (F.col("v") < v1), 0.0).otherwise(F.col("depth")))


def frame_summary(px: DataFrame) -> DataFrame:
    """Counts and shares of voids and outliers, retention, and the median sigma over valid pixels, of each frame."""
    ok = valid_depth(F.col("depth"))
    n = F.count_if(ok)
    return px.groupBy("frame_id").agg(
        n.alias("n_valid"), (100.0 * F.avg((~ok).cast("double"))).alias("void_pct"), F.count_if("outlier").alias("n_outliers"),
        F.when(n > 0, 100.0 * F.count_if("outlier") / n).otherwise(0.0).alias("outlier_pct"),
        F.when(n > 0, 100.0 * F.count_if(ok & ~F.col("outlier")) / n).otherwise(0.0).alias("retention_pct"),
        F.coalesce(F.median(F.when(ok, F.col("sigma"))), F.lit(NAN)).alias("median_sigma"),
    )


def gradient(px: DataFrame) -> DataFrame:
    """`gv`, `gu`: central differences, one-sided at borders."""
    def along(line: list[str], at: str) -> Column:
        w, d = W.partitionBy("frame_id", *line).orderBy(at), F.col("depth")
        before, after = F.lag(d).over(w), F.lead(d).over(w)
        return F.when(before.isNull(), after - d).when(after.isNull(), d - before).otherwise((after - before) / 2)

    return px.withColumns({"gu": along(["v"], "u"), "gv": along(["u"], "v")})


def ellipse(k: int) -> np.ndarray:
    r = k // 2
    v = np.arange(-r, r + 1)
    half = np.round(r * np.sqrt(np.maximum(0, 1 - (v / max(r, 1)) ** 2))).astype(int)
    return np.abs(v)[None, :] <= half[:, None]


def close_kernel(depth: np.ndarray, k: int = DEFAULT.morph_kernel) -> np.ndarray:
    """Closes small holes of the validity mask and fills them by the mean of the valid pixels around; k <= 0 changes nothing."""
    if k <= 0 or not depth.size:
        return depth
    ok, disc, r = np.isfinite(depth) & (depth > 0), ellipse(k), k // 2

    def moved(mask: np.ndarray, grow: bool) -> np.ndarray:
        p = np.pad(mask, r, constant_values=not grow)
        parts = [p[i : i + mask.shape[0], j : j + mask.shape[1]] for i, j in zip(*np.nonzero(disc), strict=True)]
        return np.logical_or.reduce(parts) if grow else np.logical_and.reduce(parts)

    new = moved(moved(ok, True), False) & ~ok
    s, n = (boxed(x, 2 * k + 1) for x in (np.where(ok, depth, 0.0), ok.astype(float)))
    return np.where(new & (n > 0), s / np.maximum(n, 1), depth)


def boxed(x: np.ndarray, k: int) -> np.ndarray:
    r = k // 2
    c = np.cumsum(np.cumsum(np.pad(x, ((r + 1, r), (r + 1, r))), 0), 1)
    return c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]


def inpaint_kernel(depth: np.ndarray, radius: int = DEFAULT.inpaint_radius) -> np.ndarray:
    """Fills all voids from their surroundings by normalised convolution from the rim inwards; valid pixels stay as they are."""
    out = np.where(np.isfinite(depth) & (depth > 0), depth, 0.0).astype(float)
    ok = out > 0
    if ok.all() or not ok.any():
        return out
    while not ok.all():
        out = ring_kernel(out, radius)
        ok = out > 0
    return out


def arrival_kernel(void: np.ndarray) -> np.ndarray:
    """When a front of unit speed that starts at the rim reaches each void pixel, by fast marching; 0 outside voids."""
    h, w = void.shape
    late = np.full((h + 2, w + 2), np.inf)
    late[1:-1, 1:-1][~void] = 0.0
    t, width = late.ravel().tolist(), w + 2  # a border that is never reached, and pixels by one number
    inner = np.zeros((h + 2, w + 2), bool)
    inner[1:-1, 1:-1] = void
    open_, around = inner.ravel().tolist(), (-width, width, -1, 1)
    rim = np.zeros_like(inner)
    rim[1:-1, 1:-1] = late[1:-1, 1:-1] == 0
    near = rim.copy()
    near[1:] |= rim[:-1]
    near[:-1] |= rim[1:]
    near[:, 1:] |= rim[:, :-1]
    near[:, :-1] |= rim[:, 1:]

    def reached(i: int) -> float:
        a, b = min(t[i - width], t[i + width]), min(t[i - 1], t[i + 1])
        a, b = (a, b) if a <= b else (b, a)
        return a + 1.0 if b - a >= 1.0 else (a + b + (2.0 - (a - b) ** 2) ** 0.5) / 2.0

    front = [(reached(i), i) for i in np.flatnonzero(near.ravel() & inner.ravel()).tolist()]
    for at, i in front:
        t[i] = min(t[i], at)
    front = [(t[i], i) for _, i in front]
    heapq.heapify(front)
    while front:
        at, i = heapq.heappop(front)
        if not open_[i] or at > t[i]:
            continue
        open_[i] = False
        for j in (i + d for d in around):
            if open_[j] and (new := reached(j)) < t[j]:
                t[j] = new
                heapq.heappush(front, (new, j))
    return np.array(t).reshape(h + 2, w + 2)[1:-1, 1:-1]


def march_kernel(depth: np.ndarray, radius: int = DEFAULT.inpaint_radius) -> np.ndarray:
    """Fills all voids by a front that marches inwards from their rim; valid pixels stay as they are.

    A pixel gets the mean of the filled ones within the radius. One weighs more the nearer it
    lies, the closer its arrival is to the pixel's own, and the more it lies along the direction in which the
    front moves. Pixels that the front reaches within the same unit of time are filled together.
    """
    out = np.where(np.isfinite(depth) & (depth > 0), depth, 0.0).astype(float)
    void = out == 0
    if not void.any() or void.all():
        return out
    r = max(radius, 1)
    late = arrival_kernel(void)
    gv, gu = (np.gradient(late, axis=k) if late.shape[k] > 1 else np.zeros(late.shape) for k in (0, 1))
    size = np.maximum(np.hypot(gv, gu), 1e-12)
    gv, gu = gv / size, gu / size
    full, time, have = np.pad(out, r), np.pad(late, r), np.pad(~void, r)
    steps = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if 0 < a * a + b * b <= r * r]
    v, u = np.nonzero(void)
    band = np.ceil(late[v, u])
    now = 0.0
    while len(v):
        now = max(now + 1.0, band.min())
        mine = np.flatnonzero(band <= now)
        a, b, top, bottom = v[mine], u[mine], 0.0, 0.0
        for dv, du in steps:
            at = (a + r + dv, b + r + du)
            along = np.abs(dv * gv[a, b] + du * gu[a, b]) / np.hypot(dv, du)
            weight = have[at] * np.maximum(along, 1e-6) / (dv * dv + du * du) / (1.0 + np.abs(time[at] - late[a, b]))
            top, bottom = top + weight * full[at], bottom + weight
        done = bottom > 0
        full[a[done] + r, b[done] + r], have[a[done] + r, b[done] + r] = top[done] / bottom[done], True
        left = np.ones(len(v), bool)
        left[mine[done]] = False
        v, u, band = v[left], u[left], band[left]
    return full[r:-r, r:-r]


#: Ways to fill voids: rings also work over tiles, for frames that fit no task.
INPAINT = {"rings": inpaint_kernel, "march": march_kernel}


def ring_kernel(depth: np.ndarray, radius: int) -> np.ndarray:
    """The voids that valid pixels (above 0) are near to, filled by the mean of these."""
    ok = depth > 0
    s, n = boxed(np.where(ok, depth, 0.0), 2 * radius + 1), boxed(ok.astype(float), 2 * radius + 1)
    return np.where(~ok & (n > 0.5), s / np.maximum(n, 1), depth)


def mean_kernel(image: np.ndarray, cfg: FilterConfig = DEFAULT) -> np.ndarray:
    """The mean around each pixel, as local_mean gives it."""
    return boxed(image, cfg.diameter) / boxed(np.ones(image.shape), cfg.diameter)


def median_kernel(image: np.ndarray) -> np.ndarray:
    """The median of the 3 x 3 pixels around each one, edges repeated: of the sorted columns, the middle one of the largest low, the middle mid and the smallest high value."""
    p = np.pad(image, 1, mode="edge")
    three = lambda x, axis: [x[(slice(None),) * axis + (slice(i, x.shape[axis] - 2 + i),)] for i in range(3)]

    def mid(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))

    a, b, c = three(p, 0)
    low, high = np.minimum(np.minimum(a, b), c), np.maximum(np.maximum(a, b), c)
    return mid(np.maximum.reduce(three(low, 1)), mid(*three(mid(a, b, c), 1)), np.minimum.reduce(three(high, 1)))


def mask_kernel(depth: np.ndarray, cfg: FilterConfig = DEFAULT, smooth: Callable = bilateral_kernel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dense form of outlier_mask: (mask, sigma, threshold) of one frame."""
    d = depth.astype(float)
    if d.ndim != 2:
        raise ValueError(f"a depth map has two dimensions, not {d.ndim}")
    ok = np.isfinite(d) & (d > 0)
    if not ok.any():
        return ok, np.zeros(d.shape), np.zeros(d.shape)
    s, n = boxed(np.where(ok, d, 0.0), cfg.diameter), boxed(ok.astype(float), cfg.diameter)
    filled = np.where(ok, d, np.where(n > 0.5, s / np.maximum(n, 1), 0.0))
    middle = median_kernel(filled)
    extreme = ok & (np.abs(filled - middle) > cfg.extreme)
    residual = np.abs(np.where(ok, d, 0.0) - smooth(np.where(extreme, middle, filled), cfg))
    good = ok & (boxed(ok.astype(float), cfg.density_kernel) / cfg.density_kernel**2 >= cfg.density_min)
    lo, hi = (d[good].min(), d[good].max()) if good.any() else (0.0, 1.0)
    hi = hi if hi > lo else lo + 1.0
    edges = lo + (hi - lo) * np.arange(cfg.bins + 1) / cfg.bins
    z, r = d[good], residual[good]
    own = np.searchsorted(edges, z, "right") - 1
    order = np.argsort(own.astype(np.int16), kind="stable")  # of 16 bits, which are sorted by counting
    of_bin = np.split(r[order], np.searchsorted(own[order], np.arange(1, cfg.bins + 1)))[: cfg.bins]  # the largest depth is in none
    sig = np.array([np.median(x) / 0.6745 if len(x) >= 5 else np.nan for x in of_bin])
    have = np.flatnonzero(~np.isnan(sig))
    sig = np.interp(np.arange(cfg.bins), have, sig[have]) if len(have) else np.zeros(cfg.bins)
    sigma = np.maximum(sig, cfg.sigma_floor)[np.clip(np.searchsorted(edges[1:], np.where(np.isnan(d), np.inf, d)), 0, cfg.bins - 1)]
    return extreme | (ok & ~extreme & (residual > cfg.k * sigma)), sigma, cfg.k * sigma


def masked(px: DataFrame, cfg: FilterConfig = DEFAULT, smooth: Callable = bilateral_kernel) -> DataFrame:
    """outlier_mask of (frame_id, v, u, depth) by one shuffle and one pass of mask_kernel over each dense frame, which must fit a task."""
    cells = F.collect_list(F.struct("v", "u", F.col("depth").cast("double").alias("depth")))
    frames = px.groupBy("frame_id").agg(cells.alias("c")).select("frame_id", *(F.col(f"c.{n}").alias(n) for n in ("v", "u", "depth")))

    def one(v: np.ndarray, u: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
        image = np.full((v.max() + 1, u.max() + 1), np.nan)
        image[v, u] = d
        return [a[v, u] for a in mask_kernel(image, cfg, smooth)]

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                v, u, d = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("v", "u", "depth"))
                frame = pa.array([b.column(0)[i].as_py()] * len(v), pa.int64())
                yield pa.RecordBatch.from_arrays([frame, pa.array(v, pa.int32()), pa.array(u, pa.int32()), pa.array(d, pa.float64()), *map(pa.array, one(v, u, d.astype(float)))], names=["frame_id", "v", "u", "depth", "outlier", "sigma", "threshold"])

    return frames.withColumn("frame_id", F.col("frame_id").cast("long")).mapInArrow(run, "frame_id long, v int, u int, depth double, outlier boolean, sigma double, threshold double")


def restore_kernel(depth: np.ndarray, cfg: FilterConfig = DEFAULT) -> np.ndarray:
    """Outliers to voids, closing, inpainting, smoothing."""
    d = np.where(mask_kernel(depth, cfg)[0], 0.0, depth)
    return bilateral_kernel(INPAINT[cfg.inpaint](close_kernel(d, cfg.morph_kernel), cfg.inpaint_radius), cfg)


def to_pixels(frames: DataFrame) -> DataFrame:
    """(frame_id, v, u, depth) from dense frames (frame_id, h, w, depth array)."""
    px = frames.select("frame_id", "w", F.posexplode("depth").alias("i", "depth"))
    return px.select("frame_id", F.floor(F.col("i") / F.col("w")).cast("int").alias("v"), (F.col("i") % F.col("w")).alias("u"), F.col("depth").cast("double").alias("depth"))


def to_frames(px: DataFrame, kind: str = "float") -> DataFrame:
    """Dense frames from pixels; every pixel must be there once."""
    cells = F.sort_array(F.collect_list(F.struct("v", "u", "depth")))
    return px.groupBy("frame_id").agg((F.max("v") + 1).alias("h"), (F.max("u") + 1).alias("w"), F.transform(cells, lambda c: c["depth"].cast(kind)).alias("depth"))


def inpainted_frames(frames: DataFrame, cfg: FilterConfig = DEFAULT) -> DataFrame:
    """`inpainted` of dense frames (frame_id, h, w, depth array) by the way that cfg names; a frame without a valid pixel is all 0, and a null one stays null."""
    from pyspark.sql.types import ArrayType, DoubleType, StructType

    fill = INPAINT[cfg.inpaint]

    def run(it):
        for pdf in it:
            done = [None if d is None else fill(np.asarray(d, float).reshape(int(h), int(w)), cfg.inpaint_radius).ravel() for d, h, w in zip(pdf.depth, pdf.h, pdf.w, strict=True)]
            yield pdf.assign(inpainted=done)

    return frames.drop("inpainted").mapInPandas(run, StructType([*frames.drop("inpainted").schema.fields]).add("inpainted", ArrayType(DoubleType())))


def restore_frames(frames: DataFrame, cfg: FilterConfig = DEFAULT) -> DataFrame:
    """`restored` of dense frames, batch by batch."""
    from pyspark.sql.types import ArrayType, FloatType, StructType

    def run(it):
        for pdf in it:
            yield pdf.assign(restored=[restore_kernel(np.asarray(d, float).reshape(h, w), cfg).ravel().astype("float32") for d, h, w in zip(pdf.depth, pdf.h, pdf.w, strict=True)])

    return frames.mapInPandas(run, StructType([*frames.schema.fields]).add("restored", ArrayType(FloatType())))
