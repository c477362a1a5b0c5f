"""The registered queries over the driver's tables, each with the SQL that it must equal.

Carriers map the tables to the engine's records: events to depth pixels and series,
embeddings to points, lineitem to boxes and evaluation rows, orders to ledger and queue.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .functions import parsing
from .functions.columns import NAN, ratio, shown, valid_depth
from .operators import benchmark, corruption as C, geometry as G, metrics as M, raster as R, scene, shape as S
from .plans import canary, ledger as L, queue as Q, runner
from .sources import readers, sinks
from .streaming import guard

QUERIES, SQL = {}, {}
K = G.Intrinsics(80.0, 80.0, 50.0, 50.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(*names: str):
    return [F.round(F.col(n), 6).alias(n) for n in names]


#: Values on halves of the last place are rounded up by both engines, though sums in another order lie a hair's breadth below.
TIE = 1e-11


def s6(*names: str):
    return [F.round(F.col(n) + TIE, 6).alias(n) for n in names]


# carriers

def px(spark: SparkSession, sf: str) -> DataFrame:
    e, i = t(spark, sf, "events"), F.col("event_id")
    depth = 2.0 + F.floor((i % 10000) / 100) / 250.0 + (F.floor(F.col("value") * 100) % 3000) / 300000.0
    depth = depth + F.when((F.col("event_type") == "signup") & (i % 37 == 0), 0.15).otherwise(0.0) + F.when((F.col("event_type") == "purchase") & (i % 41 == 0), 0.6).otherwise(0.0)
    return e.select(F.floor(i / 10000).alias("frame_id"), F.floor((i % 10000) / 100).cast("int").alias("v"), (i % 100).cast("int").alias("u"), F.when(F.col("event_type") == "error", 0.0).otherwise(depth).alias("depth"))


PX = """px AS (
  SELECT event_id // 10000 AS frame_id, CAST((event_id % 10000) // 100 AS INTEGER) AS v, CAST(event_id % 100 AS INTEGER) AS u,
    CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE 2.0::DOUBLE + ((event_id % 10000) // 100) / 250.0::DOUBLE
      + (CAST(floor(value * 100) AS BIGINT) % 3000) / 300000.0::DOUBLE
      + CASE WHEN event_type = 'signup' AND event_id % 37 = 0 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN event_type = 'purchase' AND event_id % 41 = 0 THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END END AS depth
  FROM events)"""
FILLED = PX + """, box9 AS (
  SELECT a.frame_id, a.v, a.u, a.depth, sum(CASE WHEN b.depth > 0 THEN b.depth ELSE 0 END) AS s, count(*) FILTER (WHERE b.depth > 0) AS n
  FROM px a JOIN px b ON a.frame_id = b.frame_id AND b.v BETWEEN a.v - 4 AND a.v + 4 AND b.u BETWEEN a.u - 4 AND a.u + 4
  GROUP BY ALL), filled AS (
  SELECT frame_id, v, u, depth, CASE WHEN depth > 0 THEN depth WHEN n > 0 THEN s / n ELSE 0.0 END AS filled FROM box9)"""
DENSITY = """density AS (
  SELECT a.frame_id, a.v, a.u, count(*) FILTER (WHERE b.depth > 0) / 121.0::DOUBLE AS density
  FROM px a JOIN px b ON a.frame_id = b.frame_id AND b.v BETWEEN a.v - 5 AND a.v + 5 AND b.u BETWEEN a.u - 5 AND a.u + 5 GROUP BY ALL)"""
EXTREME = FILLED + """, ends AS (SELECT frame_id, max(v) AS mv, max(u) AS mu FROM px GROUP BY frame_id), med AS (
  SELECT a.frame_id, a.v, a.u, a.depth, a.filled, median(b.filled) AS med
  FROM filled a JOIN ends USING (frame_id), (VALUES (-1), (0), (1)) dv(i), (VALUES (-1), (0), (1)) du(j), filled b
  WHERE b.frame_id = a.frame_id AND b.v = greatest(0, least(mv, a.v + i)) AND b.u = greatest(0, least(mu, a.u + j)) GROUP BY ALL), ext AS (
  SELECT *, depth > 0 AND abs(filled - med) > 0.5 AS is_extreme, CASE WHEN depth > 0 AND abs(filled - med) > 0.5 THEN med ELSE filled END AS defused FROM med)"""
MEAN = """, smooth AS (
  SELECT a.frame_id, a.v, a.u, avg(b.defused) AS smooth FROM ext a JOIN ext b ON a.frame_id = b.frame_id AND b.v BETWEEN a.v - 4 AND a.v + 4 AND b.u BETWEEN a.u - 4 AND a.u + 4 GROUP BY ALL)"""


def bilateral(table: str, value: str) -> str:
    """A disc of radius 4, mirrored at borders: without the edge pixel, or with it in images that are smaller than the disc."""
    at = lambda p, m: f"CASE WHEN least(mv, mu) > 3 THEN CASE WHEN {p} < 0 THEN -{p} WHEN {p} > {m} THEN 2 * {m} - {p} ELSE {p} END ELSE CASE WHEN {p} < 0 THEN -{p} - 1 WHEN {p} > {m} THEN 2 * {m} + 1 - {p} ELSE {p} END END"
    return f""", edge AS (SELECT frame_id, max(v) AS mv, max(u) AS mu FROM px GROUP BY frame_id), shifts AS (
  SELECT CAST(i AS INTEGER) - 4 AS i, CAST(j AS INTEGER) - 4 AS j FROM range(9) x(i), range(9) y(j) WHERE (i - 4) * (i - 4) + (j - 4) * (j - 4) <= 16), spot AS (
  SELECT a.frame_id, a.v, a.u, a.{value} AS d, i, j, {at("(a.v + i)", "mv")} AS bv, {at("(a.u + j)", "mu")} AS bu FROM {table} a JOIN edge USING (frame_id), shifts), weighted AS (
  SELECT s.frame_id, s.v, s.u, b.{value} AS d, exp(-(i * i + j * j) / 40.5::DOUBLE - (b.{value} - s.d) * (b.{value} - s.d) / 0.0032::DOUBLE) AS g FROM spot s JOIN {table} b ON b.frame_id = s.frame_id AND b.v = s.bv AND b.u = s.bu), smooth AS (
  SELECT frame_id, v, u, sum(g * d) / sum(g) AS smooth FROM weighted GROUP BY frame_id, v, u)"""


OUTLIERS = """, res AS (
  SELECT e.*, d.density, abs(e.depth - s.smooth) AS residual FROM ext e JOIN density d USING (frame_id, v, u) JOIN smooth s USING (frame_id, v, u)), lohi AS (
  SELECT frame_id, coalesce(min(depth) FILTER (WHERE depth > 0 AND density >= 0.30), 0.0) AS lo, coalesce(max(depth) FILTER (WHERE depth > 0 AND density >= 0.30), 1.0) AS hi0 FROM res GROUP BY frame_id), lim AS (
  SELECT frame_id, lo, CASE WHEN hi0 <= lo THEN lo + 1 ELSE hi0 END AS hi FROM lohi), edges AS (
  SELECT frame_id, CAST(i AS INTEGER) AS bin, lo + (hi - lo) * i / 20.0::DOUBLE AS e0, lo + (hi - lo) * (i + 1) / 20.0::DOUBLE AS e1 FROM lim, range(20) r(i)), est AS (
  SELECT g.frame_id, g.bin, CASE WHEN count(residual) >= 5 THEN median(residual) / 0.6745 END AS s
  FROM edges g LEFT JOIN res r ON r.frame_id = g.frame_id AND r.depth > 0 AND r.density >= 0.30 AND r.depth >= g.e0 AND r.depth < g.e1 GROUP BY ALL), gap AS (
  SELECT frame_id, bin, last_value(s IGNORE NULLS) OVER b AS s0, last_value(CASE WHEN s IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS b0,
    first_value(s IGNORE NULLS) OVER f AS s1, first_value(CASE WHEN s IS NOT NULL THEN bin END IGNORE NULLS) OVER f AS b1 FROM est
  WINDOW b AS (PARTITION BY frame_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY frame_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), sig AS (
  SELECT frame_id, bin, greatest(coalesce(CASE WHEN b0 = b1 THEN s0 ELSE s0 + (s1 - s0) * (bin - b0) / (b1 - b0) END, s0, s1, 0.002), 0.002) AS sigma FROM gap), pick AS (
  SELECT r.*, least(19, (SELECT count(*) FROM edges g WHERE g.frame_id = r.frame_id AND g.e1 < r.depth)) AS bin FROM res r), mask AS (
  SELECT p.*, s.sigma, s.sigma * 3.0 AS threshold, p.is_extreme OR (p.depth > 0 AND NOT p.is_extreme AND p.residual > s.sigma * 3.0) AS outlier FROM pick p JOIN sig s ON s.frame_id = p.frame_id AND s.bin = p.bin)"""
MASK = EXTREME + ", " + DENSITY + MEAN + OUTLIERS


@query(f"WITH {PX} SELECT frame_id, v, u, round(filled + 1e-11, 6) AS filled FROM ({'WITH ' + FILLED + ' SELECT * FROM filled'})")
def p2_void_filled(spark, sf):
    return R.void_filled(px(spark, sf)).select("frame_id", "v", "u", *s6("filled"))


@query(f"WITH {PX}, {DENSITY} SELECT frame_id, v, u, round(density, 6) AS density FROM density")
def p3_local_density(spark, sf):
    return R.local_density(px(spark, sf)).select("frame_id", "v", "u", *r6("density"))


@query(f"WITH {EXTREME} SELECT frame_id, v, u, is_extreme, round(defused + 1e-11, 6) AS defused FROM ext")
def p5_extremes(spark, sf):
    return R.extremes(px(spark, sf)).select("frame_id", "v", "u", "is_extreme", *s6("defused"))


def masked(spark, sf):
    return R.masked(px(spark, sf), smooth=R.mean_kernel)


@query(f"WITH {MASK} SELECT frame_id, v, u, outlier, round(sigma, 6) AS sigma, round(threshold, 6) AS threshold, CASE WHEN outlier THEN 0.0 ELSE round(depth, 6) END AS clean FROM mask")
def p7_outlier_mask(spark, sf):
    m = masked(spark, sf).withColumn("clean", F.when(F.col("outlier"), 0.0).otherwise(F.col("depth")))
    return m.select("frame_id", "v", "u", "outlier", *r6("sigma", "threshold", "clean"))


@query(f"WITH {EXTREME}, {DENSITY}{bilateral('ext', 'defused')}{OUTLIERS} SELECT frame_id, v, u, outlier, round(sigma, 6) AS sigma, CASE WHEN outlier THEN 0.0 ELSE round(depth, 6) END AS clean FROM mask")
def p6_bilateral_mask(spark, sf):
    m = R.masked(px(spark, sf)).withColumn("clean", F.when(F.col("outlier"), 0.0).otherwise(F.col("depth")))
    return m.select("frame_id", "v", "u", "outlier", *r6("sigma", "clean"))


@query(f"WITH {PX}{bilateral('px', 'depth')} SELECT frame_id, v, u, round(smooth + 1e-11, 6) AS smooth FROM smooth")
def w3_bilateral(spark, sf):
    return R.bilateral_smooth(px(spark, sf), "depth").select("frame_id", "v", "u", *s6("smooth"))


@query(f"""WITH {MASK}, a AS (SELECT frame_id, avg(CASE WHEN depth > 0 THEN 1.0 ELSE 0.0 END) AS share, median(depth) FILTER (WHERE depth > 0) AS raw,
  median(depth) FILTER (WHERE depth > 0 AND NOT outlier) AS inlier, least(max(v) - min(v), max(u) - min(u)) + 1 AS side FROM mask GROUP BY frame_id)
SELECT frame_id, round(CASE WHEN share > 0 AND share >= 0.10 THEN CASE WHEN side >= 9 THEN coalesce(inlier, raw) ELSE raw END END, 6) AS z FROM a""")
def p14_robust_z(spark, sf):
    return R.robust_z(masked(spark, sf)).select("frame_id", *r6("z"))


@query(f"""WITH {MASK} SELECT frame_id, count(*) FILTER (WHERE depth > 0) AS n_valid, round(100.0 * avg(CASE WHEN depth > 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), 6) AS void_pct,
  count(*) FILTER (WHERE outlier) AS n_outliers, round(100.0::DOUBLE * count(*) FILTER (WHERE outlier) / count(*) FILTER (WHERE depth > 0), 6) AS outlier_pct,
  round(100.0::DOUBLE * count(*) FILTER (WHERE depth > 0 AND NOT outlier) / count(*) FILTER (WHERE depth > 0), 6) AS retention_pct, round(median(sigma) FILTER (WHERE depth > 0), 6) AS median_sigma
FROM mask GROUP BY frame_id""")
def a17_frame_summary(spark, sf):
    return R.frame_summary(masked(spark, sf)).select("frame_id", "n_valid", "n_outliers", *r6("void_pct", "outlier_pct", "retention_pct", "median_sigma"))


@query(f"""WITH {PX}, q AS (SELECT frame_id, quantile_cont(depth, 0.25) AS a, quantile_cont(depth, 0.75) AS b FROM px WHERE depth > 0 GROUP BY frame_id)
SELECT frame_id, v, u, round(CASE WHEN depth > 0 AND (depth < a - 0.5 * (b - a) OR depth > b + 0.5 * (b - a)) THEN 0.0 ELSE depth END, 6) AS clean FROM px JOIN q USING (frame_id)""")
def p9_iqr_filter(spark, sf):
    return R.iqr_filter(px(spark, sf), 0.5).select("frame_id", "v", "u", *r6("clean"))


@query(f"WITH {PX} SELECT frame_id, v, u, round((u - 50.0) * depth / 80.0 + 1e-11, 6) AS x, round((v - 50.0) * depth / 80.0 + 1e-11, 6) AS y, round(depth + 1e-11, 6) AS z FROM px WHERE depth > 0")
def p17_backproject(spark, sf):
    return G.valid_points(G.backproject(px(spark, sf), K)).select("frame_id", "v", "u", *s6("x", "y", "z"))


@query(f"WITH {PX} SELECT frame_id, CAST(u AS DOUBLE) AS x, CAST(v AS DOUBLE) AS y, round(depth, 6) AS z FROM px WHERE depth > 0")
def p18_orthographic(spark, sf):
    return G.valid_points(G.backproject(px(spark, sf), None)).select("frame_id", "x", "y", *r6("z"))


@query("""WITH p AS (SELECT label AS cloud_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) + 3 AS z FROM embeddings),
q AS (SELECT cloud_id, CAST(trunc(x * 80.0 / z + 50.0) AS INTEGER) AS u, CAST(trunc(y * 80.0 / z + 50.0) AS INTEGER) AS v, z FROM p WHERE z > 0)
SELECT cloud_id, v, u, round(min(z), 6) AS depth FROM q WHERE u >= 0 AND u < 100 AND v >= 0 AND v < 100 GROUP BY ALL""")
def p10_z_buffer(spark, sf):
    p = points(spark, sf).withColumn("z", F.col("z") + 3)
    return G.z_buffer(p, K, 100, 100).select("cloud_id", "v", "u", *r6("depth"))


@query(f"WITH {PX} SELECT frame_id, v, u, round(CASE WHEN u >= 0 AND u < 30 AND v >= 20 AND v < 200 THEN 0.0 ELSE depth END, 6) AS depth FROM px")
def p20_rect_voids(spark, sf):
    return R.inject_rect(px(spark, sf), -5, 20, 30, 200).select("frame_id", "v", "u", *r6("depth"))


@query(f"""WITH {PX}, g AS (SELECT *, lag(depth) OVER (PARTITION BY frame_id, v ORDER BY u) AS a, lead(depth) OVER (PARTITION BY frame_id, v ORDER BY u) AS b,
  lag(depth) OVER (PARTITION BY frame_id, u ORDER BY v) AS c, lead(depth) OVER (PARTITION BY frame_id, u ORDER BY v) AS d FROM px)
SELECT frame_id, v, u, round(CASE WHEN a IS NULL THEN b - depth WHEN b IS NULL THEN depth - a ELSE (b - a) / 2 END, 6) AS gu,
  round(CASE WHEN c IS NULL THEN d - depth WHEN d IS NULL THEN depth - c ELSE (d - c) / 2 END, 6) AS gv FROM g""")
def w5_gradient(spark, sf):
    return R.gradient(px(spark, sf)).select("frame_id", "v", "u", *r6("gu", "gv"))


DRAW = """md5('7|' || frame_id || '|' || v || '|' || u)"""
NORMAL = """sqrt(-2 * ln((CAST('0x' || substr(d, 11, 11) AS BIGINT) + 1) / 17592186044416.0::DOUBLE)) * cos(2 * pi() * ((CAST('0x' || substr(d, 22, 11) AS BIGINT) + 1) / 17592186044416.0::DOUBLE))"""
EDGES = PX + """, g AS (SELECT *, lag(depth) OVER (PARTITION BY frame_id, v ORDER BY u) AS a, lead(depth) OVER (PARTITION BY frame_id, v ORDER BY u) AS b,
  lag(depth) OVER (PARTITION BY frame_id, u ORDER BY v) AS c, lead(depth) OVER (PARTITION BY frame_id, u ORDER BY v) AS e FROM px),
s AS (SELECT frame_id, v, u, depth, coalesce(greatest(abs(CASE WHEN a IS NULL THEN b - depth WHEN b IS NULL THEN depth - a ELSE (b - a) / 2 END),
  abs(CASE WHEN c IS NULL THEN e - depth WHEN e IS NULL THEN depth - c ELSE (e - c) / 2 END)) > 0.05, false) AS step FROM g),
edges AS (SELECT frame_id, v, u, depth, max(step) OVER (PARTITION BY frame_id, u ORDER BY v RANGE BETWEEN 1 PRECEDING AND 0 FOLLOWING) AS edge
  FROM (SELECT frame_id, v, u, depth, max(step) OVER (PARTITION BY frame_id, v ORDER BY u RANGE BETWEEN 1 PRECEDING AND 0 FOLLOWING) AS step FROM s))"""


@query(f"WITH {EDGES} SELECT frame_id, v, u, edge FROM edges")
def p22_edge_voids(spark, sf):
    return C.edge_voids(px(spark, sf), 2).select("frame_id", "v", "u", "edge")


@query(f"""WITH {EDGES}, q AS (SELECT *, {DRAW} AS d, floor(count(*) OVER (PARTITION BY frame_id) * 0.9::DOUBLE) - sum(CAST(edge AS INTEGER)) OVER (PARTITION BY frame_id) AS budget FROM edges),
r AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY d, v, u) AS r FROM q)
SELECT frame_id, v, u, round(CASE WHEN edge OR r <= budget THEN 0.0 WHEN depth > 0 THEN greatest(0.0, depth + 0.015::DOUBLE * depth * depth * {NORMAL}) ELSE greatest(0.0, depth) END, 6) AS corrupted FROM r""")
def p22_corrupted(spark, sf):
    return C.corrupted(px(spark, sf), 0.9, 0.015, 2, 7).select("frame_id", "v", "u", *r6("corrupted"))


@query(f"""WITH {PX}, q AS (SELECT *, {DRAW} AS d, floor(count(*) FILTER (WHERE depth > 0) OVER (PARTITION BY frame_id) * 0.4::DOUBLE) AS n FROM px),
r AS (SELECT *, row_number() OVER (PARTITION BY frame_id, depth > 0 ORDER BY d, v, u) AS r FROM q)
SELECT frame_id, v, u, round(CASE WHEN NOT depth > 0 THEN depth WHEN r <= n THEN 0.0 ELSE greatest(0.0, depth + 0.1::DOUBLE * {NORMAL}) END, 6) AS injected FROM r""")
def p21_injected(spark, sf):
    return C.injected(px(spark, sf), 0.4, 0.1, 7).select("frame_id", "v", "u", *r6("injected"))


def boxes(spark, sf):
    """A box for each part, dealt over all frames, on the 100 x 100 image or partly beyond it."""
    k, frames = F.col("p_partkey"), t(spark, sf, "events").agg((F.floor(F.max("event_id") / 10000) + 1).alias("frames"))
    p = t(spark, sf, "part").join(F.broadcast(frames))  # one row
    return p.select(k.alias("box_id"), F.pmod(k, "frames").cast("long").alias("frame_id"), (k % 97).cast("int").alias("x_min"), (k * 7 % 89).cast("int").alias("y_min"), (k % 97 + 8 + F.col("p_size") % 30).cast("int").alias("x_max"), (k * 7 % 89 + 8 + F.col("p_size") % 23).cast("int").alias("y_max"))


BOXES = "boxes AS (SELECT p_partkey AS box_id, p_partkey % (SELECT max(event_id) // 10000 + 1 FROM events) AS frame_id, CAST(p_partkey % 97 AS INTEGER) AS x_min, CAST(p_partkey * 7 % 89 AS INTEGER) AS y_min, CAST(p_partkey % 97 + 8 + p_size % 30 AS INTEGER) AS x_max, CAST(p_partkey * 7 % 89 + 8 + p_size % 23 AS INTEGER) AS y_max FROM part)"


def images(spark, sf):
    return R.to_frames(px(spark, sf), "double")


@query(f"WITH {BOXES}, c AS (SELECT box_id, least(greatest(x_min, 0), 100) AS x_min, least(greatest(y_min, 0), 100) AS y_min, least(greatest(x_max, 0), 100) AS x_max, least(greatest(y_max, 0), 100) AS y_max FROM boxes) SELECT *, x_max > x_min AND y_max > y_min AS inside FROM c")
def p23_box_clamp(spark, sf):
    return G.clamped(boxes(spark, sf), 100, 100).drop("frame_id")


@query(f"""WITH {PX}, {BOXES}
SELECT b.box_id, count(*) AS n_pixels, round(avg(CASE WHEN depth > 0 THEN 1.0::DOUBLE ELSE 0.0 END) + 1e-11, 6) AS inlier_ratio, round(median(depth) FILTER (WHERE depth > 0) + 1e-11, 6) AS z_est
FROM boxes b JOIN px f ON f.frame_id = b.frame_id AND u >= x_min AND u < x_max AND v >= y_min AND v < y_max GROUP BY b.box_id""")
def j1_box_crops(spark, sf):
    return G.crop_stats(images(spark, sf), boxes(spark, sf)).select("box_id", "n_pixels", *s6("inlier_ratio", "z_est"))


@query(f"""WITH {PX}, {BOXES}, b AS (SELECT *, greatest(x_max - x_min, y_max - y_min) // 2 AS pad FROM boxes), h AS (
  SELECT b.box_id, median(depth) AS z FROM b JOIN px ON px.frame_id = b.frame_id AND u >= x_min - pad AND u < x_max + pad AND v >= y_min - pad AND v < y_max + pad
  AND NOT (u >= x_min AND u < x_max AND v >= y_min AND v < y_max) AND depth > 0 GROUP BY b.box_id)
SELECT b.box_id, round(h.z + 1e-11, 6) AS z FROM b LEFT JOIN h USING (box_id)""")
def p15_ring_z(spark, sf):
    b = boxes(spark, sf)
    return b.select("box_id").join(G.ring_medians(images(spark, sf), b).select("box_id", *s6("z")), "box_id", "left")


SMALL = BOXES + ", small AS (SELECT box_id, frame_id, x_min, y_min, least(x_max, x_min + box_id % 3 + 1) AS x_max, least(y_max, y_min + box_id % 2 + 1) AS y_max FROM boxes)"


@query(f"""WITH {PX}, {SMALL}, b AS (SELECT *, greatest(x_max - x_min, y_max - y_min) // 2 AS pad FROM small), c AS (
  SELECT box_id, avg(CASE WHEN depth > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS share, median(depth) FILTER (WHERE depth > 0) AS z FROM b JOIN px ON px.frame_id = b.frame_id AND u >= x_min AND u < x_max AND v >= y_min AND v < y_max GROUP BY box_id), h AS (
  SELECT b.box_id, median(depth) AS z FROM b JOIN px ON px.frame_id = b.frame_id AND u >= x_min - pad AND u < x_max + pad AND v >= y_min - pad AND v < y_max + pad
  AND NOT (u >= x_min AND u < x_max AND v >= y_min AND v < y_max) AND depth > 0 GROUP BY b.box_id)
SELECT b.box_id, round(CASE WHEN c.box_id IS NULL THEN NULL WHEN c.share >= 0.1 THEN c.z ELSE h.z END + 1e-11, 6) AS z FROM b LEFT JOIN c USING (box_id) LEFT JOIN h USING (box_id)""")
def p14_ring(spark, sf):
    """Boxes of a few pixels: the ring around decides where none of them is valid."""
    k = F.col("box_id")
    b = boxes(spark, sf).withColumns({"x_max": F.least("x_max", (F.col("x_min") + k % 3 + 1).cast("int")), "y_max": F.least("y_max", (F.col("y_min") + k % 2 + 1).cast("int"))})
    return b.select("box_id").join(G.stable_depths(images(spark, sf), b).select("box_id", *s6("z")), "box_id", "left")


@query(f"""WITH {PX}, {BOXES}, h AS (SELECT b.*, z_est, z_min, z_max FROM boxes b LEFT JOIN (
  SELECT box_id, median(depth) AS z_est, min(depth) AS z_min, max(depth) AS z_max FROM boxes JOIN px ON px.frame_id = boxes.frame_id AND u >= x_min AND u < x_max AND v >= y_min AND v < y_max AND depth > 0 GROUP BY box_id) USING (box_id))
SELECT box_id, round(z_est + 1e-11, 6) AS z_est, round(least((x_min - 50.0) * z_min / 80.0, (x_min - 50.0) * z_max / 80.0, (x_max - 50.0) * z_min / 80.0, (x_max - 50.0) * z_max / 80.0) + 1e-11, 6) AS x_lo,
  round(greatest((x_min - 50.0) * z_min / 80.0, (x_min - 50.0) * z_max / 80.0, (x_max - 50.0) * z_min / 80.0, (x_max - 50.0) * z_max / 80.0) + 1e-11, 6) AS x_hi,
  round(least((y_min - 50.0) * z_min / 80.0, (y_min - 50.0) * z_max / 80.0, (y_max - 50.0) * z_min / 80.0, (y_max - 50.0) * z_max / 80.0) + 1e-11, 6) AS y_lo,
  round(greatest((y_min - 50.0) * z_min / 80.0, (y_min - 50.0) * z_max / 80.0, (y_max - 50.0) * z_min / 80.0, (y_max - 50.0) * z_max / 80.0) + 1e-11, 6) AS y_hi, round(z_min + 1e-11, 6) AS z_lo, round(z_max + 1e-11, 6) AS z_hi FROM h""")
def p27_naive_lift(spark, sf):
    return G.naive_lift(images(spark, sf), boxes(spark, sf), K).select("box_id", *s6("z_est", "x_lo", "x_hi", "y_lo", "y_hi", "z_lo", "z_hi"))


@query()
def p25_robust_lift(spark, sf):
    """Boxes that lie on their frame, whose last line may be missing at the smallest scale."""
    frames = images(spark, sf)
    b = G.clamped(boxes(spark, sf).join(frames.select("frame_id", "h", "w"), "frame_id"), F.col("w"), F.col("h")).where("inside").drop("h", "w", "inside")
    return G.lift(frames, b, K).select("box_id", *r6("z_est", "z_min", "z_max", "inlier_ratio"), F.transform(F.flatten("vertices"), lambda x: F.round(x, 6)).alias("vertices"))


@query()
def p12_marched(spark, sf):
    """Voids filled by a marching front, and by rings beside it."""
    frames, marching = R.to_frames(px(spark, sf), "double"), replace(R.DEFAULT, inpaint="march")
    both = R.inpainted_frames(R.inpainted_frames(frames).withColumnRenamed("inpainted", "rings"), marching)
    cells = F.arrays_zip("depth", F.col("inpainted").alias("marched"), "rings")
    return both.select("frame_id", F.posexplode(cells).alias("i", "c")).select("frame_id", "i", *(F.round(F.col(f"c.{n}") + TIE, 6).alias(n) for n in ("depth", "marched", "rings")))


@query()
def p13_restored_frames(spark, sf):
    done = R.restore_frames(R.to_frames(px(spark, sf)))
    return done.select("frame_id", F.posexplode("restored").alias("i", "depth")).select("frame_id", "i", F.round("depth", 5).alias("depth"))


@query()
def p13_restored_pixels(spark, sf):
    """The same over tiles of pixels, for frames that fit no task."""
    done = R.restored_pixels(px(spark, sf))
    return done.select("frame_id", "v", "u", F.round("restored", 5).alias("depth"))


# evaluation

def evalrows(spark, sf):
    l = t(spark, sf, "lineitem")
    gx, gy = (F.col("l_partkey") % 500).cast("int"), (F.col("l_suppkey") % 400).cast("int")
    w, s = (8 + F.col("l_quantity")).cast("int"), F.col("l_linenumber").cast("int")
    iou = G.iou_2d((gx, gy, gx + w, gy + w), (gx + s, gy + s, gx + s + w, gy + s + w))
    return l.select(
        F.col("l_returnflag").alias("detector"), F.col("l_linestatus").alias("source"), F.when(F.col("l_linenumber") % 2 == 0, "robust").otherwise("naive").alias("lifter"),
        (F.round(F.col("l_discount") * 100) / 10).alias("severity"), iou.alias("iou_2d"), (F.col("l_extendedprice") % 100).alias("z_err_cm"), (iou / 2).alias("iou_3d"), (F.col("l_tax") > 0).alias("success"),
    )


EVAL = """o AS (SELECT *, CAST(8 + l_quantity AS INTEGER) AS w FROM lineitem), i AS (SELECT *, greatest(0, w - l_linenumber) * greatest(0, w - l_linenumber) AS inter FROM o),
evalrows AS (SELECT l_returnflag AS detector, l_linestatus AS source, CASE WHEN l_linenumber % 2 = 0 THEN 'robust' ELSE 'naive' END AS lifter, round(l_discount * 100) / 10 AS severity,
  CAST(inter AS DOUBLE) / (2 * w * w - inter) AS iou_2d, l_extendedprice % 100 AS z_err_cm, CAST(inter AS DOUBLE) / (2 * w * w - inter) / 2 AS iou_3d, l_tax > 0 AS success FROM i)"""
REPORT = EVAL + """, report AS (SELECT detector || '|' || source || '|' || lifter || '_sev>=' || printf('%.1f', threshold) AS key, detector, source, lifter, threshold, count(*) AS n,
  avg(CASE WHEN iou_2d >= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END) AS acc, median(iou_2d) AS median_iou_2d, coalesce(median(z_err_cm) FILTER (WHERE success), 'nan'::DOUBLE) AS median_z_err_cm,
  coalesce(median(iou_3d) FILTER (WHERE success), 'nan'::DOUBLE) AS median_iou_3d FROM evalrows JOIN (VALUES (0.0::DOUBLE), (0.5::DOUBLE)) h(threshold) ON severity >= threshold GROUP BY ALL)"""


@query(f"WITH {REPORT} SELECT key, detector, source, lifter, threshold, n, round(acc, 6) AS acc, round(median_iou_2d, 6) AS median_iou_2d, round(median_z_err_cm, 6) AS median_z_err_cm, round(median_iou_3d, 6) AS median_iou_3d FROM report")
def a11_eval_report(spark, sf):
    return M.evaluation_report(evalrows(spark, sf)).select("key", "detector", "source", "lifter", "threshold", "n", *r6("acc", "median_iou_2d", "median_z_err_cm", "median_iou_3d"))


#: The medians of the report, moved off halves of the last place.
MOVED = "acc median_iou_2d median_z_err_cm median_iou_3d".split()
CELLS = ", ".join(f"CASE WHEN isnan({c}) THEN 'nan' ELSE printf('%.{2 if 'cm' in c else 3}f', {c} + {TIE}::DOUBLE) END" for c in MOVED)


@query(f"WITH {REPORT} SELECT key, '| ' || concat_ws(' | ', detector, source, lifter, printf('%.1f', threshold), {CELLS}, CAST(n AS VARCHAR)) || ' |' AS line FROM report")
def k5_report_lines(spark, sf):
    return sinks.report_lines(M.evaluation_report(evalrows(spark, sf)).withColumns({c: F.col(c) + TIE for c in MOVED}))


@query(f"WITH {EVAL} SELECT detector, round(coalesce(median(iou_3d) FILTER (WHERE success), 0.0), 6) AS median_iou FROM evalrows GROUP BY detector")
def a30_canary_iou(spark, sf):
    return evalrows(spark, sf).groupBy("detector").agg(F.round(canary.median_iou(F.col("iou_3d"), F.col("success")), 6).alias("median_iou"))


STATS = ("n", "acc", "median_iou_2d", "median_z_err_cm", "median_iou_3d")


@query(f"WITH {REPORT} " + " UNION ALL ".join(f"SELECT key || '__{c}' AS k, round(CAST({c} AS DOUBLE) + 1e-11, 6) AS v FROM report" for c in STATS))
def a31_flat_metrics(spark, sf):
    return M.flattened(M.evaluation_report(evalrows(spark, sf)), [*STATS]).select("k", F.round(F.col("v") + TIE, 6).alias("v"))


@query(f"WITH {EVAL} SELECT detector, lifter, count(*) AS n, round(avg(iou_2d), 6) AS mean_iou FROM evalrows GROUP BY ALL")
def a9_box_iou(spark, sf):
    return evalrows(spark, sf).groupBy("detector", "lifter").agg(F.count("*").alias("n"), F.round(F.avg("iou_2d"), 6).alias("mean_iou"))


@query("""WITH c AS (SELECT l_returnflag AS g, CAST(l_quantity AS DOUBLE) AS a, 1.0 + l_linenumber AS s FROM lineitem), i AS (SELECT *, greatest(0.0, a - s / 10) * greatest(0.0, a - s / 5) * a AS inter FROM c)
SELECT g, round(avg(inter / (2 * a * a * a - inter)), 6) AS mean_iou FROM i GROUP BY g""")
def a10_box_iou_3d(spark, sf):
    l, a, s = t(spark, sf, "lineitem"), F.col("l_quantity").cast("double"), 1.0 + F.col("l_linenumber")
    zero = F.lit(0.0)
    one = {"x_lo": zero, "x_hi": a, "y_lo": zero, "y_hi": a, "z_lo": zero, "z_hi": a}
    two = {"x_lo": s / 10, "x_hi": a + s / 10, "y_lo": s / 5, "y_hi": a + s / 5, "z_lo": zero, "z_hi": a}
    return l.groupBy(F.col("l_returnflag").alias("g")).agg(F.round(F.avg(G.iou_3d(one, two)), 6).alias("mean_iou"))


@query("""SELECT l_returnflag AS g, round(sqrt(avg(d * d)), 4) AS rmse, round(avg(abs(d)), 4) AS mae, round(avg(d), 4) AS bias FROM (SELECT l_returnflag, CASE WHEN l_tax > 0 THEN l_extendedprice / 1000 - l_quantity END AS d FROM lineitem WHERE l_extendedprice > 0) GROUP BY 1""")
def a1_error_measures(spark, sf):
    p, q = F.col("l_extendedprice") / 1000, F.col("l_quantity").cast("double")
    m = M.error_measures(p, q, F.col("l_tax") > 0)
    return t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(*(F.round(c, 4).alias(n) for n, c in m.items()))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS tp, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS fp, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS fn, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS tn FROM labels),
p AS (SELECT *, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / CAST(tp + fn AS DOUBLE) AS recall, fp / CAST(fp + tn AS DOUBLE) AS fpr FROM c)
SELECT tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / (precision + recall), 6) AS f1, round(fpr, 6) AS fpr, round(1 - fpr, 6) AS retention FROM p""")
def a3_detection(spark, sf):
    m = M.detection_measures(F.col("toxic") == 1, F.col("quality") == 0)
    got = t(spark, sf, "labels").agg(*(c.alias(n) for n, c in m.items()))
    return got.select("tp", "fp", "fn", "tn", *r6("precision", "recall", "f1", "fpr", "retention"))


@query("""WITH s AS (SELECT event_type AS stage, value AS ms FROM events), a AS (SELECT stage, avg(ms) AS m, stddev_pop(ms) AS d FROM s GROUP BY stage)
SELECT stage, round(m, 5) AS mean_ms, round(d, 5) AS std_ms, round(CASE WHEN stage = 'view' THEN 100.0 ELSE 100 * m / sum(CASE WHEN stage <> 'view' THEN m END) OVER () END, 5) AS share_pct FROM a""")
def a16_timing(spark, sf):
    s = t(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("ms"))
    return M.timing_summary(s, "view").select("stage", *(F.round(c, 5).alias(c) for c in ("mean_ms", "std_ms", "share_pct")))


@query("SELECT o_orderpriority AS cell, coalesce(printf('%.2f', median(o_totalprice) FILTER (WHERE o_orderstatus <> 'P' AND o_orderkey % 11 <> 0) + 1e-11::DOUBLE), 'N/A') AS shown FROM orders GROUP BY 1")
def a12_median_cells(spark, sf):
    x = F.when(F.col("o_orderstatus") == "P", NAN).when(F.col("o_orderkey") % 11 == 0, None).otherwise(F.col("o_totalprice"))
    return t(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("cell")).agg(shown(benchmark.known_median(x) + TIE, 2).alias("shown"))


@query("""SELECT o_orderpriority AS hypothesis, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS "F", round(avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 4) AS "O", round(avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 4) AS "P" FROM orders GROUP BY 1""")
def j14_pivot_grid(spark, sf):
    p = M.cells(t(spark, sf, "orders").withColumnRenamed("o_orderpriority", "hypothesis"), "hypothesis", "o_orderstatus", ["F", "O", "P"], F.avg("o_totalprice"))
    return p.select("hypothesis", *(F.round(c, 4).alias(c) for c in "FOP"))


# point clouds

def points(spark, sf):
    e = t(spark, sf, "embeddings")
    return e.select(F.col("label").alias("cloud_id"), F.col("vec_id").alias("pt_id"), *(F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")))


PTS = "pts AS (SELECT label AS cloud_id, vec_id AS pt_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


@query(f"""WITH {PTS}, l AS (SELECT cloud_id, min(x) AS a, min(y) AS b, min(z) AS c FROM pts GROUP BY cloud_id)
SELECT cloud_id, CAST(floor((x - a) / 0.5) AS BIGINT) AS cell_x, CAST(floor((y - b) / 0.5) AS BIGINT) AS cell_y, CAST(floor((z - c) / 0.5) AS BIGINT) AS cell_z, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM pts JOIN l USING (cloud_id) GROUP BY 1, 2, 3, 4""")
def m2_voxels(spark, sf):
    return S.voxels(points(spark, sf), 0.5).select("cloud_id", "cell_x", "cell_y", "cell_z", "n", *r6("x", "y", "z"))


@query(f"""WITH {PTS}, a AS (SELECT * FROM pts WHERE cloud_id = 0), b AS (SELECT * FROM pts WHERE cloud_id <> 0),
d AS (SELECT a.pt_id AS i, b.pt_id AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM a, b), n1 AS (SELECT i, min(d) AS d FROM d GROUP BY i), n2 AS (SELECT j, min(d) AS d FROM d GROUP BY j)
SELECT round(((SELECT avg(d) FROM n1) + (SELECT avg(d) FROM n2)) / 2, 6) AS chamfer, round(greatest((SELECT max(d) FROM n1), (SELECT max(d) FROM n2)), 6) AS hausdorff, round((SELECT avg(CASE WHEN d <= 0.5 THEN 1.0::DOUBLE ELSE 0.0 END) FROM n2), 6) AS coverage""")
def a7_cloud_distances(spark, sf):
    p = points(spark, sf).withColumn("id", F.col("pt_id"))
    return M.cloud_distances(p.where("cloud_id = 0"), p.where("cloud_id <> 0"), 0.5).select(*r6("chamfer", "hausdorff", "coverage"))


@query(f"""WITH {PTS}, a AS (SELECT * FROM pts WHERE cloud_id = 0), b AS (SELECT * FROM pts WHERE cloud_id <> 0),
d AS (SELECT a.pt_id AS id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM a, b GROUP BY 1) SELECT id, d <= 0.4 AS covered, CASE WHEN d <= 0.4 THEN round(d, 6) END AS d FROM d""")
def a8_grid_coverage(spark, sf):
    p = points(spark, sf).withColumn("id", F.col("pt_id"))
    got = M.nearest(p.where("cloud_id = 0"), p.where("cloud_id <> 0"), cell=0.4)
    return got.select("id", F.coalesce(F.col("d") <= 0.4, F.lit(False)).alias("covered"), F.when(F.col("d") <= 0.4, F.round("d", 6)).alias("d"))


@query(f"WITH {PTS}, c AS (SELECT *, x - avg(x) OVER w AS a, y - avg(y) OVER w AS b, z - avg(z) OVER w AS c FROM pts WINDOW w AS (PARTITION BY cloud_id)), m AS (SELECT *, max(greatest(abs(a), abs(b), abs(c))) OVER (PARTITION BY cloud_id) AS s FROM c) SELECT cloud_id, pt_id, round(a / s, 6) AS x, round(b / s, 6) AS y, round(c / s, 6) AS z FROM m")
def p28_centred(spark, sf):
    return S.centred(points(spark, sf)).select("cloud_id", "pt_id", *r6("x", "y", "z"))


@query(f"WITH {PTS}, c AS (SELECT *, x - avg(x) OVER w AS a, y - avg(y) OVER w AS b, z - avg(z) OVER w AS c FROM pts WINDOW w AS (PARTITION BY cloud_id)), m AS (SELECT *, max(sqrt(a * a + b * b + c * c)) OVER (PARTITION BY cloud_id) AS s FROM c) SELECT cloud_id, pt_id, round(a / s, 6) AS x, round(b / s, 6) AS y, round(c / s, 6) AS z FROM m")
def p29_centred_norm(spark, sf):
    return S.centred(points(spark, sf), "norm").select("cloud_id", "pt_id", *r6("x", "y", "z"))


@query(f"WITH {PTS} SELECT cloud_id, count(*) AS n, round(sqrt((max(x) - min(x)) ** 2 + (max(y) - min(y)) ** 2 + (max(z) - min(z)) ** 2), 6) AS diagonal FROM pts GROUP BY 1")
def m5_diagonals(spark, sf):
    return S.diagonals(points(spark, sf)).select("cloud_id", "n", *r6("diagonal"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 5) AS norm FROM embeddings")
def e5_embedding_norm(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", F.round(S.norm(F.col("embedding")), 5).alias("norm"))


@query("""WITH s AS (SELECT p_partkey, (p_partkey % 101) / 100.0::DOUBLE AS c, 1 + (p_size % 40) / 10.0::DOUBLE AS a FROM part)
SELECT p_partkey, CASE WHEN c > 0.85 THEN 'sphere-like' WHEN c > 0.5 AND a < 1.5 THEN 'box-like / compact' WHEN a > 3 THEN 'elongated' WHEN c < 0.3 AND a < 2 THEN 'organic / complex surface (animal, plant, etc.)' WHEN a > 2 THEN 'elongated' ELSE 'irregular / mixed geometry' END AS label FROM s""")
def m12_shape_label(spark, sf):
    c, a = (F.col("p_partkey") % 101) / 100.0, 1 + (F.col("p_size") % 40) / 10.0
    return t(spark, sf, "part").select("p_partkey", S.shape_label(c, a).alias("label"))


def meshes(spark, sf):
    """A box for each part: 8 vertices, 12 triangles."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("mesh_id"), (1 + F.col("p_size") % 7).cast("double").alias("a"), (1 + F.col("p_partkey") % 3).cast("double").alias("b"))
    v = p.select("mesh_id", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("vid"))
    v = v.select("mesh_id", "vid", (F.col("vid") % 2 * F.col("a")).alias("x"), (F.floor(F.col("vid") / 2) % 2 * F.col("b")).alias("y"), F.floor(F.col("vid") / 4).cast("double").alias("z"))
    faces = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    f = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip((k, *face), ("fid", "i", "j", "k"), strict=True))) for k, face in enumerate(faces))))
    return v, p.select("mesh_id", f.alias("f")).select("mesh_id", "f.*")


@query("""WITH p AS (SELECT p_partkey AS mesh_id, CAST(1 + p_size % 7 AS DOUBLE) AS a, CAST(1 + p_partkey % 3 AS DOUBLE) AS b FROM part), s AS (SELECT *, a * b AS volume, 2 * (a * b + a + b) AS surface_area FROM p)
SELECT mesh_id, round(volume, 6) AS volume, round(surface_area, 6) AS surface_area, round(36 * pi() * volume * volume / pow(surface_area, 3), 6) AS compactness, round(greatest(a, b, 1) / least(a, b, 1), 6) AS aspect_ratio, 8::BIGINT AS n_vertices, 12::BIGINT AS n_faces FROM s""")
def m10_shape_descriptors(spark, sf):
    return S.shape_descriptors(*meshes(spark, sf)).select("mesh_id", *r6("volume", "surface_area", "compactness", "aspect_ratio"), "n_vertices", F.col("n_faces").cast("long").alias("n_faces"))


MESHES = """box AS (SELECT p_partkey AS mesh_id, CAST(1 + p_size % 7 AS DOUBLE) AS a, CAST(1 + p_partkey % 3 AS DOUBLE) AS b FROM part),
face(fid, i, j, k) AS (VALUES (0, 0, 2, 1), (1, 1, 2, 3), (2, 4, 5, 6), (3, 5, 7, 6), (4, 0, 1, 4), (5, 1, 5, 4), (6, 2, 6, 3), (7, 3, 6, 7), (8, 0, 4, 2), (9, 2, 4, 6), (10, 1, 3, 5), (11, 3, 7, 5)),
tri AS (SELECT mesh_id, fid, i % 2 * a AS ix, i // 2 % 2 * b AS iy, CAST(i // 4 AS DOUBLE) AS iz, j % 2 * a AS jx, j // 2 % 2 * b AS jy, CAST(j // 4 AS DOUBLE) AS jz, k % 2 * a AS kx, k // 2 % 2 * b AS ky, CAST(k // 4 AS DOUBLE) AS kz FROM box, face)"""
SHARE = lambda n: f"(CAST('0x' || substr(md5('0|{n}|' || mesh_id || '|' || s), 1, 11) AS BIGINT) + 1) / 17592186044416.0::DOUBLE"


@query(f"""WITH {MESHES}, area AS (SELECT *, sqrt(((jy - iy) * (kz - iz) - (jz - iz) * (ky - iy)) ** 2 + ((jz - iz) * (kx - ix) - (jx - ix) * (kz - iz)) ** 2 + ((jx - ix) * (ky - iy) - (jy - iy) * (kx - ix)) ** 2) AS area FROM tri),
upto AS (SELECT *, sum(area) OVER (PARTITION BY mesh_id ORDER BY fid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(area) OVER (PARTITION BY mesh_id) AS hi FROM area),
parts AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY mesh_id ORDER BY fid), 0.0) AS lo FROM upto), draws AS (SELECT mesh_id, s, {SHARE(1)} AS r, sqrt({SHARE(2)}) AS a, {SHARE(3)} AS b FROM box, range(16) x(s))
SELECT mesh_id, s, {', '.join(f"round(i{c} * (1 - d.a) + j{c} * d.a * (1 - d.b) + k{c} * d.a * d.b + 1e-11, 6) AS {c}" for c in 'xyz')} FROM draws d JOIN parts USING (mesh_id) WHERE r > lo AND r <= hi""")
def m9_surface_samples(spark, sf):
    v, f = meshes(spark, sf)
    return S.surface_sample(v, f, 16).select("mesh_id", F.col("s").cast("long").alias("s"), *s6("x", "y", "z"))


@query()
def e1_point_encoder(spark, sf):
    p = points(spark, sf).groupBy("cloud_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pt_id", F.array("x", "y", "z").alias("p")))), lambda c: c["p"]).alias("points"))
    return S.encode_clouds(p.withColumn("cloud_id", F.col("cloud_id").cast("long"))).select("cloud_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))


# parsing

VIEW = scene.Camera(24, 32, eye=(2.0, 3.0, -9.0), target=(2.0, 1.0, 0.0))
MOVES = [" + ".join(f"({c} - {e!r}::DOUBLE) * {float(a)!r}::DOUBLE" for c, e, a in zip("xyz", VIEW.eye, axis, strict=True)) for axis in VIEW.axes]
MOVES = ", ".join(f"round({f}({m}) + {TIE}::DOUBLE, 6) AS {c}_{n}" for m, c in zip(MOVES, "xyz", strict=True) for f, n in (("min", "lo"), ("max", "hi")))


@query(f"""WITH p AS (SELECT p_partkey AS mesh_id, CAST(1 + p_size % 7 AS DOUBLE) AS a, CAST(1 + p_partkey % 3 AS DOUBLE) AS b FROM part),
v AS (SELECT mesh_id, vid % 2 * a AS x, vid // 2 % 2 * b AS y, CAST(vid // 4 AS DOUBLE) AS z FROM p, range(8) r(vid)) SELECT mesh_id, {MOVES} FROM v GROUP BY mesh_id""")
def p30_camera_boxes(spark, sf):
    return scene.camera_boxes(meshes(spark, sf)[0], VIEW).select("mesh_id", *s6(*(f"{c}_{n}" for c in "xyz" for n in ("lo", "hi"))))


#: How far a scene's objects stand apart, so that no two faces lie in one plane.
APART = (0.37, 0.21, 0.13)


def ray(axis: int) -> str:
    """A ray's direction along a world axis, from the pixel's place."""
    fx, fy, cx, cy = VIEW.intrinsics
    x, y, z = (float(r[axis]) for r in VIEW.axes)
    return f"(u + 0.5 - {cx!r}::DOUBLE) / {fx!r}::DOUBLE * {x!r}::DOUBLE + (v + 0.5 - {cy!r}::DOUBLE) / {fy!r}::DOUBLE * {y!r}::DOUBLE + {z!r}::DOUBLE"


def sql_cross(a: str, b: str) -> list[str]:
    return [f"({a}{p} * {b}{q} - {a}{q} * {b}{p})" for p, q in ("yz", "zx", "xy")]


@query(f"""WITH {MESHES}, t AS (SELECT mesh_id // 4 AS frame_id, mesh_id % 4 AS place, {', '.join(f"j{c} - i{c} AS e{c}, k{c} - i{c} AS f{c}, {float(VIEW.eye[n])!r}::DOUBLE - (i{c} + mesh_id % 4 * {APART[n]!r}::DOUBLE) AS s{c}" for n, c in enumerate('xyz'))} FROM tri),
ray AS (SELECT CAST(v AS INTEGER) AS v, CAST(u AS INTEGER) AS u, {', '.join(f"{ray(n)} AS d{c}" for n, c in enumerate('xyz'))} FROM range({VIEW.h}) a(v), range({VIEW.w}) b(u)),
p AS (SELECT t.*, ray.*, {', '.join(f"{x} AS p{c}" for x, c in zip(sql_cross('d', 'f'), 'xyz', strict=True))}, {', '.join(f"{x} AS q{c}" for x, c in zip(sql_cross('s', 'e'), 'xyz', strict=True))} FROM t, ray),
h AS (SELECT *, px * ex + py * ey + pz * ez AS det FROM p), g AS (SELECT *, (px * sx + py * sy + pz * sz) / det AS i, (dx * qx + dy * qy + dz * qz) / det AS j, (fx * qx + fy * qy + fz * qz) / det AS t FROM h WHERE abs(det) > 1e-12),
hit AS (SELECT frame_id, v, u, min(t) AS depth, arg_min(place, t) AS place FROM g WHERE i >= 0 AND j >= 0 AND i + j <= 1 AND t > 0 GROUP BY frame_id, v, u), f AS (SELECT DISTINCT frame_id FROM t)
SELECT frame_id, count(v) AS n_hit, count(DISTINCT place) AS n_seen, round(coalesce(sum(CAST(CAST(depth AS FLOAT) AS DOUBLE)), 0.0) / greatest(count(v), 1), 5) AS mean_depth FROM f LEFT JOIN hit USING (frame_id) GROUP BY frame_id""")
def p31_rendered(spark, sf):
    """A scene for each four parts: (frame_id, pixels hit, objects seen, mean depth of hits)."""
    v, f = meshes(spark, sf)
    v = v.withColumns({c: F.col(c) + F.col("mesh_id") % 4 * by for c, by in zip("xyz", APART, strict=True)})
    k = F.col("p_partkey")
    objects = t(spark, sf, "part").select(F.floor(k / 4).alias("frame_id"), k.alias("mesh_id"), (k % 4).cast("int").alias("place"), F.array((k % 4 + 1) / 4.0, F.lit(0.5), F.lit(0.25)).alias("colour"))
    r, hit = scene.render(scene.scenes(objects, v, f), VIEW), F.filter("depth", lambda d: d > 0)
    mean = F.aggregate(hit, F.lit(0.0), lambda s, d: s + d) / F.greatest(F.size(hit), F.lit(1))
    return r.select("frame_id", F.size(hit).alias("n_hit"), F.size(F.array_remove(F.array_distinct("instance"), 0)).alias("n_seen"), F.round(mean, 5).alias("mean_depth"))


@query()
def e4_feature_colours(spark, sf):
    return S.feature_colours(t(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding").select("vec_id", *"rgb")


SAID = (
    'Sure: ```json {"bbox_2d": [%d, %d, %d, %d]}```', "box (%d,%d),(%d, %d) end", '{"bbox": ["%d", "%d", " %d ", "%d"]}', 'nothing %d %d %d %d', '{"bbox_2d": [], "bbox": [%d, %d, %d, %d]}', '{"bbox_2d": null, "bbox": [%d, %d, %d, %d, 1]}',
    '{"bbox_2d": [%d, %d, %d, %d}', '{"bbox_2d": "none", "bbox": [%d, %d, %d, %d]}', '{"a": 1} and {"bbox_2d": [%d, %d, %d, %d]}', '{"bbox_2d": [0.%d, 0.%d, 0.9%d, 0.9%d]}', '{"bbox": [%d, %d, %d, null], "x": %d}', "(%d , %d),(%d, %d)",
)


def responses(spark, sf):
    """Answers of all kinds: a box in JSON or native tokens, as strings, per mille or fractions, empty, broken, twice, or none."""
    k = F.col("o_orderkey")
    a, b = (k % 200).cast("int"), (k % 150).cast("int")
    beyond = F.when(k % 5 == 0, 660).otherwise(0)
    spots = [a + F.when(k % 5 == 0, 300).otherwise(0), b + F.when(k % 5 == 0, 300).otherwise(0), a + 40 + beyond, b + 30 + beyond]
    s = F.lit(None).cast("string")
    for i, form in enumerate(SAID):
        s = F.when(k % len(SAID) == i, F.format_string(form, *(x.cast("int") for x in spots))).otherwise(s)
    return t(spark, sf, "orders").select(k.alias("req_id"), s.alias("response"))


SAYS = "CASE o_orderkey % 12 " + " ".join(f"WHEN {i} THEN printf('{form}', x0, y0, x1, y1)" for i, form in enumerate(SAID)) + " END"


@query(rf"""WITH k AS (SELECT *, CAST(o_orderkey % 200 AS INTEGER) + CASE WHEN o_orderkey % 5 = 0 THEN 300 ELSE 0 END AS x0, CAST(o_orderkey % 150 AS INTEGER) + CASE WHEN o_orderkey % 5 = 0 THEN 300 ELSE 0 END AS y0,
  CAST(o_orderkey % 200 AS INTEGER) + 40 + CASE WHEN o_orderkey % 5 = 0 THEN 660 ELSE 0 END AS x1, CAST(o_orderkey % 150 AS INTEGER) + 30 + CASE WHEN o_orderkey % 5 = 0 THEN 660 ELSE 0 END AS y1 FROM orders),
said AS (SELECT o_orderkey AS req_id, {SAYS} AS r FROM k), found AS (
  SELECT req_id, regexp_extract(r, '\((\d+),\s*(\d+)\)\s*,\s*\((\d+),\s*(\d+)\)', ['a', 'b', 'c', 'd']) AS n, regexp_extract(r, '(?s)\{{.*\}}') AS j FROM said), js AS (
  SELECT req_id, n, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS j FROM found), pick AS (
  SELECT req_id, n, CASE WHEN json_type(j, '$.bbox_2d') IS NULL OR json_type(j, '$.bbox_2d') = 'NULL' OR (json_type(j, '$.bbox_2d') = 'ARRAY' AND json_array_length(j, '$.bbox_2d') = 0) OR json_extract_string(j, '$.bbox_2d') = ''
    THEN json_extract(j, '$.bbox') ELSE json_extract(j, '$.bbox_2d') END AS j FROM js), four AS (
  SELECT req_id, CASE WHEN n.a <> '' THEN [TRY_CAST(n.a AS DOUBLE), TRY_CAST(n.b AS DOUBLE), TRY_CAST(n.c AS DOUBLE), TRY_CAST(n.d AS DOUBLE)] WHEN json_type(j) = 'ARRAY' AND json_array_length(j) = 4
    THEN [TRY_CAST(trim(json_extract_string(j, '$[0]')) AS DOUBLE), TRY_CAST(trim(json_extract_string(j, '$[1]')) AS DOUBLE), TRY_CAST(trim(json_extract_string(j, '$[2]')) AS DOUBLE), TRY_CAST(trim(json_extract_string(j, '$[3]')) AS DOUBLE)] END AS q FROM pick), c AS (
  SELECT req_id, CASE WHEN q[1] IS NOT NULL AND q[2] IS NOT NULL AND q[3] > q[1] AND q[4] > q[2] THEN q END AS q FROM four), s AS (
  SELECT req_id, CASE WHEN greatest(q[1], q[2], q[3], q[4]) <= 1 THEN [q[1] * 320, q[2] * 240, q[3] * 320, q[4] * 240] WHEN q[3] > 320 OR q[4] > 240 THEN [q[1] * 320 / 1000, q[2] * 240 / 1000, q[3] * 320 / 1000, q[4] * 240 / 1000] ELSE q END AS q FROM c), r AS (
  SELECT req_id, greatest(0, least(320, CAST(round_even(q[1], 0) AS INTEGER))) AS x_min, greatest(0, least(240, CAST(round_even(q[2], 0) AS INTEGER))) AS y_min, greatest(0, least(320, CAST(round_even(q[3], 0) AS INTEGER))) AS x_max, greatest(0, least(240, CAST(round_even(q[4], 0) AS INTEGER))) AS y_max, q IS NOT NULL AS hit FROM s), h AS (
  SELECT *, hit AND x_max > x_min AND y_max > y_min AS ok FROM r)
SELECT req_id, CASE WHEN ok THEN x_min END AS x_min, CASE WHEN ok THEN y_min END AS y_min, CASE WHEN ok THEN x_max END AS x_max, CASE WHEN ok THEN y_max END AS y_max, CASE WHEN ok THEN NULL ELSE 'vlm_detection_failed' END AS error FROM h""")
def f10_parse_boxes(spark, sf):
    b = responses(spark, sf).withColumn("b", parsing.parsed_box(F.col("response"), F.lit(320), F.lit(240)))
    return b.select("req_id", "b.x_min", "b.y_min", "b.x_max", "b.y_max", F.when(F.col("b").isNull(), "vlm_detection_failed").alias("error"))


# control plane

def queue(spark, sf):
    k = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderstatus") == "O", "pending").when(k % 5 == 0, "failed").otherwise("done")
    needs = F.when(k >= 1, F.array_distinct(F.array(F.floor(k / 2).cast("string"), F.floor(k / 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    return t(spark, sf, "orders").select(
        k.alias("pos"), k.cast("string").alias("name"), F.lit("train").alias("kind"), F.lit("{}").alias("config"), needs.alias("requires"), status.alias("status"),
        (k % 4).cast("int").alias("retries"), F.lit(2).alias("max_retries"), F.col("o_custkey").cast("string").alias("owner"), F.when(k % 7 == 0, F.lit(None)).otherwise((k % 100).cast("double")).alias("heartbeat"),
    )


QUEUE = """queue AS (SELECT o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS name, CASE o_orderstatus WHEN 'P' THEN 'running' WHEN 'O' THEN 'pending' ELSE CASE WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'done' END END AS status,
  CAST(o_orderkey % 4 AS INTEGER) AS retries, 2 AS max_retries, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS DOUBLE) END AS heartbeat FROM orders),
needs AS (SELECT pos, CAST(pos // 2 AS VARCHAR) AS need FROM queue WHERE pos >= 1 UNION SELECT pos, CAST(pos // 3 AS VARCHAR) FROM queue WHERE pos >= 1)"""


@query(f"""WITH {QUEUE} SELECT pos, name, status FROM queue q WHERE (status = 'pending' OR status = 'running' AND (heartbeat IS NULL OR 120.0 - heartbeat > 60.0))
AND NOT EXISTS (SELECT 1 FROM needs n WHERE n.pos = q.pos AND n.need NOT IN (SELECT name FROM queue WHERE status = 'done'))""")
def c1_claimable(spark, sf):
    return Q.claimable(queue(spark, sf), 120.0, 60.0).select("pos", "name", "status")


@query(f"""WITH {QUEUE}, w AS (SELECT min(pos) AS won FROM queue q WHERE (status = 'pending' OR status = 'running' AND (heartbeat IS NULL OR 120.0 - heartbeat > 60.0))
AND NOT EXISTS (SELECT 1 FROM needs n WHERE n.pos = q.pos AND n.need NOT IN (SELECT name FROM queue WHERE status = 'done')))
SELECT pos, CASE WHEN pos = won THEN 'running' ELSE status END AS status, CASE WHEN pos = won THEN 120.0 ELSE heartbeat END AS heartbeat FROM queue, w""")
def c1_claim_next(spark, sf):
    return Q.claim_next(queue(spark, sf), "me", 120.0, 60.0).select("pos", "status", "heartbeat")


@query(f"""WITH {QUEUE} SELECT pos, CASE WHEN status <> 'running' THEN status WHEN pos % 3 = 0 THEN 'done' WHEN pos % 3 = 1 THEN 'pending' WHEN retries + 1 <= max_retries THEN 'pending' ELSE 'failed' END AS status,
CASE WHEN status = 'running' AND pos % 3 = 2 THEN retries + 1 ELSE retries END AS retries FROM queue""")
def c3_release(spark, sf):
    q = queue(spark, sf)
    outcomes = q.where("status = 'running'").select("name", F.when(F.col("pos") % 3 == 0, "completed").when(F.col("pos") % 3 == 1, "preempted").otherwise("failed").alias("outcome"))
    return Q.released(q, outcomes).select("pos", "status", "retries")


@query(f"""WITH RECURSIVE {QUEUE}, bad AS (SELECT name, pos FROM queue WHERE status = 'failed' UNION SELECT q.name, q.pos FROM bad b JOIN needs n ON n.need = b.name JOIN queue q ON q.pos = n.pos AND q.status = 'pending')
SELECT q.pos, CASE WHEN b.pos IS NULL THEN q.status ELSE 'failed' END AS status FROM queue q LEFT JOIN bad b ON q.pos = b.pos""")
def c5_fail_unsatisfiable(spark, sf):
    return Q.fail_unsatisfiable(queue(spark, sf)).select("pos", "status")


@query(f"WITH {QUEUE} SELECT bool_and(status IN ('done', 'failed')) AS drained FROM queue")
def c6_is_drained(spark, sf):
    return Q.is_drained(queue(spark, sf))


@query("""SELECT c_custkey AS name, c_acctbal AS started, max(o_totalprice % 10000) AS newest, coalesce(max(o_totalprice % 10000) < c_acctbal - 60, true) AS stale
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal""")
def c12_session_progress(spark, sf):
    sessions = t(spark, sf, "customer").select(F.col("c_custkey").alias("name"), F.col("c_acctbal").alias("started"))
    return runner.session_progress(sessions, t(spark, sf, "orders").select(F.col("o_custkey").alias("name"), (F.col("o_totalprice") % 10000).alias("written")))


def results(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("hypothesis"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("created_at"), F.sha1((F.col("o_custkey") % 50).cast("string")).alias("config_hash"))


@query("SELECT o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 20")
def o1_frontier(spark, sf):
    return L.frontier(results(spark, sf), F.col("score"), 20, True, ("created_at", "id")).select("id", "score")


@query("""SELECT hypothesis, id, CAST(place AS INTEGER) AS place FROM (SELECT o_orderpriority AS hypothesis, o_orderkey AS id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderdate, o_orderkey) AS place, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) WHERE place <= greatest(1, n // 3)""")
def o4_promotion(spark, sf):
    return L.promoted(results(spark, sf), "hypothesis", "score", 3, True, ("created_at", "id")).select("hypothesis", "id", "place")


@query("SELECT config_hash, max(o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS score, min(o_orderkey) AS id FROM (SELECT *, sha1(CAST(o_custkey % 50 AS VARCHAR)) AS config_hash FROM orders) GROUP BY 1")
def k2_upsert(spark, sf):
    r = results(spark, sf).withColumn("seq", F.col("id")).select("id", "config_hash", "seq", "score")
    return L.upserted(r.where("id % 2 = 0"), r.where("id % 2 = 1")).select("config_hash", "seq", "score", "id")


@query("SELECT o_orderpriority AS hypothesis, count(*) AS n FROM orders GROUP BY 1")
def a25_ledger_count(spark, sf):
    return L.counted(results(spark, sf))


@query("SELECT min(p_partkey) AS pos, sha1(p_brand || p_type) AS config_hash FROM part WHERE sha1(p_brand || p_type) NOT IN (SELECT sha1(p_brand || p_type) FROM part WHERE p_size < 10) GROUP BY 2")
def j7_novel(spark, sf):
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.sha1(F.concat("p_brand", "p_type")).alias("config_hash"), "p_size")
    return L.novel(p.drop("p_size"), p.where("p_size < 10").drop("p_size"))


@query("""WITH c AS (SELECT p_name AS category, row_number() OVER (ORDER BY sha1(p_name)) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT p_name FROM part)) SELECT category, CASE WHEN r <= greatest(1, round_even(n * 0.2, 0)) THEN 'holdout' ELSE 'train' END AS split FROM c""")
def o5_holdout_split(spark, sf):
    return L.held_out(t(spark, sf, "part").select(F.col("p_name").alias("category")), 0.2)


@query("""SELECT 'base-r' || r || '-cur=' || c.n_name || '-v=' || v.r_name AS name, row_number() OVER (ORDER BY r, c.n_nationkey, v.r_regionkey) - 1 AS pos FROM (VALUES (8), (16), (32)) a(r), nation c, region v""")
def j10_sweep(spark, sf):
    a = spark.createDataFrame([(0, 8), (1, 16), (2, 32)], "i int, r int")
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("j"), "n_name")
    v = t(spark, sf, "region").select(F.col("r_regionkey").alias("k"), "r_name")
    name = F.concat_ws("-", F.lit("base"), L.coordinate("r", F.col("r"), True), L.coordinate("cur", F.col("n_name"), False), L.coordinate("v", F.col("r_name"), False))
    return L.sweep([a, n, v]).select(name.alias("name"), (F.col("i") * 125 + F.col("j") * 5 + F.col("k")).cast("long").alias("pos"))  # 25 nations, 5 regions


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderpriority LIKE '1%' THEN 'X1' WHEN o_orderkey % 3 = 0 THEN 'H7' WHEN o_orderstatus = 'F' THEN 'H2' ELSE 'H1' END AS hypothesis FROM orders""")
def f23_hypothesis(spark, sf):
    o = t(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), parsing.infer_hypothesis(F.when(F.col("o_orderpriority").startswith("1"), "X1").otherwise(""), F.when(F.col("o_orderkey") % 3 == 0, "sunrgbd"), F.when(F.col("o_orderstatus") == "F", "gt").otherwise("vlm")).alias("hypothesis"))


# series

def series(spark, sf):
    return t(spark, sf, "events").select(F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("loss"))


def runs(spark, sf):
    """Twenty runs, with steps counted from 0."""
    e, k = t(spark, sf, "events"), F.col("user_id") % 20
    return e.select(k.cast("string").alias("run"), (F.row_number().over(W.partitionBy(k).orderBy("event_id")) - 1).cast("long").alias("step"), F.col("value").alias("loss"))


RUNS = "s AS (SELECT CAST(user_id % 20 AS VARCHAR) AS run, value AS loss, CAST(row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS BIGINT) AS step FROM events)"
GUARD = guard.GuardConfig(tolerance=0.02, patience=5, warmup=10, most=3)


@query(f"""WITH RECURSIVE {RUNS}, f AS (
  SELECT run, step, loss, loss AS ema, loss AS best, step AS best_step, 0 AS worse, 0 AS rolled, 'new_best' AS event FROM s WHERE step = 0
  UNION ALL SELECT run, step, loss, CASE WHEN event = 'rollback' THEN best ELSE ema END, best, best_step, CASE WHEN event = 'rollback' THEN 0 ELSE worse END, CASE WHEN event = 'rollback' THEN rolled + 1 ELSE rolled END, event FROM (
    SELECT *, CASE WHEN ema < old THEN 'new_best' WHEN step < 10 OR worse < 5 THEN 'ok' WHEN rolled >= 3 THEN 'exhausted' ELSE 'rollback' END AS event FROM (
      SELECT run, step, loss, ema, old, rolled, CASE WHEN ema < old THEN ema ELSE old END AS best, CASE WHEN ema < old THEN step ELSE best_step END AS best_step,
        CASE WHEN ema < old THEN 0 WHEN step < 10 THEN worse WHEN ema > old * (1 + 0.02::DOUBLE) THEN worse + 1 ELSE 0 END AS worse FROM (
        SELECT s.run, s.step, s.loss, 0.9::DOUBLE * f.ema + (1 - 0.9::DOUBLE) * s.loss AS ema, f.best AS old, f.best_step, f.worse, f.rolled FROM f JOIN s ON s.run = f.run AND s.step = f.step + 1))))
SELECT run, step, round(ema, 6) AS ema_loss, round(best, 6) AS best_ema, best_step, worse AS worsening, rolled AS rollbacks, event FROM f""")
def t3_loss_guard(spark, sf):
    return guard.guard_batch(runs(spark, sf), GUARD).select("run", "step", *r6("ema_loss", "best_ema"), "best_step", "worsening", "rollbacks", "event")


@query("""WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS run, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT run, k, n, value AS ema FROM s WHERE k = 1 UNION ALL SELECT s.run, s.k, s.n, 0.9 * f.ema + (1 - 0.9::DOUBLE) * s.value FROM f JOIN s ON s.run = f.run AND s.k = f.k + 1) SELECT run, round(ema, 6) AS ema_loss FROM f WHERE k = n""")
def w6_running_ema(spark, sf):
    return guard.running_ema(series(spark, sf)).select("run", *r6("ema_loss"))


@query("""SELECT run, step, loss > coalesce(max(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS is_best FROM (SELECT CAST(user_id AS VARCHAR) AS run, event_id AS step, value AS loss FROM events)""")
def w7_running_best(spark, sf):
    return guard.running_best(series(spark, sf), "run", "step", "loss").select("run", "step", "is_best")


@query("""SELECT CAST(user_id AS VARCHAR) AS run, max(event_id) AS last_step, arg_max(value, event_id) AS last_loss, arg_max(value, event_id) FILTER (WHERE event_id % 3 = 0) AS last_lr FROM events GROUP BY 1""")
def s17_last_value(spark, sf):
    return guard.last_values(series(spark, sf).withColumn("lr", F.when(F.col("step") % 3 == 0, F.col("loss"))), "loss", "lr")


@query("""WITH g AS (SELECT user_id % 10 AS g, TRY_CAST(CASE WHEN event_id % 9 = 0 THEN 'n/a' ELSE CAST(event_id % 101 AS VARCHAR) END AS DOUBLE) AS u FROM events)
SELECT g, count(u) AS n, round(avg(u), 6) AS mean_util, max(u) AS max_util, avg(u) < 20 AS low FROM g WHERE u IS NOT NULL GROUP BY 1""")
def a29_gpu_util(spark, sf):
    e = t(spark, sf, "events").select((F.col("user_id") % 10).alias("g"), F.when(F.col("event_id") % 9 == 0, "n/a %").otherwise(F.concat((F.col("event_id") % 101).cast("string"), F.lit(" %"))).alias("util"))
    return readers.gpu_rows(e).groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("util_pct"), 6).alias("mean_util"), F.max("util_pct").alias("max_util"), (F.avg("util_pct") < 20).alias("low"))


from . import catalog_control, catalog_records, catalog_streams  # noqa: E402, F401

__all__ = ["QUERIES", "SQL", "ratio"]
