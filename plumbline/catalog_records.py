"""Registered queries of benchmark records, grounding, meshes and samples of clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import BOXES, EVAL, K, MESHES, PTS, PX, TIE, boxes, evalrows, images, meshes, points, px, query, r6, s6, t
from .operators import benchmark as B, cloud, compose, geometry as G, mesh, metrics as M, raster as R, shape as S
from .plans import ground

# benchmark records

RUNS = """runs AS (SELECT l_linenumber / 10.0::DOUBLE AS void_ratio, CASE WHEN l_tax > 0.07 THEN 0.0::DOUBLE ELSE l_tax END AS noise_std, CASE WHEN l_quantity > 45 THEN NULL ELSE l_extendedprice % 50 END AS z_error_cm, l_discount AS rmse_before,
  CASE WHEN l_discount > 0.08 THEN NULL ELSE l_discount * l_quantity / 50 END AS rmse_after, l_quantity / 100 AS mae_after, l_tax - l_discount AS bias_after, l_discount / 2 AS sigma_hat, l_quantity / 50 AS flag_rate, l_extendedprice / 1000 AS timing_ms FROM lineitem)"""


def runs(spark, sf):
    q, d, x, tax = (F.col(c) for c in ("l_quantity", "l_discount", "l_extendedprice", "l_tax"))
    nan = F.lit(float("nan"))
    return t(spark, sf, "lineitem").select(
        (F.col("l_linenumber") / 10.0).alias("void_ratio"), F.when(tax > 0.07, 0.0).otherwise(tax).alias("noise_std"), F.when(q > 45, nan).otherwise(x % 50).alias("z_error_cm"), d.alias("rmse_before"),
        F.when(d > 0.08, nan).otherwise(d * q / 50).alias("rmse_after"), (q / 100).alias("mae_after"), (tax - d).alias("bias_after"), (d / 2).alias("sigma_hat"), (q / 50).alias("flag_rate"), (x / 1000).alias("timing_ms"),
    )


CELLS = ("z_error_cm", "rmse_before", "rmse_after", "mae_after", "bias_after", "sigma_rel_err", "flag_rate", "timing_ms")


@query(f"""WITH {RUNS}, m AS (SELECT *, CASE WHEN noise_std > 0 THEN abs(sigma_hat - noise_std) / noise_std END AS sigma_rel_err FROM runs),
c AS (SELECT void_ratio, noise_std, {', '.join(f"coalesce(median({c}), 'nan'::DOUBLE) AS {c}" for c in CELLS)} FROM m GROUP BY 1, 2)
SELECT void_ratio, noise_std, {', '.join(f'round({c} + 1e-11, 6) AS {c}' for c in CELLS)}, CASE WHEN rmse_after = 0 OR isnan(rmse_after) OR isnan(rmse_before) THEN 'nan'::DOUBLE ELSE round(rmse_before / rmse_after + 1e-11, 6) END AS rmse_ratio FROM c""")
def a13_sweep_record(spark, sf):
    return B.sweep_record(runs(spark, sf)).select("void_ratio", "noise_std", *s6(*CELLS, "rmse_ratio"))


@query("""WITH s AS (SELECT l_linenumber / 10.0::DOUBLE AS void_ratio, l_tax AS noise_std, CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity / 50 END AS precision, l_discount * 10 AS recall, l_extendedprice % 1 AS f1, 1 - l_discount AS retention FROM lineitem)
SELECT void_ratio, noise_std, round(coalesce(median(precision), 'nan'::DOUBLE) + 1e-11, 6) AS precision, round(median(recall) + 1e-11, 6) AS recall, round(median(f1) + 1e-11, 6) AS f1, round(median(retention) + 1e-11, 6) AS retention FROM s GROUP BY 1, 2""")
def a14_outlier_record(spark, sf):
    q = F.col("l_quantity")
    s = t(spark, sf, "lineitem").select((F.col("l_linenumber") / 10.0).alias("void_ratio"), F.col("l_tax").alias("noise_std"), F.when(q > 40, float("nan")).otherwise(q / 50).alias("precision"), (F.col("l_discount") * 10).alias("recall"), (F.col("l_extendedprice") % 1).alias("f1"), (1 - F.col("l_discount")).alias("retention"))
    return B.outlier_record(s).select("void_ratio", "noise_std", *s6("precision", "recall", "f1", "retention"))


@query("SELECT count(*) AS n, round(avg(CASE WHEN contains(lower(p_name), lower(CASE WHEN p_size % 2 = 0 THEN upper(substr(p_name, 2, 4)) ELSE p_brand END)) THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS accuracy FROM part")
def a15_shape_accuracy(spark, sf):
    expected = F.when(F.col("p_size") % 2 == 0, F.upper(F.substring("p_name", 2, 4))).otherwise(F.col("p_brand"))
    return B.shape_accuracy(t(spark, sf, "part").select(F.col("p_name").alias("predicted"), expected.alias("expected"))).select("n", *r6("accuracy"))


@query("""SELECT shape, expected, predicted FROM (VALUES ('ball (1.0,)', 'sphere-like', 'sphere-like'), ('ball (0.5,)', 'sphere-like', 'sphere-like'), ('box (1, 1, 1)', 'box-like / compact', 'box-like / compact'), ('box (1, 2, 1)', 'box-like / compact', 'irregular / mixed geometry'),
  ('tube (0.1, 5.0)', 'elongated', 'elongated'), ('tube (0.2, 4.0)', 'elongated', 'elongated')) r(shape, expected, predicted)""")
def a15_shapes(spark, sf):
    return B.shapes(spark).select("shape", "expected", "predicted")


@query("SELECT v.i * 20 + n.i * 5 + s.i AS cell, v.x AS void_ratio, n.x AS noise_std, s.i AS seed FROM (VALUES (0, 0.1::DOUBLE), (1, 0.3::DOUBLE), (2, 0.5::DOUBLE), (3, 0.7::DOUBLE), (4, 0.85::DOUBLE)) v(i, x), (VALUES (0, 0.005::DOUBLE), (1, 0.015::DOUBLE), (2, 0.03::DOUBLE), (3, 0.05::DOUBLE)) n(i, x), range(5) s(i)")
def j11_grid(spark, sf):
    return B.cross(spark, void_ratio=B.VOIDS, noise_std=B.NOISES, seed=[*range(B.SEEDS)]).select("cell", "void_ratio", "noise_std", "seed")


@query("SELECT l_returnflag AS g, round(CASE WHEN sqrt(avg(l_tax * l_tax)) = 0 THEN 'nan'::DOUBLE ELSE sqrt(avg(l_discount * l_discount)) / sqrt(avg(l_tax * l_tax)) END, 6) AS ratio FROM lineitem GROUP BY 1")
def a2_rmse_ratio(spark, sf):
    e = lambda c: M.error_measures(F.col(c), F.lit(0.0), F.lit(True))["rmse"]
    g = t(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(e("l_discount").alias("before"), e("l_tax").alias("after"))
    return g.select("g", F.round(B.rmse_ratio(F.col("before"), F.col("after")), 6).alias("ratio"))


@query("SELECT l_orderkey AS o, l_linenumber AS l, CASE WHEN l_tax > 0 THEN round(abs(l_discount - l_tax) / l_tax + 1e-11, 6) ELSE 'nan'::DOUBLE END AS e FROM lineitem")
def a5_sigma_error(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.round(B.sigma_error(F.col("l_discount"), F.col("l_tax")) + TIE, 6).alias("e"))


@query("SELECT l_orderkey AS o, l_linenumber AS l, CASE WHEN l_quantity > 45 THEN 'nan'::DOUBLE ELSE round(abs(l_tax - l_discount) * 100 + 1e-11, 6) END AS e FROM lineitem")
def a6_z_error(spark, sf):
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l"), F.round(G.z_error_cm(F.when(F.col("l_quantity") <= 45, F.col("l_tax")), F.col("l_discount")) + TIE, 6).alias("e"))


@query(f"WITH {PX} SELECT frame_id, round(median(depth) FILTER (WHERE depth > 0) + 1e-11, 6) AS z_true FROM px GROUP BY 1")
def a19_true_z(spark, sf):
    return B.true_z(px(spark, sf)).select("frame_id", *s6("z_true"))


@query(f"WITH {PX} SELECT frame_id, round(quantile_cont(depth, 0.02) FILTER (WHERE depth > 0) + 1e-11, 6) AS lo, round(quantile_cont(depth, 0.98) FILTER (WHERE depth > 0) + 1e-11, 6) AS hi FROM px GROUP BY 1")
def a21_colour_limits(spark, sf):
    return B.colour_limits(px(spark, sf), "depth").select("frame_id", *s6("lo", "hi"))


INSTANCES = "inst AS (SELECT event_id // 10000 AS frame_id, CAST((event_id % 10000) // 100 AS INTEGER) AS v, CAST(event_id % 100 AS INTEGER) AS u, CAST(CASE WHEN event_type = 'purchase' AND user_id % 7 = 0 THEN user_id % 50 ELSE 0 END AS INTEGER) AS instance FROM events)"


def instances(spark, sf):
    i = F.col("event_id")
    seen = F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 7 == 0), F.col("user_id") % 50).otherwise(0).cast("int")
    return t(spark, sf, "events").select(F.floor(i / 10000).alias("frame_id"), F.floor((i % 10000) / 100).cast("int").alias("v"), (i % 100).cast("int").alias("u"), seen.alias("instance"))


@query(f"""WITH {INSTANCES}, b AS (SELECT frame_id, instance, min(u) AS x_min, min(v) AS y_min, max(u) + 1 AS x_max, max(v) + 1 AS y_max FROM inst WHERE instance > 0 GROUP BY 1, 2)
SELECT f.frame_id, b.instance, coalesce(x_min, 0) AS x_min, coalesce(y_min, 0) AS y_min, coalesce(x_max, 8) AS x_max, coalesce(y_max, 8) AS y_max FROM (SELECT DISTINCT frame_id FROM inst) f LEFT JOIN b USING (frame_id)""")
def a23_instance_boxes(spark, sf):
    return G.instance_boxes(instances(spark, sf))


@query(f"WITH {INSTANCES} SELECT f.frame_id, o.place FROM (SELECT DISTINCT frame_id FROM inst) f, range(60) o(place) WHERE EXISTS (SELECT 1 FROM inst i WHERE i.frame_id = f.frame_id AND i.instance = o.place + 1)")
def a24_visible(spark, sf):
    seen = instances(spark, sf)
    objects = seen.select("frame_id").distinct().select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("place"))
    return compose.visible(seen, objects).select("frame_id", F.col("place").cast("long").alias("place"))


# grounding

FOUND = BOXES + f""", req AS (SELECT box_id AS req_id, frame_id, CASE WHEN box_id % 4 > 0 THEN least(x_min, 100) END AS x_min, CASE WHEN box_id % 4 > 0 THEN least(y_min, 100) END AS y_min, CASE WHEN box_id % 4 > 0 THEN least(x_max, 100) END AS x_max,
  CASE WHEN box_id % 4 > 0 THEN least(y_max, (SELECT max(v) + 1 FROM px WHERE px.frame_id = boxes.frame_id)) END AS y_max, x_min AS gx0, y_min AS gy0, x_max AS gx1, y_max AS gy1 FROM boxes WHERE y_min < (SELECT max(v) + 1 FROM px WHERE px.frame_id = boxes.frame_id)), z AS (
  SELECT req_id, median(depth) AS z_est, min(depth) AS z_min, max(depth) AS z_max FROM req r JOIN px ON px.frame_id = r.frame_id AND u >= x_min AND u < x_max AND v >= y_min AND v < y_max AND depth > 0 GROUP BY req_id),
ans AS (SELECT r.*, z_est, z_min, z_max, CASE WHEN x_min IS NULL THEN 'vlm_detection_failed' WHEN z_est IS NULL THEN 'geometric_lift_failed' END AS error FROM req r LEFT JOIN z USING (req_id)),
ext AS (SELECT *, {', '.join(f"{f}(({a} - 50.0) * z_min / 80.0, ({a} - 50.0) * z_max / 80.0, ({b} - 50.0) * z_min / 80.0, ({b} - 50.0) * z_max / 80.0) AS {c}_{n}" for c, a, b in (('x', 'x_min', 'x_max'), ('y', 'y_min', 'y_max')) for n, f in (('lo', 'least'), ('hi', 'greatest')))} FROM ans)"""


def requests(spark, sf):
    """A question for each part's box, of which a model misses every fourth; the truth is the box at 2.0 to 2.5."""
    frames = images(spark, sf)
    b = boxes(spark, sf).join(frames.select("frame_id", "h"), "frame_id").where("y_min < h").drop("h")
    said = F.when(F.col("box_id") % 4 > 0, F.to_json(F.struct(F.array("x_min", "y_min", "x_max", "y_max").alias("bbox_2d")))).otherwise(F.lit("{}"))
    corner = lambda x, y, z: F.array(*((c.cast("double") - 50.0) * z / 80.0 for c in (x, y)), F.lit(z))
    truth = F.array(*(corner(F.col(x), F.col(y), z) for z in (2.0, 2.5) for y in ("y_min", "y_max") for x in ("x_min", "x_max")))
    return frames, b.select(
        F.col("box_id").alias("req_id"), "frame_id", F.concat(F.lit("box "), "box_id").alias("query"), F.lit(100).alias("width"), F.lit(100).alias("height"), said.alias("meta"), F.lit("c").alias("category"), F.lit("train").alias("split"), F.lit("s").alias("source"),
        F.lit(0.0).alias("severity"), F.array(F.col("x_min") + 3, F.col("y_min"), F.col("x_max") + 3, F.col("y_max")).alias("bbox_2d"), truth.alias("aabb_3d"),
    )


@query(f"WITH {PX}, {FOUND} SELECT req_id, 'box ' || req_id AS query, error IS NULL AS success, error, x_min, y_min, x_max, CAST(y_max AS INTEGER) AS y_max, round(z_est + 1e-11, 6) AS z_est, round(z_min + 1e-11, 6) AS z_min, round(z_max + 1e-11, 6) AS z_max FROM ans")
def c11_grounded(spark, sf):
    frames, asked = requests(spark, sf)
    rows = ground.grounded(asked, frames, ground.ground_truth, K, ground.naive)
    return rows.select("req_id", "query", "success", "error", "x_min", "y_min", "x_max", "y_max", *s6("z_est", "z_min", "z_max"))


@query(f"""WITH {PX}, {FOUND}, truth AS (SELECT *, 2.0::DOUBLE AS gz0, 2.5::DOUBLE AS gz1, {', '.join(f"{f}(({a} - 50.0) * 2.0 / 80.0, ({a} - 50.0) * 2.5 / 80.0, ({b} - 50.0) * 2.0 / 80.0, ({b} - 50.0) * 2.5 / 80.0) AS t{c}_{n}" for c, a, b in (('x', 'gx0', 'gx1'), ('y', 'gy0', 'gy1')) for n, f in (('lo', 'least'), ('hi', 'greatest')))} FROM ext), v AS (
  SELECT *, greatest(0.0, least(x_hi, tx_hi) - greatest(x_lo, tx_lo)) * greatest(0.0, least(y_hi, ty_hi) - greatest(y_lo, ty_lo)) * greatest(0.0, least(z_max, gz1) - greatest(z_min, gz0)) AS inter,
    (x_hi - x_lo) * (y_hi - y_lo) * (z_max - z_min) + (tx_hi - tx_lo) * (ty_hi - ty_lo) * 0.5::DOUBLE AS total FROM truth)
SELECT req_id, CASE WHEN x_min IS NULL THEN 0.0 ELSE round(CAST((gx1 - gx0 - 3) AS DOUBLE) / (gx1 - gx0 + 3) + 1e-11, 6) END AS iou_2d, CASE WHEN error IS NULL THEN round(abs(z_est - 2.25::DOUBLE) * 100 + 1e-11, 6) ELSE 'nan'::DOUBLE END AS z_err_cm,
  CASE WHEN error IS NULL AND total - inter > 0 THEN round(inter / (total - inter) + 1e-11, 5) ELSE 0.0 END AS iou_3d, error IS NULL AS success FROM v""")
def a33_evaluation_rows(spark, sf):
    frames, asked = requests(spark, sf)
    rows = ground.evaluated(asked, frames, ground.ground_truth, K, "naive")
    return rows.select("req_id", *s6("iou_2d", "z_err_cm"), F.round(F.col("iou_3d") + TIE, 5).alias("iou_3d"), "success")


@query(f"""WITH {EVAL} SELECT detector, lifter, count(*) AS n, round(coalesce(median(z_err_cm) FILTER (WHERE success), 'nan'::DOUBLE) + 1e-11, 6) AS z FROM evalrows GROUP BY 1, 2""")
def j12_lifters(spark, sf):
    """Every sample under each lifter."""
    names = spark.createDataFrame([(n,) for n in ("naive", "robust")], "lifter string")
    rows = evalrows(spark, sf).join(F.broadcast(names), "lifter")  # two names
    return rows.groupBy("detector", "lifter").agg(F.count("*").alias("n"), F.round(B.known_median(F.when(F.col("success"), F.col("z_err_cm"))) + TIE, 6).alias("z"))


@query(f"""WITH {PX}, {FOUND} SELECT req_id, lifter, CASE WHEN x_min IS NULL THEN 0.0 ELSE round(CAST((gx1 - gx0 - 3) AS DOUBLE) / (gx1 - gx0 + 3) + 1e-11, 6) END AS iou_2d, x_min IS NOT NULL AS found FROM ext, (VALUES ('naive'), ('full')) l(lifter)""")
def j12_both(spark, sf):
    """Every request under both lifters, from boxes that a model gave once: the model is loaded by each worker and asked in batches."""
    frames, asked = requests(spark, sf)
    model = ground.served(lambda: lambda prompts: [p.rpartition("#")[2] for p in prompts], 64)
    wide = F.lit(10_000)  # boxes beyond their image are cut to it, not read as shares of it
    said = asked.withColumns({"query": F.concat_ws("#", "query", "meta"), "width": wide, "height": wide})
    answer = ground.answered(lambda d: model(d.withColumn("prompt", F.col("query"))))
    rows = ground.evaluated(said, frames, answer, K, "both")
    return rows.select("req_id", "lifter", *s6("iou_2d"), (F.col("iou_2d") > 0).alias("found"))


# clouds and meshes

@query(f"""WITH {PTS}, d AS (SELECT a.cloud_id, a.pt_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)) AS d FROM pts a JOIN pts b ON a.cloud_id = b.cloud_id AND a.pt_id <> b.pt_id GROUP BY 1, 2)
SELECT cloud_id, round(avg(d) + 1e-11, 6) AS mean_nn FROM d GROUP BY 1""")
def m4_neighbour_distance(spark, sf):
    return cloud.neighbour_distances(points(spark, sf)).select("cloud_id", *s6("mean_nn"))


@query(f"""WITH {PTS}, d AS (SELECT a.cloud_id, a.pt_id, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d, row_number() OVER (PARTITION BY a.cloud_id, a.pt_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS r
  FROM pts a JOIN pts b ON a.cloud_id = b.cloud_id AND a.pt_id <> b.pt_id), m AS (SELECT cloud_id, pt_id, avg(d) AS m FROM d WHERE r <= 20 GROUP BY 1, 2), l AS (SELECT cloud_id, avg(m) + 1.5 * stddev_samp(m) AS lim FROM m GROUP BY 1)
SELECT m.cloud_id, count(*) AS n, count(*) FILTER (WHERE m <= lim) AS kept FROM m JOIN l USING (cloud_id) GROUP BY 1""")
def m3_unstrayed(spark, sf):
    p = points(spark, sf)
    kept = cloud.unstrayed(p, 20, 1.5).groupBy("cloud_id").agg(F.count("*").alias("kept"))
    return p.groupBy("cloud_id").agg(F.count("*").alias("n")).join(kept, "cloud_id").select("cloud_id", "n", "kept")


def clouds(spark, sf):
    p = points(spark, sf).groupBy("cloud_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pt_id", F.array("x", "y", "z").alias("p")))), lambda c: c["p"]).alias("points"))
    return p.withColumn("cloud_id", F.col("cloud_id").cast("long"))


@query("""WITH n AS (SELECT p_partkey AS id, p_size / 400.0::DOUBLE AS nn, 1 + p_size / 10.0::DOUBLE AS d FROM part)
SELECT DISTINCT id, unnest(list_transform([greatest(nn * 3, 0.05), greatest(nn * 6, 0.05), greatest(nn * 12, 0.05), greatest(nn * 24, 0.05), greatest(nn * 30, 0.05), d * 0.25, d * 0.35, d * 0.5, d * 0.75], lambda x: round(x, 9))) AS radius FROM n""")
def m6_alpha_candidates(spark, sf):
    nn, d = F.col("p_size") / 400.0, 1 + F.col("p_size") / 10.0
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.explode(S.alpha_candidates(nn, d)).alias("radius")).select("id", F.round("radius", 9).alias("radius")).distinct()


#: Meshes that lack a face, that have one turned round, and that share a vertex with a copy of themselves.
FACES = """tri AS (SELECT mesh_id, fid, i, CASE WHEN mesh_id % 5 = 1 AND fid = 4 THEN k ELSE j END AS j, CASE WHEN mesh_id % 5 = 1 AND fid = 4 THEN j ELSE k END AS k FROM box, face WHERE NOT (mesh_id % 5 = 0 AND fid = 11)
  UNION ALL SELECT mesh_id, fid + 12, CASE WHEN i = 0 THEN 0 ELSE i + 8 END, CASE WHEN j = 0 THEN 0 ELSE j + 8 END, CASE WHEN k = 0 THEN 0 ELSE k + 8 END FROM box, face WHERE mesh_id % 5 = 2)"""


@query(f"""WITH RECURSIVE {MESHES.rpartition("tri AS")[0].rstrip().rstrip(",")}, {FACES}, e AS (SELECT mesh_id, i AS a, j AS b FROM tri UNION ALL SELECT mesh_id, j, k FROM tri UNION ALL SELECT mesh_id, k, i FROM tri),
u AS (SELECT mesh_id, least(a, b) AS a, greatest(a, b) AS b, count(*) AS n, sum(sign(b - a)) AS way FROM e GROUP BY 1, 2, 3), c AS (SELECT mesh_id, bool_and(n = 2 AND way = 0) AS closed FROM u GROUP BY 1),
s AS (SELECT mesh_id, i AS v, j AS a, k AS b FROM tri UNION ALL SELECT mesh_id, j, k, i FROM tri UNION ALL SELECT mesh_id, k, i, j FROM tri), d AS (SELECT mesh_id, v, count(*) AS n, count(DISTINCT a) AS na, min(a) AS first FROM s GROUP BY 1, 2),
walk AS (SELECT mesh_id, v, first AS at FROM d UNION SELECT w.mesh_id, w.v, s.b FROM walk w JOIN s ON s.mesh_id = w.mesh_id AND s.v = w.v AND s.a = w.at),
f AS (SELECT mesh_id, bool_and(n = na AND n = met) AS fan FROM d JOIN (SELECT mesh_id, v, count(DISTINCT walk.at) AS met FROM walk JOIN s USING (mesh_id, v) WHERE s.a = walk.at GROUP BY 1, 2) m USING (mesh_id, v) GROUP BY 1)
SELECT mesh_id, closed AND fan AS closed FROM c JOIN f USING (mesh_id)""")
def m11_watertight(spark, sf):
    f = meshes(spark, sf)[1].where("NOT (mesh_id % 5 = 0 AND fid = 11)")
    turned = (F.col("mesh_id") % 5 == 1) & (F.col("fid") == 4)
    f = f.withColumns({"j": F.when(turned, F.col("k")).otherwise(F.col("j")), "k": F.when(turned, F.col("j")).otherwise(F.col("k"))})
    copy = f.where("mesh_id % 5 = 2").withColumns({"fid": F.col("fid") + 12, **{c: F.when(F.col(c) > 0, F.col(c) + 8).otherwise(0) for c in "ijk"}})
    return S.watertight(f.unionByName(copy))


@query("""WITH d AS (SELECT p_partkey AS mesh_id, p_retailprice / 1000 AS volume, p_retailprice / 100 AS area, CASE WHEN p_size % 4 = 0 THEN 'nan'::DOUBLE ELSE p_size / 60.0::DOUBLE END AS c, 1 + p_size / 20.0::DOUBLE AS ar, p_size * 1000 AS nv, CASE WHEN p_size % 9 = 0 THEN 0 ELSE p_size * 2000 END AS nf FROM part),
l AS (SELECT *, CASE WHEN nf = 0 THEN 'unknown (no mesh)' WHEN isnan(c) THEN 'unknown (non-watertight)' WHEN c > 0.85 THEN 'sphere-like' WHEN c > 0.5 AND ar < 1.5 THEN 'box-like / compact' WHEN ar > 3 THEN 'elongated' WHEN c < 0.3 AND ar < 2 THEN 'organic / complex surface (animal, plant, etc.)' WHEN ar > 2 THEN 'elongated' ELSE 'irregular / mixed geometry' END AS label FROM d)
SELECT mesh_id, 'Shape classification: ' || label || chr(10) || printf('  Volume           : %.6f m^3', volume + 1e-11::DOUBLE) || chr(10) || printf('  Surface area     : %.4f m^2', area + 1e-11::DOUBLE) || chr(10) || '  Compactness      : ' || CASE WHEN isnan(c) THEN 'nan' ELSE printf('%.4f', c + 1e-11::DOUBLE) END || chr(10)
  || printf('  Aspect ratio     : %.2f', ar + 1e-11::DOUBLE) || chr(10) || '  Convex-hull ratio: nan' || chr(10) || '  Mesh complexity  : ' || format('{:,}', nv) || ' verts, ' || format('{:,}', nf) || ' faces' AS text FROM l""")
def m13_shape_text(spark, sf):
    k, nan = F.col("p_size"), float("nan")
    d = t(spark, sf, "part").select(
        F.col("p_partkey").alias("mesh_id"), (F.col("p_retailprice") / 1000 + TIE).alias("volume"), (F.col("p_retailprice") / 100 + TIE).alias("surface_area"), F.when(k % 4 == 0, nan).otherwise(k / 60.0 + TIE).alias("compactness"), (1 + k / 20.0 + TIE).alias("aspect_ratio"),
        F.lit(nan).alias("convex_hull_ratio"), (k * 1000).alias("n_vertices"), F.when(k % 9 == 0, 0).otherwise(k * 2000).alias("n_faces"),
    )
    return d.select("mesh_id", mesh.shape_text(mesh.mesh_label()).alias("text"))


@query()
def m7_meshes(spark, sf):
    """Alpha shapes of the clouds, cut down to 200 faces."""
    return mesh.reconstructed(clouds(spark, sf), 0.0, 200).select("cloud_id", "n_points", F.size("vertices").alias("n_vertices"), F.size("triangles").alias("n_faces"))


@query()
def p36_frames(spark, sf):
    """Composed frames, one for each hundredth part: target, query, truth and corruption."""
    from .operators.scene import Camera

    n = max(1, t(spark, sf, "part").count() // 100)
    return compose.frames(spark, n, Camera(48, 64), 7).select("frame_id", "category", "query_text", "bbox_2d", "split", F.col("corruption_params.edge_bleed_px").alias("bleed"), F.size(F.filter("corrupted", lambda d: d > 0)).alias("n_valid"))


@query()
def d1_analysed(spark, sf):
    """The whole analysis of each frame, with the reading of its shape."""
    return ground.analysed(images(spark, sf), K).select("frame_id", *r6("z_true", "z_est"), "n_outliers", "n_points", "n_vertices", "n_faces", "label", F.size("embedding").alias("n"))


HASH = "md5('{seed}|' || cloud_id || '|' || pt_id)"
UNIT = lambda d, at: f"(CAST('0x' || substr({d}, {at}, 11) AS BIGINT) + 1) / 17592186044416.0::DOUBLE"


@query(f"WITH {PTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {HASH.format(seed=5)}, pt_id) AS r FROM pts) SELECT cloud_id, pt_id FROM r WHERE r <= 20")
def o13_subset(spark, sf):
    return compose.subsample(points(spark, sf), 20, 5).select("cloud_id", "pt_id")


@query(f"WITH {PTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY pt_id) - 1 AS r, count(*) OVER (PARTITION BY cloud_id) AS n FROM pts) SELECT cloud_id, pt_id FROM r WHERE r % greatest(1, n // least(n, 15)) = 0")
def p34_strided(spark, sf):
    return compose.strided(points(spark, sf), 15).select("cloud_id", "pt_id")


AXIS = lambda d: f"sqrt(-2 * ln({UNIT(d, 11)})) * cos(2 * pi() * {UNIT(d, 22)})"


@query(f"""WITH {PTS}, h AS (SELECT *, {', '.join(f"{HASH.format(seed=n + 4)} AS h{c}" for n, c in enumerate('xyz'))}, md5('3|' || cloud_id) AS hc FROM pts), a AS (SELECT *, {UNIT('hc', 1)} * 2 * pi() AS angle, 0.8::DOUBLE + (1.2::DOUBLE - 0.8::DOUBLE) * {UNIT('hc', 12)} AS f FROM h)
SELECT cloud_id, pt_id, round((cos(angle) * x - sin(angle) * y + 0.01::DOUBLE * {AXIS('hx')}) * f, 6) AS x, round((sin(angle) * x + cos(angle) * y + 0.01::DOUBLE * {AXIS('hy')}) * f, 6) AS y, round((z + 0.01::DOUBLE * {AXIS('hz')}) * f, 6) AS z FROM a""")
def p33_augmented(spark, sf):
    return compose.augmented(points(spark, sf), 3).select("cloud_id", "pt_id", *r6("x", "y", "z"))


@query(f"""WITH {PTS}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY {HASH.format(seed=2)}, pt_id) AS r FROM pts) WHERE r <= 25),
f AS (SELECT *, y + (2 * {UNIT(HASH.format(seed=3), 1)} - 1) * 0.06::DOUBLE AS fy FROM s) SELECT cloud_id, pt_id, CAST(row_number() OVER (PARTITION BY cloud_id ORDER BY fy DESC, pt_id) AS INTEGER) AS place FROM f""")
def p37_fuzzy_order(spark, sf):
    return compose.fuzzy_order(points(spark, sf), 25, 2).select("cloud_id", "pt_id", "place")


@query(f"""WITH {PTS}, m AS (SELECT cloud_id, median(z) AS m FROM pts GROUP BY 1) SELECT cloud_id, pt_id, CASE WHEN pt_id % 3 = 0 THEN round(m + (z - m) * (1.2::DOUBLE + (2.8::DOUBLE - 1.2::DOUBLE) * {UNIT(HASH.format(seed=6), 1)}) + 1e-11, 6) END AS spike FROM pts JOIN m USING (cloud_id)""")
def p38_spiked(spark, sf):
    return compose.spiked(points(spark, sf), F.col("pt_id") % 3 == 0, 6).select("cloud_id", "pt_id", *s6("spike"))


DISC = "(VALUES (-2, 0), (-1, -2), (-1, -1), (-1, 0), (-1, 1), (-1, 2), (0, -2), (0, -1), (0, 0), (0, 1), (0, 2), (1, -2), (1, -1), (1, 0), (1, 1), (1, 2), (2, 0))"


@query(f"""WITH {PX}, big AS (SELECT DISTINCT a.frame_id, a.v + i AS v, a.u + j AS u FROM px a, {DISC} d(i, j) WHERE a.depth > 0), grown AS (SELECT p.* FROM px p JOIN big USING (frame_id, v, u)),
lost AS (SELECT DISTINCT p.frame_id, p.v - i AS v, p.u - j AS u FROM px p, {DISC} d(i, j) WHERE NOT EXISTS (SELECT 1 FROM grown g WHERE g.frame_id = p.frame_id AND g.v = p.v AND g.u = p.u)),
shut AS (SELECT p.* FROM px p WHERE NOT EXISTS (SELECT 1 FROM lost l WHERE l.frame_id = p.frame_id AND l.v = p.v AND l.u = p.u)),
new AS (SELECT a.frame_id, a.v, a.u, avg(b.depth) AS fill FROM shut a JOIN px b ON a.depth <= 0 AND b.depth > 0 AND b.frame_id = a.frame_id AND b.v BETWEEN a.v - 5 AND a.v + 5 AND b.u BETWEEN a.u - 5 AND a.u + 5 GROUP BY 1, 2, 3)
SELECT p.frame_id, p.v, p.u, round(coalesce(n.fill, p.depth) + 1e-11, 6) AS depth FROM px p LEFT JOIN new n ON n.frame_id = p.frame_id AND n.v = p.v AND n.u = p.u""")
def p11_closed(spark, sf):
    closed = R.closed_pixels(px(spark, sf))
    return closed.select("frame_id", "v", "u", F.round(F.col("closed") + TIE, 6).alias("depth"))
