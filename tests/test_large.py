"""Joins that must not send a table whole: Spark guesses the size of exploded rows by the file below them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.catalog import QUERIES, meshes
from plumbline.operators import scene

SF = "/root/testdata/sf0.001"


def sent(spark, name):
    """The plan's broadcasts once it has run, with the bound of the guess where Spark has it by itself."""
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    df = QUERIES[name](spark, SF)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_shape_descriptors_send_no_table(spark):
    assert sent(spark, "m10_shape_descriptors") == 0


def test_surface_samples_send_no_table(spark):
    assert sent(spark, "m9_surface_samples") == 0


def test_scenes_send_no_table(spark):
    assert sent(spark, "p31_rendered") == 0


def test_scenes_are_spread(spark):
    """The few bytes of many scenes stay in as many tasks as shuffles have."""
    v, f = meshes(spark, SF)
    objects = v.select((F.col("mesh_id") % 40).alias("frame_id"), "mesh_id").distinct().select("*", F.floor(F.col("mesh_id") / 40).cast("int").alias("place"), F.array(*[F.lit(0.5)] * 3).alias("colour"))
    tasks = scene.render(scene.scenes(objects, v, f), scene.Camera(2, 2)).select(F.spark_partition_id().alias("task")).distinct().count()
    assert tasks == 4


def by_triangles(rays, eye, corners):
    best, which = np.full(len(rays), np.inf), np.full(len(rays), -1)
    for n, d in enumerate(rays):
        for k, (a, b, c) in enumerate(corners):
            m = np.stack([b - a, c - a, -d], 1)
            if abs(np.linalg.det(m)) > 1e-12:
                i, j, t = np.linalg.solve(m, eye - a)
                if i >= 0 and j >= 0 and i + j <= 1 and 0 < t < best[n] - 1e-9:
                    best[n], which[n] = t, k
    return best, which


@pytest.mark.parametrize("pairs", [1, 100, 1 << 16])
def test_cast_equals_plain_solutions(monkeypatch, pairs):
    """Triangles in blocks of any size, with copies (the first wins), some without area and some behind the eye."""
    monkeypatch.setattr(scene, "PAIRS", pairs)
    r = np.random.default_rng(5)
    corners = r.normal(0, 2, (40, 3, 3)) + (0, 0, 4)
    corners = np.concatenate([corners, corners[:7], np.repeat(corners[:2, :1], 3, 1), -corners[:3]])
    rays = scene.Camera(5, 6, 60.0, (0.0, 0.0, 0.0), (0.0, 0.0, 1.0)).rays().reshape(-1, 3)
    (t, k), (want_t, want_k) = scene.cast(rays, np.zeros(3), corners), by_triangles(rays, np.zeros(3), corners)
    assert (k == want_k).all() and (k >= 0).sum() > 10 and np.allclose(t, want_t)
    assert all((x == y).all() for x, y in zip(scene.cast(rays, np.zeros(3), corners[:0]), (np.inf, -1), strict=True))
