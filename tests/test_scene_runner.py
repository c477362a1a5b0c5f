"""Rendered scenes and the loop over a queue."""

import numpy as np
import pytest

from plumbline.operators import scene
from plumbline.plans import runner

QUEUE = "pos int, name string, kind string, config string, requires array<string>, status string, retries int, max_retries int, owner string, heartbeat double"
AHEAD = scene.Camera(20, 30, 60.0, (0.0, 0.0, 0.0), (0.0, 0.0, 1.0))


def entries(spark, *rows):
    return spark.createDataFrame([(i, n, kind, "{}", needs, "pending", 0, 1, None, None) for i, (n, kind, needs) in enumerate(rows)], QUEUE)


def states(queue):
    return {r["name"]: (r.status, r.retries) for r in queue.collect()}


def quad(z, side):
    a, b, c, d = (-side, -side, z), (side, -side, z), (side, side, z), (-side, side, z)
    return np.ravel([(a, b, c), (a, c, d)]).tolist()


def test_nearest_object_is_seen(spark):
    rows = [(1, quad(4.0, 9.0) + quad(2.0, 0.5), [0, 0, 1, 1], [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]), (2, [], [], [])]
    got = {r.frame_id: r for r in scene.render(spark.createDataFrame(rows, "frame_id long, corners array<double>, owner array<int>, colours array<double>"), AHEAD).collect()}
    depth, inst = (np.array(got[1][c]).reshape(20, 30) for c in ("depth", "instance"))
    fx, fy, cx, cy = AHEAD.intrinsics
    v, u = np.mgrid[:20, :30] + 0.5
    near = (abs((u - cx) / fx * 2) <= 0.5) & (abs((v - cy) / fy * 2) <= 0.5)
    assert near.any() and np.allclose(depth, np.where(near, 2, 4), atol=1e-5) and (inst == np.where(near, 2, 1)).all()
    rgb = np.frombuffer(got[1].rgb, np.uint8).reshape(20, 30, 3)
    assert (rgb[near][:, [0, 2]] == 0).all() and (rgb[~near][:, 1:] == 0).all()
    assert not any(got[2].depth) and set(got[2].rgb) == {int(0.85 * 255)}


def test_hits_lie_on_a_sphere():
    n = 24
    a, b = np.meshgrid(np.linspace(0, np.pi, n), np.linspace(0, 2 * np.pi, 2 * n), indexing="ij")
    p = np.stack([np.sin(a) * np.cos(b), np.cos(a), np.sin(a) * np.sin(b)], -1) + (0, 0, 5)
    quads = np.stack([p[:-1, :-1], p[1:, :-1], p[1:, 1:], p[:-1, 1:]], 2).reshape(-1, 4, 3)
    rays = AHEAD.rays()
    t, k = scene.cast(rays, np.zeros(3), np.concatenate([quads[:, [0, 1, 2]], quads[:, [0, 2, 3]]]))
    d = rays.reshape(-1, 3)
    q, m = (d * d).sum(1), d @ (0, 0, 5)
    root = m * m - q * 24
    inside = root > 0.2  # at most 1, in the middle
    exact = (m - np.sqrt(np.maximum(root, 0))) / q
    assert inside.sum() > 20 and (k[inside] >= 0).all() and abs(t[inside] - exact[inside]).max() < 0.05 and (k[root < 0] < 0).all()


def test_camera_boxes(spark):
    c = scene.Camera(4, 4)
    p = np.random.default_rng(1).normal(size=(9, 3))
    row = scene.camera_boxes(spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(p)], "mesh_id long, vid int, x double, y double, z double"), c).first()
    want = (p - c.eye) @ c.axes.T
    assert np.allclose([row.x_lo, row.y_lo, row.z_lo], want.min(0)) and np.allclose([row.x_hi, row.y_hi, row.z_hi], want.max(0))
    assert np.allclose(c.axes @ c.axes.T, np.eye(3)) and np.isclose(np.linalg.det(c.axes), 1)


def test_queue_is_worked_off(spark):
    ran = []

    def job(e):
        ran.append(e["name"])
        if e["name"] == "bad":
            raise RuntimeError("crash")
        return "completed"

    q = entries(spark, ("b", "train", ["a"]), ("a", "train", []), ("bad", "train", []), ("after", "train", ["bad"]), ("odd", "unknown", []))
    code, end = runner.run(q, {"train": job}, "me", 60.0, now=lambda: 1.0)
    assert code == runner.DRAINED and ran == ["a", "b", "bad", "bad"]
    assert states(end) == {"a": ("done", 0), "b": ("done", 0), "bad": ("failed", 2), "after": ("failed", 0), "odd": ("failed", 2)}


def test_refill_stop_and_checks(spark):
    q = entries(spark, ("a", "train", []))
    given = []
    refill = lambda s: None if given else given.append(1) or entries(spark, ("new", "train", ["a"]))
    code, end = runner.run(q, {"train": lambda e: "completed"}, "me", 60.0, refill=refill, now=lambda: 1.0)
    assert code == runner.DRAINED and states(end) == {"a": ("done", 0), "new": ("done", 0)}
    assert runner.run(q, {}, "me", 60.0, checks={"x": lambda: False}) == (runner.UNHEALTHY, q)
    ends = iter([False, True])
    code, end = runner.run(q, {"train": lambda e: "preempted"}, "me", 60.0, stopped=lambda: next(ends), now=lambda: 1.0)
    assert code == runner.STOPPED and states(end) == {"a": ("pending", 0)}
    waits = []
    stuck = entries(spark, ("a", "train", ["missing"]))
    code, _ = runner.run(stuck, {}, "me", 60.0, stopped=lambda: len(waits) == 1, wait=lambda: waits.append(1), now=lambda: 1.0)
    assert code == runner.STOPPED


def test_sessions(spark):
    s = spark.createDataFrame([("a", 100.0), ("b", 100.0), ("c", 100.0)], "name string, started double")
    c = spark.createDataFrame([("a", 40.0), ("b", 39.0), ("b", 10.0)], "name string, written double")
    assert {r["name"]: r.stale for r in runner.session_progress(s, c).collect()} == {"a": False, "b": True, "c": True}


def test_camera_is_checked():
    with pytest.raises(ValueError):
        scene.Camera(0, 4)
