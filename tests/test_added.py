"""Corruption, colours, health checks, reports and checkpoint folders."""

import os

import numpy as np
import pytest

from plumbline.operators import corruption as C, shape as S
from plumbline.plans import canary
from plumbline.sources import sinks

PIXELS = "frame_id long, v int, u int, depth double"


def frame(spark, depth):
    return spark.createDataFrame([(1, v, u, float(d)) for v, line in enumerate(depth) for u, d in enumerate(line)], PIXELS)


def dense(rows, column, shape):
    out = np.full(shape, np.nan)
    for r in rows.collect():
        out[r.v, r.u] = r[column]
    return out


@pytest.mark.parametrize("bleed", [0, 1, 2, 3])
def test_edges_are_dilated(spark, bleed):
    depth = np.where(np.arange(12) < 6, 1.0, 3.0) * np.ones((9, 1))
    depth[4, 2] = 1.2
    gv, gu = np.gradient(depth)
    step, k = np.maximum(abs(gv), abs(gu)) > C.EDGE, max(bleed, 1)
    want = np.zeros_like(step)
    for v, u in np.ndindex(step.shape):
        want[v, u] = step[max(0, v - k // 2) : v + k - k // 2, max(0, u - k // 2) : u + k - k // 2].any()
    assert (dense(C.edge_voids(frame(spark, depth), bleed), "edge", depth.shape) == want).all()


def test_corruption_counts_and_spread(spark):
    flat = np.full((100, 100), 2.0)
    got = dense(C.corrupted(frame(spark, flat), 0.3, 0.02, 3, 5), "corrupted", flat.shape)
    assert (got == 0).sum() == 3000
    assert abs((got[got > 0] - 2).std() - 0.08) < 0.004 and abs(got[got > 0].mean() - 2) < 0.005
    again = dense(C.corrupted(frame(spark, flat).repartition(7), 0.3, 0.02, 3, 5), "corrupted", flat.shape)
    assert (got == again).all()
    flat[:10] = 0
    hit = dense(C.injected(frame(spark, flat), 0.25, 0.05, 5), "injected", flat.shape)
    assert (hit[10:] == 0).sum() == 2250 and (hit[:10] == 0).all() and abs(hit[hit > 0].std() - 0.05) < 0.003
    assert C.corrupted(spark.createDataFrame([], PIXELS), 0.3, 0.1, 2).count() == 0


def test_colours_equal_components(spark):
    x = np.random.default_rng(3).normal(0, 1, (200, 6)) * [5, 3, 2, 1, 0.5, 0.1]
    got = S.feature_colours(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, features array<float>"))
    got = np.array([[r.r, r.g, r.b] for r in got.orderBy("i").collect()])
    _, vectors = np.linalg.eigh(np.cov(x.T))
    axes = vectors[:, ::-1][:, :3]
    p = x @ (axes * np.sign(axes[abs(axes).argmax(0), range(3)]))
    assert np.allclose(got, (p - p.min(0)) / (p.max(0) - p.min(0)), atol=1e-4)
    same = S.feature_colours(spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(4)], "i long, features array<float>"))
    assert {(r.r, r.g, r.b) for r in same.collect()} == {(0.0, 0.0, 0.0)}


def test_every_check_runs(spark):
    ran = []
    checks = {"a": lambda: ran.append("a") or True, "b": lambda: 1 / 0, "c": lambda: bool(ran.append("c"))}
    with pytest.raises(canary.Halt) as e:
        canary.assert_healthy(checks)
    assert e.value.names == ["b", "c"] and ran == ["a", "c"]
    with pytest.raises(ValueError):
        canary.assert_healthy({})
    rows = spark.createDataFrame([(0.2, True), (0.5, True), (0.9, False)], "iou_3d double, success boolean")
    canary.assert_healthy({"iou": canary.iou_check(rows)})
    assert not canary.iou_check(rows.limit(0))()


def test_markdown(spark, tmp_path):
    rows = [("b|s|l_sev>=0.0", "b", "s", "l", 0.0, 3, 1 / 3, 0.3, float("nan"), 0.25), ("a|s|l_sev>=0.5", "a", "s", "l", 0.5, 1, 1.0, 0.8, 2.5, 0.1)]
    report = spark.createDataFrame(rows, "key string, detector string, source string, lifter string, threshold double, n long, acc double, median_iou_2d double, median_z_err_cm double, median_iou_3d double")
    sinks.write_markdown(report, f"file://{tmp_path}/r")
    lines = [r.value for r in spark.read.text(f"file://{tmp_path}/r").collect()]
    assert lines == [*sinks.HEAD, "| a | s | l | 0.5 | 1.000 | 0.800 | 2.50 | 0.100 | 1 |", "| b | s | l | 0.0 | 0.333 | 0.300 | nan | 0.250 | 3 |"]


def test_checkpoints(spark, tmp_path):
    c = sinks.Checkpoints(spark, f"file://{tmp_path}/c", 2)
    put = lambda n: lambda d: spark.range(n).write.parquet(f"{d}/t")
    assert c.latest() is None
    for step in (1, 2, 3):
        c.save(step, put(step))
    assert c.steps() == ["step_000000002", "step_000000003"] and c.latest().endswith("3")
    c.point_to("step_000000002")
    assert spark.read.parquet(c.part("t")).count() == 2
    c.save(3, put(7))
    assert spark.read.parquet(f"{c.latest()}/t").count() == 7 and c.steps() == ["step_000000003", "step_000000003-1"]
    os.makedirs(tmp_path / "c/step_000000009.unfinished")
    c.save(4, put(1))
    assert c.listed() == c.steps() == ["step_000000003-1", "step_000000004"]
    for wrong, kind in ((lambda: c.point_to("step_000000001"), FileNotFoundError), (lambda: c.part("adapter"), FileNotFoundError), (lambda: sinks.Checkpoints(spark, f"file://{tmp_path}/c", 0), ValueError)):
        with pytest.raises(kind):
            wrong()

    def broken(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        c.save(5, broken)
    assert c.latest().endswith("step_000000004") and not [f for f in os.listdir(tmp_path / "c") if f.startswith("LATEST.")]
