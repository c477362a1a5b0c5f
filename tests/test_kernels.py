"""Kernels, control plane and readers against plain values."""

import io
import json
import os
import struct
import tarfile
import zlib

import numpy as np
import pytest

from plumbline.functions import parsing
from plumbline.operators import geometry as G, metrics as M, raster as R, shape as S
from plumbline.plans import ledger as L, queue as Q
from plumbline.sources import readers
from plumbline.streaming import guard
from pyspark.sql import functions as F

K = G.Intrinsics(500.0, 500.0, 160.0, 120.0)


def noisy(void, sigma, seed, n=100, depth=2.0):
    r = np.random.default_rng(seed)
    d = np.maximum(depth + r.normal(0, sigma, n * n), 0)
    d[r.choice(n * n, int(n * n * void), replace=False)] = 0
    return d.reshape(n, n)


@pytest.mark.parametrize("void,sigma,cm", [(0.1, 0.005, 1), (0.3, 0.015, 2), (0.5, 0.015, 3), (0.5, 0.03, 5)])
def test_z_error_budget(void, sigma, cm):
    errors = []
    for seed in range(5):
        d = noisy(void, sigma, seed)
        inner = d[(d > 0) & ~R.mask_kernel(d)[0]]
        errors.append(abs(np.median(inner) - 2.0) * 100)
    assert np.median(errors) <= cm


def test_outliers_found_and_inliers_kept():
    d, r = noisy(0.3, 0.01, 1), np.random.default_rng(2)
    flat = np.flatnonzero(d.ravel() > 0)
    hit = r.choice(flat, 50, replace=False)
    d.ravel()[hit] += 0.6
    mask = R.mask_kernel(d)[0].ravel()
    assert mask[hit].mean() >= 0.6 and 1 - mask[np.setdiff1d(flat, hit)].mean() >= 0.8
    assert not R.mask_kernel(np.full((50, 50), 2.0))[0].any()


def test_degenerate_frames():
    for d in (np.zeros((5, 5)), np.full((5, 5), np.nan), np.ones((1, 1)), np.zeros((0, 0))):
        assert not R.mask_kernel(d)[0].any()
    assert (R.mask_kernel(np.zeros((5, 5)))[1] == 0).all()


def test_inpaint_fills_and_preserves():
    d = noisy(0.5, 0.01, 3)
    got = R.inpaint_kernel(d)
    assert (got > 0).all() and (got[d > 0] == d[d > 0]).all()
    assert (R.close_kernel(d, 0) == d).all()


def scene_with_holes(n, m, seed):
    """A tilted plane with a nearer box, noise, single voids and round holes: (truth, depth, void)."""
    r = np.random.default_rng(seed)
    v, u = np.mgrid[:n, :m]
    truth = 2.0 + 0.3 * u / m + 0.2 * v / n
    truth[(v > n * 0.3) & (v < n * 0.7) & (u > m * 0.4) & (u < m * 0.8)] -= 0.5
    void = r.random((n, m)) < 0.05
    for _ in range(12):
        a, b, k = r.integers(0, n), r.integers(0, m), r.integers(2, max(n // 12, 3))
        void |= (v - a) ** 2 + (u - b) ** 2 < k * k
    return truth, np.where(void, 0, truth + r.normal(0, 0.005, truth.shape)), void


def plain_arrival(void):
    """The same equation for arrivals, solved by repeating it everywhere until nothing changes."""
    h, w = void.shape
    t = np.where(void, np.inf, 0.0)
    at = lambda v, u: t[v, u] if 0 <= v < h and 0 <= u < w else np.inf
    while True:
        before = t.copy()
        for v, u in zip(*np.nonzero(void), strict=True):
            a, b = sorted((min(at(v - 1, u), at(v + 1, u)), min(at(v, u - 1), at(v, u + 1))))
            if a < np.inf:
                t[v, u] = min(t[v, u], a + 1 if b - a >= 1 else (a + b + np.sqrt(2 - (a - b) ** 2)) / 2)
        if (t == before).all():
            return t


def plain_march(depth, radius):
    void = ~(np.isfinite(depth) & (depth > 0))
    out, t, have = np.where(void, 0.0, depth), plain_arrival(void), ~void
    gv, gu = np.gradient(t)
    for now in range(1, int(t.max()) + 9):
        new = {}
        for v, u in zip(*np.nonzero(~have & (np.ceil(t) <= now)), strict=True):
            top = bottom = 0.0
            for a, b in zip(*np.nonzero(have), strict=True):
                dv, du = a - v, b - u
                if dv * dv + du * du <= radius * radius:
                    along = abs(dv * gv[v, u] + du * gu[v, u]) / max(np.hypot(gv[v, u], gu[v, u]), 1e-12) / np.hypot(dv, du)
                    weight = max(along, 1e-6) / (dv * dv + du * du) / (1 + abs(t[a, b] - t[v, u]))
                    top, bottom = top + weight * out[a, b], bottom + weight
            if bottom > 0:
                new[v, u] = top / bottom
        for k, x in new.items():
            out[k], have[k] = x, True
    return out


def test_marching_front():
    """Against plain loops; fills every void, keeps what is valid, and lies nearer to the truth than rings do."""
    for seed in range(3):
        _, d, void = scene_with_holes(18, 23, seed)
        assert np.allclose(R.arrival_kernel(void), plain_arrival(void), atol=1e-9)
        for radius in (1, 2, 5):
            assert np.allclose(R.march_kernel(d, radius), plain_march(d, radius), atol=1e-9)
    errors = {k: [] for k in R.INPAINT}
    for seed in range(5):
        truth, d, void = scene_with_holes(100, 100, seed)
        for k, fill in R.INPAINT.items():
            got = fill(d, 5)
            assert (got > 0).all() and (got[~void] == d[~void]).all()
            errors[k] += list(np.abs(got - truth)[void])
    assert np.mean(errors["march"]) < 0.8 * np.mean(errors["rings"])
    for d in (np.zeros((4, 5)), np.full((3, 3), np.nan), np.ones((1, 1)), np.zeros((0, 0))):
        assert (R.march_kernel(d) == np.where(d > 0, d, 0)).all()
    one = np.array([[2.0, 0, 0, 0, 0, 0, 0, 0, 3.0]])
    assert (R.march_kernel(one, 2) > 0).all() and (R.march_kernel(one.T, 2).T == R.march_kernel(one, 2)).all()
    assert (R.march_kernel(np.array([[1.0, np.inf], [np.nan, -1.0]])) == 1).all()


def test_dense_frames_inpainted(spark):
    _, d, void = scene_with_holes(20, 24, 7)
    rows = [(1, 20, 24, d.ravel().tolist(), "x"), (2, 1, 2, [0.0, 0.0], "y"), (3, 0, 0, [], "z"), (4, None, None, None, None), (5, 20, 24, d.ravel().tolist(), "x")]
    frames = spark.createDataFrame(rows, "frame_id long, h int, w int, depth array<double>, inpainted string")
    for way, fill in R.INPAINT.items():
        got = {r.frame_id: r.inpainted for r in R.inpainted_frames(frames, R.FilterConfig(inpaint=way)).collect()}
        assert np.array_equal(got[1], fill(d, 5).ravel()) and got[5] == got[1] and got[2] == [0, 0] and got[3] == [] and got[4] is None
        assert R.inpainted_frames(frames.limit(0), R.FilterConfig(inpaint=way)).count() == 0
    with pytest.raises(ValueError, match="rings"):
        R.restored_pixels(R.to_pixels(frames), R.FilterConfig(inpaint="march"))


def test_median_of_nine():
    r = np.random.default_rng(1)
    for n, m in ((1, 1), (1, 6), (7, 1), (13, 17)):
        d = r.integers(0, 5, (n, m)).astype(float)
        p = np.pad(d, 1, mode="edge")
        assert all(R.median_kernel(d)[i, j] == np.median(p[i : i + 3, j : j + 3]) for i in range(n) for j in range(m))


def test_long_form_equals_dense_form(spark):
    d = noisy(0.3, 0.02, 4, n=30)
    rows = [(0, v, u, float(d[v, u])) for v in range(30) for u in range(30)]
    px = spark.createDataFrame(rows, "frame_id long, v int, u int, depth double")
    got = {(r.v, r.u): (r.outlier, r.sigma) for r in R.outlier_mask(px).collect()}
    mask, sigma, _ = R.mask_kernel(d)
    assert all(got[v, u][0] == mask[v, u] and abs(got[v, u][1] - sigma[v, u]) < 1e-9 for v in range(30) for u in range(30))
    back = R.to_pixels(R.to_frames(px))
    assert back.count() == 900


def test_lift_plane():
    d = np.full((240, 320), 2.0)
    z, lo, hi, ratio, vertices = G.lift_box(d, K, (100, 80, 220, 160))
    assert abs(z - 2) < 1e-9 and abs(lo - 2) < 1e-6 and abs(hi - 2) < 1e-6 and ratio == 1 and len(vertices) == 8
    assert G.lift_box(d, K, (0, 0, 5, 5)) is None and G.lift_box(np.where(np.arange(320) < 220, 0, d), K, (100, 80, 220, 160)) is None
    thin = d.copy()
    thin[82:158, 102:218] = 0
    assert abs(G.stable_z(thin, (100, 80, 220, 160)) - 2) < 1e-9 and G.stable_z(np.zeros((20, 20)), (0, 0, 20, 20)) is None
    with pytest.raises(ValueError):
        G.lift_box(d.ravel(), K, (0, 0, 9, 9))
    with pytest.raises(ValueError):
        G.lift_box(d, K, (100, 80, 220, 160), percentiles=(50, 50))
    with pytest.raises(ValueError):
        G.lift_box(d, K, (400, 0, 420, 20))
    with pytest.raises(ValueError):
        G.Intrinsics(0, 1, 0, 0)


@pytest.mark.parametrize("text,box", [
    ('{"bbox_2d": [0.25, 0.25, 0.75, 0.75]}', (80, 60, 240, 180)), ("(80,60),(240,180)", (80, 60, 240, 180)), ('x ```{"bbox": [250, 250, 750, 750]}```', (80, 60, 240, 180)),
    ('{"bbox": [9, 9, 3, 3]}', None), ("garbage", None), (None, None),
])
def test_parsing(spark, text, box):
    df = spark.createDataFrame([(text,)], "r string").select(parsing.pixel_box(parsing.raw_box(F.col("r")), F.lit(320), F.lit(240)).alias("b"))
    got = df.first().b
    assert (tuple(got) if got else None) == box


def test_report_example(spark):
    rows = [("d", "s", "l", 0.0, 0.8, 1.0, 0.5, True), ("d", "s", "l", 0.0, 0.3, 2.0, 0.2, True), ("d", "s", "l", 0.0, 0.0, float("nan"), 0.0, False)]
    df = spark.createDataFrame(rows, "detector string, source string, lifter string, severity double, iou_2d double, z_err_cm double, iou_3d double, success boolean")
    (r,) = M.evaluation_report(df).collect()
    assert r.n == 3 and abs(r.acc - 1 / 3) < 1e-9 and r.median_z_err_cm == 1.5 and r.key == "d|s|l_sev>=0.0"


def queue(spark, rows):
    return spark.createDataFrame([(i, n, "k", "{}", need, st, 0, 2, own, hb) for i, (n, need, st, own, hb) in enumerate(rows)], "pos int, name string, kind string, config string, requires array<string>, status string, retries int, max_retries int, owner string, heartbeat double")


def test_queue_flow(spark):
    q = queue(spark, [("a", [], "pending", None, None), ("b", ["a"], "pending", None, None), ("c", ["a", "b"], "pending", None, None), ("d", [], "running", "x", 10.0)])
    q = Q.claim_next(q, "me", 100.0, 200.0)
    assert {r.name: r.status for r in q.collect()}["a"] == "running"
    with pytest.raises(Q.QueueError):
        Q.release(q, "a", "other", "completed")
    q2 = Q.release(q, "a", "me", "completed")
    assert Q.claim_next(q2, "me", 100.0, 200.0).where("status = 'running' AND name = 'b'").count() == 1
    stale = Q.claimable(q2, 1000.0, 200.0).where("name = 'd'")
    assert stale.count() == 1 and Q.claimable(q2, 210.0, 200.0).where("name = 'd'").count() == 0
    bad = queue(spark, [("a", [], "failed", None, None), ("b", ["a"], "pending", None, None), ("c", ["b"], "pending", None, None), ("d", ["a"], "running", "x", None)])
    assert {r.name: r.status for r in Q.fail_unsatisfiable(bad).collect()} == {"a": "failed", "b": "failed", "c": "failed", "d": "running"}
    assert Q.is_drained(bad.limit(0)).first().drained
    more = queue(spark, [("a", [], "pending", None, None), ("z", [], "pending", None, None), ("z", [], "pending", None, None)])
    assert Q.extended(q, more).count() == 5


LEDGER = "id int, hypothesis string, status string, config_json string, config_hash string, loss double, created_at double"


def test_ledger(spark):
    assert L.config_hash({"b": 1, "a": 1e-4}) == L.config_hash({"a": 0.0001, "b": 1})
    rows = [(i, "H1", "done", json.dumps({"rank": i, "max_steps": 10}), L.config_hash({"rank": i, "max_steps": 10}), i / 10, float(i)) for i in range(6)]
    rows += [(7, "H1", "failed", json.dumps({"rank": 7}), "x", 0.0, 7.0), (8, "H2", "done", json.dumps({"rank": 8}), "y", 0.0, 8.0)]
    led = spark.createDataFrame(rows, LEDGER)
    got = L.propose(led, [L.Param("rank", (100, 101))], "lora", "H1", (10, 40, 160), "loss", 3)
    assert [g["config"] for g in got[:2]] == [{"rank": 0, "max_steps": 40}, {"rank": 1, "max_steps": 40}] and got[2]["config"]["rank"] >= 100
    assert L.propose(led, [], "lora", "H1", (10,), "loss", 0) == []
    assert got[2]["name"] == f"h1-lora-{got[2]['config_hash'][:10]}" and L.propose(led, [L.Param("rank", (100,))], "lora", "H1", (10, 40), "loss", 3, base={"lr": 1}, most=7)[2:] == []
    assert L.propose(led, [L.Param("rank", (100,))], "lora", "H1", (10, 40), "loss", 3, base={"lr": 1})[2]["config"] == {"lr": 1, "rank": 100, "max_steps": 10}
    for wrong in (lambda: L.Param("x", (1,), 0.0, 1.0), lambda: L.checked_rungs((), 3), lambda: L.checked_rungs((1, 1), 3), lambda: L.checked_rungs((1,), 1)):
        with pytest.raises(ValueError):
            wrong()


def test_promotions_count_rows_without_the_metric(spark):
    """Six done rows, three without the metric: two are promoted, and those without it rank last; steps that are no rung are the first."""
    rows = [(i, "H1", "done", json.dumps({"rank": i, "max_steps": 999}), f"h{i}", None if i < 3 else float(i), float(i)) for i in range(6)]
    got = L.promotions(spark.createDataFrame(rows, LEDGER), "H1", (10, 40), "loss", 3, True).orderBy("place").collect()
    assert [(r.id, r.rung, json.loads(r.config_json)) for r in got] == [(5, 0, {"rank": 5, "max_steps": 40}), (4, 0, {"rank": 4, "max_steps": 40})]


def test_promotions_behind_known_ones(spark):
    """20 promotions of the first rung are in the ledger already; those of the second are proposed, also in a full ledger."""
    config = lambda i, steps: {"rank": i, "max_steps": steps}
    rows = [(i, "H1", "done", json.dumps(config(i, s)), L.config_hash(config(i, s)), i / 100, float(i)) for s, n in ((10, 60), (40, 20)) for i in range(n)]
    led = spark.createDataFrame(rows, LEDGER)
    space = [L.Param("rank", (1000, 1001))]
    want = [config(i, 160) for i in range(4)]
    assert [g["config"] for g in L.propose(led, space, "lora", "H1", (10, 40, 160), "loss", 4)] == want
    got = [g["config"] for g in L.propose(led, space, "lora", "H1", (10, 40, 160), "loss", 8, most=80)]
    assert got == [config(i, 160) for i in range(6)]


def test_guard_batch_equals_stream(spark, tmp_path):
    rows = [("r", i, v) for i, v in enumerate([1.0, 1.4, 1.6, 1.8, 1.9, 2.0, 0.05])]
    cfg = guard.GuardConfig(patience=3, warmup=2)
    want = [(r.step, r.event, r.ema_loss) for r in guard.guard_batch(spark.createDataFrame(rows, guard.LOG), cfg).orderBy("step").collect()]
    assert [w[1] for w in want] == ["new_best", "ok", "ok", "ok", "rollback", "ok", "new_best"]
    for k, part in enumerate((rows[:3], rows[3:])):
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("run", "step", "loss"), r))) for r in part))
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))  # files are taken by age
    stream = guard.guard_stream(guard.read_log(spark, str(tmp_path), True).select("run", "step", "loss"), cfg)
    q = stream.writeStream.format("memory").queryName("guarded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [(r.step, r.event, r.ema_loss) for r in spark.table("guarded").orderBy("step").collect()] == want


def test_guard_states():
    """The log 1.0, 1.2, 1.2, 1.2 and its like: warm-up, patience, rollbacks and their end."""
    cfg, state, events = guard.GuardConfig(decay=0.5, tolerance=0.02, patience=2, warmup=3, most=1), guard.NEW, []
    for k, loss in enumerate([1.0, 1.2, 1.2, 1.2, 1.2, 1.2, 1.2, 1.2, 0.1]):
        state, event = guard.step(state, k, loss, cfg)
        events.append(event)
    assert events == ["new_best", "ok", "ok", "ok", "rollback", "ok", "exhausted", "exhausted", "new_best"] and state[2] == 8 and state[4] == 1
    assert guard.GuardConfig() == guard.GuardConfig(0.9, 0.02, 25, 40, 3)


def png16(a):
    raw = b"".join(b"\0" + row.astype(">u2").tobytes() for row in a)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_readers(spark, tmp_path):
    a = np.arange(12, dtype=np.uint16).reshape(3, 4) * 1000
    (tmp_path / "a.png").write_bytes(png16(a))
    np.save(tmp_path / "b.npy", np.full((2, 2), 1.5, np.float32))
    got = {r.frame_id: r for r in readers.read(spark, "depth", str(tmp_path)).collect()}
    assert got["a"].h == 3 and abs(got["a"].depth[5] - 5.0) < 1e-6 and got["b"].depth == [1.5] * 4
    with tarfile.open(tmp_path / "s.tar", "w") as tar:
        for i in range(3):
            for suffix, data in (("clean_depth.npy", a), ("corrupted_depth.npy", a)):
                b = io.BytesIO()
                np.save(b, data.astype(np.float32))
                info = tarfile.TarInfo(f"{i:06d}.{suffix}")
                info.size = b.tell()
                tar.addfile(info, io.BytesIO(b.getvalue()))
            m = json.dumps({"split": "train" if i else "holdout"}).encode()
            info = tarfile.TarInfo(f"{i:06d}.meta.json")
            info.size = len(m)
            tar.addfile(info, io.BytesIO(m))
    assert readers.read(spark, "shards", str(tmp_path), split="train", max_samples=1).first().stem == "000001"
    (tmp_path / "q.yaml").write_text("experiments:\n- {name: a, kind: k, retries: x}\n- {name: b, kind: k, requires: [a]}\n")
    q = readers.read(spark, "queue", str(tmp_path / "q.yaml")).orderBy("pos").collect()
    assert q[0].retries == 0 and q[1].requires == ["a"]
    assert readers.expand("${A:-x}/${B}/${C:-z}${D}", {"B": "y", "C": ""}) == "x/y/"
    f = readers.synthetic_frames(spark, 2, 10, 10, 2.0, 0.6).collect()
    assert all(sum(d == 0 for d in r.depth) == 60 for r in f)


def test_shapes(spark):
    assert spark.range(1).select(S.shape_label(F.lit(0.9), F.lit(1.0))).first()[0] == S.SPHERE
    open_mesh = spark.createDataFrame([(0, 0, 0, 1, 2), (0, 1, 1, 2, 3)], "mesh_id int, fid int, i int, j int, k int")
    assert not S.watertight(open_mesh).first().closed
