"""Meshes, made scenes, grounding, benchmark budgets, training records, sources and sinks."""

import json
import os
import signal
import struct
import threading
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import parsing
from plumbline.operators import benchmark as B, compose, geometry as G, mesh, metrics as M, raster as R, shape as S
from plumbline.operators.scene import Camera
from plumbline.plans import canary, ground, ledger as L, queue as Q, runner, training
from plumbline.sources import readers, sinks
from plumbline.streaming import guard

K = G.Intrinsics(80.0, 80.0, 50.0, 50.0)


def ball(n, r=0.5, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, 3))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * r


def test_nearest_equals_brute_force():
    r = np.random.default_rng(1)
    for n, k in ((2, 3), (40, 5), (900, 20)):
        p = np.round(r.normal(size=(n, 3)) * [5, 1, 1], 1)
        want = np.sort(np.linalg.norm(p[:, None] - p[None], axis=2), 1)
        assert np.allclose(mesh.nearest_k(p, k), want[:, 1 : min(k, n - 1) + 1])
        q = r.normal(size=(30, 3))
        assert np.allclose(mesh.nearest_k(p, 1, q)[:, 0], np.linalg.norm(q[:, None] - p[None], axis=2).min(1))


def test_cloud_distances_of_any_size(spark, monkeypatch):
    r = np.random.default_rng(3)
    a, b = r.normal(size=(60, 3)), np.vstack([r.normal(size=(80, 3)), [[30, 0, 0]]])
    a[0] = (-40, 5, 5)
    df = lambda x: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")
    want = np.linalg.norm(a[:, None] - b[None], axis=2).min(1)
    for most in (1000, 10):
        monkeypatch.setattr(M, "MAX_SENT", most)
        got = {x.id: x.d for x in M.nearest(df(a), df(b)).collect()}
        assert np.allclose([got[i] for i in range(60)], want)
    assert M.nearest(df(a), df(b[:0])).where("d IS NOT NULL").count() == 0 and M.nearest(df(a[:0]), df(b)).count() == 0
    monkeypatch.setattr(M, "MAX_SENT", 1000)
    one = M.cloud_distances(df(a), df(b), 0.5, sample=20).first()
    assert one == M.cloud_distances(df(a).repartition(3), df(b), 0.5, sample=20).first() and one.hausdorff > 1


def test_delaunay_spheres_are_empty_and_fill_the_hull():
    p = np.random.default_rng(2).normal(size=(200, 3))
    t = mesh.delaunay(p)
    c, r = mesh.spheres(p[t])
    assert not (((p[None] - c[:, None]) ** 2).sum(2) < r[:, None] * (1 - 1e-6)).any()
    cube = np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(4)], float)
    t = mesh.delaunay(cube)
    assert abs(abs(np.linalg.det(cube[t[:, 1:]] - cube[t[:, :1]])).sum() / 6 - 27) < 1e-6


def test_meshes_of_clouds(spark):
    v, t = mesh.built(ball(800), 0.0)
    d = mesh.described(v, t)
    assert abs(d["volume"] - np.pi / 6) < 0.04 and d["compactness"] > 0.9 and d["aspect_ratio"] < 1.05
    v2, t2 = mesh.decimated(v, t, 200)
    d2 = mesh.described(v2, t2)
    assert len(t2) <= 200 and d2["volume"] > 0.4 and mesh.decimated(v, t, 10**6)[1] is t
    for p in (ball(29), np.zeros((100, 3)), np.zeros((0, 3))):
        assert len(mesh.built(p)[1]) == 0
    assert (mesh.sampled(*mesh.EMPTY, 5) == 0).all() and abs(np.linalg.norm(mesh.sampled(v, t, 500), axis=1).mean() - 0.5) < 0.03
    flat = mesh.described(np.array([(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0.0)]), np.array([(0, 1, 2), (1, 3, 2)]))
    assert np.isnan(flat["volume"]) and flat["surface_area"] == 1 and flat["aspect_ratio"] == float("inf")
    df = spark.createDataFrame([(1, ball(400).tolist()), (2, ball(10).tolist())], "cloud_id long, points array<array<double>>")
    got = {r.cloud_id: r for r in mesh.reconstructed(df, 0.0, 100).collect()}
    assert 0 < len(got[1].triangles) <= 100 and got[2].triangles == []


def test_encoder(spark, tmp_path):
    w = S.encoder_weights(4)
    p = ball(20)
    h = p.astype(np.float32)
    want = []
    for x in h:  # a plain pass, point by point
        for a, b in w[:3]:
            x = [max(0.0, float(sum(x[i] * a[i, j] for i in range(a.shape[0])) + b[j])) for j in range(a.shape[1])] if a.shape[0] < 10 else np.maximum(np.array(x) @ a + b, 0)
        want.append(x)
    want = np.array(want)
    each, code = S.encoded(p, w)
    assert np.allclose(each, want, atol=1e-3) and np.allclose(code, np.maximum(want.max(0) @ w[3][0] + w[3][1], 0) @ w[4][0] + w[4][1], atol=1e-3)
    df = spark.createDataFrame([(1, p.tolist()), (2, p[::-1].tolist()), (3, [])], "cloud_id long, points array<array<double>>")
    got = {r.cloud_id: r for r in S.encode_clouds(df, w, features=True).collect()}
    assert np.allclose(got[1].embedding, got[2].embedding, atol=1e-4) and len(got[1].features) == 20 and len(got[3].embedding) == 256
    path = f"file://{tmp_path}/w"
    S.export_weights(spark, w, path)
    assert all(np.array_equal(a, b) for x, y in zip(w, S.load_weights(spark, path), strict=True) for a, b in zip(x, y, strict=True))
    with pytest.raises(ValueError):
        S.load_weights(spark, path, S.LAYERS[:4])
    scores = S.classified(code, (np.ones((256, 40), np.float32), np.zeros(40)))
    assert scores.shape == (40,) and abs(S.classified(np.ones(20000), (np.ones((20000, 1)), 0), 0.3, np.random.default_rng(0))[0] / 20000 - 1) < 0.02


def test_assets_and_scenes():
    for c in compose.CATEGORIES:
        v, f = compose.asset(c, 0.2)
        a, b, d = (v[f[:, k]] for k in range(3))
        assert (a * np.cross(b, d)).sum() > 0 and abs(v[:, 1].min()) < 1e-12 and not np.isnan(mesh.described(v, f)["volume"])
    with pytest.raises(KeyError):
        compose.asset("teapot", 1)
    with pytest.raises(ValueError):
        compose.library(21)
    for seed in range(30):
        things = compose.placed(np.random.default_rng(seed))
        assert 1 <= len(things) <= 10 and all(np.hypot(a["x"] - b["x"], a["z"] - b["z"]) >= 0.28 for i, a in enumerate(things) for b in things[:i])
    d = np.full((60, 80), 2.0)
    bad = compose.corrupt(d, 0.4, 0.02, 3, 5)
    assert (bad == 0).sum() == int(4800 * 0.4) and (compose.corrupt(d, 0.4, 0.02, 3, 5) == bad).all()


@pytest.fixture(scope="module")
def corpus(spark):
    return compose.frames(spark, 12, Camera(48, 64), 3).cache()


def test_frames_are_their_own(spark, corpus):
    again = {r.frame_id: r for r in compose.frames(spark, 12, Camera(48, 64), 3, partitions=1).collect()}
    for r in corpus.collect():
        assert r == again[r.frame_id] and (r.split == "heldout") == (r.category in compose.held_out(compose.CATEGORIES, 0.2))
        seen = np.array(r.instance).reshape(48, 64)
        assert r.category in r.query_text and 0.3 <= r.corruption_params.void_ratio <= 0.8 and len(r.aabb_3d) == 8
        x0, y0, x1, y1 = r.bbox_2d
        assert (seen[y0:y1, x0:x1] > 0).any() or r.bbox_2d == [0, 0, 8, 8]


def test_grounding_of_made_frames(spark, corpus, tmp_path):
    cam = Camera(48, 64)
    k = G.Intrinsics(*cam.intrinsics)
    frames = corpus.select("frame_id", "h", "w", F.col("clean").alias("depth"))
    asked = ground.sample_requests(corpus)
    truth = ground.grounded(asked, frames, ground.ground_truth, k)
    said = ground.grounded(asked, frames, ground.answered(ground.echo), k)
    rows = {r.req_id: r for r in truth.collect()}
    assert {r.req_id: r for r in said.collect()} == rows and any(r.success for r in rows.values())
    assert all(r.error in (None, ground.NO_LIFT) and (r.error is None) == r.success == (r.z_est is not None) for r in rows.values())
    silent = ground.grounded(asked, frames, ground.answered(lambda d: d.withColumn("response", F.lit("no idea"))), k)
    out = [json.loads(r.response) for r in ground.responses(silent).collect()]
    assert all(o == {"success": False, "error": ground.NO_BOX, "query": o["query"]} for o in out)
    good = [json.loads(r.response) for r in ground.responses(truth).collect() if rows[r.req_id].success]
    assert all(set(o) == {"success", "query", "bbox_2d", "vertices_3d", "z_est", "z_min", "z_max", "inlier_ratio"} and len(o["vertices_3d"]) == 8 for o in good)
    report = ground.evaluated(asked, frames, ground.ground_truth, k, "both").collect()
    assert len(report) == 24 and {r.lifter for r in report} == {"naive", "full"} and all(r.iou_2d == 1 for r in report)
    canary.assert_healthy(ground.default_checks(spark, f"file://{tmp_path}/w", k, corpus))
    context = asked.withColumns({"shape_text": F.lit("S"), "z_est": F.lit(1.5)})
    prompts = []
    ground.answered(lambda d: prompts.extend(r.prompt for r in d.limit(1).collect()) or ground.echo(d))(context)
    assert prompts[0].startswith("Geometric context: S Estimated distance: 1.50 m.\nLocate the object described as: '")


def test_detectors(spark, tmp_path):
    assert ground.detector(spark, {}) is ground.ground_truth
    for config, kind in (({"detector": "x"}, ValueError), ({"detector": "vlm+adapter"}, ValueError), ({"detector": "vlm+adapter", "adapter_from": "e", "checkpoint_root": f"file://{tmp_path}"}, FileNotFoundError)):
        with pytest.raises(kind):
            ground.detector(spark, config)
    sinks.Checkpoints(spark, f"file://{tmp_path}/e").save(1, lambda d: spark.range(1).write.parquet(f"{d}/adapter"))
    got = []
    ground.detector(spark, {"detector": "vlm+adapter", "adapter_from": "e", "checkpoint_root": f"file://{tmp_path}"}, {"vlm": lambda at=None: got.append(at) or ground.echo})
    assert got[0].endswith("step_000000001/adapter") and ground.lifters("both") == ("naive", "full")
    with pytest.raises(ValueError):
        ground.lifters("some")
    boxes = spark.createDataFrame([('{"bbox_2d": [1, 2, 3, 4]}',), ('{"bbox_2d": [1]}',), ("{}",)], "meta string")
    assert [r.x_min for r in ground.ground_truth(boxes).collect()] == [1, None, None]


def test_whole_analysis(spark):
    """A noisy paraboloid of which half the pixels are void: the depth within its budget, a mesh, and its text."""
    r = np.random.default_rng(0)
    u, v = np.meshgrid(np.linspace(-1, 1, 60), np.linspace(-1, 1, 60))
    d = 2 + 0.15 * (u**2 + v**2) + r.normal(0, 0.01, u.shape)
    drop = lambda x: np.where(np.random.default_rng(1).random(x.shape) < 0.5, 0, x)
    frames = spark.createDataFrame([(1, 60, 60, d.ravel().tolist()), (2, 10, 10, [0.0] * 100)], "frame_id long, h int, w int, depth array<double>")
    got = {x.frame_id: x for x in ground.analysed(frames, G.Intrinsics(80, 80, 30, 30), drop, points=256).collect()}
    assert abs(got[1].z_est - got[1].z_true) < 0.15 and got[1].n_faces > 0 and got[1].text.startswith(f"Shape classification: {got[1].label}\n  Volume") and len(got[1].embedding) == 256
    assert {"filter", "backproject", "mesh", "encode", "describe", "total"} == {*got[1].timings}
    assert got[2].z_est is None and got[2].z_true is None and got[2].label == S.NONE and got[2].surface_area == 0
    assert "Volume           : nan m^3" in got[2].text and got[2].text.endswith("0 verts, 0 faces")


def test_benchmark_budgets(spark):
    grid = B.cross(spark, void_ratio=(0.10, 0.30, 0.50), noise_std=(0.015, 0.030), seed=[0, 1, 2])
    assert grid.count() == 18 and [r.cell for r in grid.orderBy("void_ratio", "noise_std", "seed").collect()] == [*range(18)]
    rows = {(r.void_ratio, r.noise_std): r for r in B.sweep_record(B.measured(grid)).collect()}
    assert rows[0.3, 0.015].z_error_cm <= 2 and rows[0.5, 0.03].z_error_cm <= 5 and rows[0.3, 0.015].sigma_rel_err < 0.5
    assert all(0.9 < r.rmse_ratio < 5 and 0 <= r.flag_rate < 0.5 and r.timing_ms > 0 for r in rows.values())
    (r,) = B.outlier_record(B.spiked(B.cross(spark, void_ratio=(0.3,), noise_std=(0.01,), seed=[0, 1, 2]))).collect()
    assert r.recall >= 0.6 and r.precision >= 0.4 and r.f1 >= 0.4 and r.retention >= 0.8
    assert B.spiked(B.cross(spark, void_ratio=(0.999,), noise_std=(0.01,), seed=[0])).count() == 0
    acc = B.shape_accuracy(B.shapes(spark)).first()
    assert acc.n == 6 and acc.accuracy >= 0.8


def test_restored_frames_fill_their_voids(spark):
    _, bad = B.made(0.4, 0.1, 3, 40)
    df = spark.createDataFrame([(0, 40, 40, bad.ravel().tolist())], "frame_id long, h int, w int, depth array<double>")
    got = np.array(R.restore_frames(df).first().restored)
    assert (got > 0).all() and abs(np.median(got) - 2) < 0.05
    r = np.zeros((20, 20))
    assert (R.restore_kernel(r) == 0).all()


def test_scheduler(spark):
    q = spark.createDataFrame([(0, "a", "k", "{}", [], "pending", 0, 2, None, None)], "pos int, name string, kind string, config string, requires array<string>, status string, retries int, max_retries int, owner string, heartbeat double")
    spec = lambda n: {"name": n, "kind": "k", "config": {"x": n}}
    asked = []
    one, none, two = (lambda led, n, x=x: asked.append(x) or ([spec(x)] if x else []) for x in ("one", "", "two"))
    s = L.Scheduler([one, none, two], low=1)
    assert s.refill(q, None) is None and asked == []
    s.low = 2
    names = [[r.name for r in s.refill(q, None).collect()] for _ in range(3)]
    assert names == [["one"], ["two"], ["one"]] and asked == ["one", "", "two", "one"]
    assert Q.extended(q, L.Scheduler([two]).refill(q, None)).count() == 2 and L.Scheduler([none]).refill(q, None) is None
    for wrong in (lambda: L.Scheduler([]), lambda: L.Axis("", (1,)), lambda: L.Axis("a", ()), lambda: L.grid(spark, "", "k", [L.Axis("a", (1,))]), lambda: L.grid(spark, "n", "k", [])):
        with pytest.raises(ValueError):
            wrong()
    g = L.grid(spark, "base", "train", [L.Axis("lora.rank", (8, 16)), L.Axis("curriculum.schedule", ("x", "y")), L.Axis("a.b", (True,))]).orderBy("pos").collect()
    assert [r.name for r in g] == ["base-r8-cur=x-b=True", "base-r8-cur=y-b=True", "base-r16-cur=x-b=True", "base-r16-cur=y-b=True"] and json.loads(g[0].config) == {"lora.rank": 8, "curriculum.schedule": "x", "a.b": True}
    with pytest.raises(Exception, match="no such status"):
        L.recorded(spark.createDataFrame([("done",), ("lost",)], "status string")).collect()
    assert L.recorded(spark.createDataFrame([("done",), ("pruned",)], "status string")).count() == 2


def test_claims_are_renewed_while_a_job_runs(spark):
    beats = []
    with runner.beating(lambda: beats.append(1) or (1 / 0), 0.02):
        time.sleep(0.2)
    n = len(beats)
    time.sleep(0.1)
    assert n > 2 and len(beats) == n
    q = spark.createDataFrame([(0, "a", "k", "{}", [], "pending", 0, 2, None, None)], "pos int, name string, kind string, config string, requires array<string>, status string, retries int, max_retries int, owner string, heartbeat double")
    clock, went = iter(range(1, 10**6)), threading.Event()
    code, end = runner.run(q, {"k": lambda e: went.wait(4) and "completed" or "completed"}, "me", 1.5, now=lambda: float(next(clock)))
    assert code == runner.DRAINED and end.first().status == "done" and next(clock) > 4
    assert runner.slice_minutes(60, 10) == 50
    old = signal.getsignal(signal.SIGUSR1)
    stopped = runner.stop_on_signal(signal.SIGUSR1)
    assert not stopped()
    os.kill(os.getpid(), signal.SIGUSR1)
    time.sleep(0.05)
    assert stopped()
    signal.signal(signal.SIGUSR1, old)
    with pytest.raises(ValueError):
        runner.slice_minutes(10, 10)


def test_training_records(spark):
    cfg = training.TrainConfig.of({"epochs": "20", "warmup_epochs": 2.0})
    assert cfg.epochs == 20 and cfg.warmup_epochs == 2
    for wrong in (lambda: training.TrainConfig(epochs=0), lambda: training.TrainConfig(warmup_epochs=120), lambda: training.TrainConfig.of({"z": 1, "a": 2}), lambda: training.checked_split("dev")):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(FileNotFoundError):
        training.epochs(spark.createDataFrame([], "shard string, pos int, split string"), 1)
    assert training.checked_split("test") == "test" and spark.range(0).agg(training.mean_loss(F.col("id").cast("double"))).first()[0] == 0


def test_shards_of_made_frames(spark, corpus, tmp_path):
    root = f"file://{tmp_path}/shards"
    members = readers.sample_members(corpus)
    done = readers.write_shards(members, root, 5).orderBy("shard").collect()
    assert [(r.shard, r.n) for r in done] == [(0, 5), (1, 5), (2, 2)] and readers.n_shards(12, 5) == 3
    before = {f: (tmp_path / "shards" / f).read_bytes() for f in os.listdir(tmp_path / "shards")}
    os.remove(tmp_path / "shards/shard-000002.tar")
    readers.write_shards(members.repartition(7), root, 5, first=2).collect()
    assert {f: (tmp_path / "shards" / f).read_bytes() for f in os.listdir(tmp_path / "shards")} == before
    back = {int(r.stem): r for r in readers.read_shards(spark, root, "all").collect()}
    for r in corpus.collect():
        b = back[r.frame_id]
        assert (b.clean, b.corrupted, bytes(b.rgb), b.bbox_2d, b.aabb_3d, b.intrinsics, b.severity, b.split) == (r.clean, r.corrupted, bytes(r.rgb), r.bbox_2d, r.aabb_3d, r.intrinsics, r.corruption_params.void_ratio, r.split)
    assert [r.stem for r in readers.preview(readers.read_shards(spark, root, "all"), 3).collect()] == ["00000000", "00000001", "00000002"]
    os.makedirs(tmp_path / "none")
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, f"file://{tmp_path}/none")


def filtered_png(image, kinds):
    """A PNG whose lines are stored with the given filters."""
    h, w = image.shape[:2]
    step = 1 if image.ndim == 2 else image.shape[2]
    rows, above, out = image.reshape(h, -1).astype(int), np.zeros(w * step, int), b""
    for y in range(h):
        k, line = kinds[y % len(kinds)], rows[y]
        a, c = np.concatenate([np.zeros(step, int), line[:-step]]), np.concatenate([np.zeros(step, int), above[:-step]])
        p = a + above - c
        pa, pb, pc = abs(p - a), abs(p - above), abs(p - c)
        paeth = np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, above, c))
        out += bytes([k]) + ((line - [0, a, above, (a + above) // 2, paeth][k]) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[step], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


def test_pngs_and_frames(spark, tmp_path):
    r = np.random.default_rng(0)
    for shape in ((9, 7), (9, 7, 3), (6, 5, 4)):
        image = r.integers(0, 256, shape).astype(np.uint8)
        assert (readers.png(filtered_png(image, [0, 1, 2, 3, 4])) == image).all()
    deep = r.integers(0, 65536, (5, 6)).astype(np.uint16)
    assert (readers.png(readers.png_bytes(deep)) == deep).all() and (readers.png(readers.png_bytes(image[..., :3])) == image[..., :3]).all()
    readers.write_triples(spark, f"file://{tmp_path}/t", 3, 330, 370)
    rows = readers.read_triples(spark, f"file://{tmp_path}/t", 2).orderBy("frame_id").collect()
    assert [x.frame_id for x in rows] == ["00000", "00001"] and rows[0].bbox_2d == [200, 150, 360, 320] and abs(rows[0].depth[200 * 370 + 300] - 1.5) < 1e-6 and len(rows[0].rgb) == 330 * 370 * 3
    np.save(tmp_path / "k.npy", np.array([[5.0, 0, 1], [0, 6, 2], [0, 0, 1]]))
    at = lambda *p: f"file://{tmp_path}/" + "/".join(p)
    with readers.FrameSource(readers.load_frame(spark, at("t/image/00000.png"), at("t/depth/00000.png"), at("k.npy"))) as source:
        (frame,) = source
    assert frame["depth"].shape == (330, 370) and frame["intrinsics"] == [5.0, 6.0, 1.0, 2.0] and len(frame["rgb"]) == 330 * 370 * 3
    for rgb, depth in ((at("no.png"), at("t/depth/00000.png")), (at("t/image/00000.png"), at("no.npy")), (at("k.npy"), at("t/depth/00000.png"))):
        with pytest.raises(FileNotFoundError):
            readers.load_frame(spark, rgb, depth)
    assert readers.load_frame(spark).first().h == 100 and readers.read(spark, "synthetic", "", n=3).count() == 3 and readers.memory_gauges() == {}
    with pytest.raises(RuntimeError):
        readers.FrameSource(spark.range(1)).get_frame()


def test_mesh_files(spark, tmp_path):
    good = "OFF\n4 2 0\n0 0 0\n1 0 0\n1 1 0\n0 1 0\n4 0 1 2 3\n3 0 1 2\n"
    for name, text in (("b/train/x", good), ("b/train/y", "﻿OFF4 2 0\n" + good.split("\n", 2)[2]), ("a/train/z", "OFF\n1 0 0\n0 0 0\n"), ("a/train/w", "OFF\n4 1 0\n0 0 0\n"), ("a/test/v", good), ("c/train/u", "PLY")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f"{name}.off").write_text(text)
    rows = {r.name: r for r in readers.read_meshes(spark, f"file://{tmp_path}").collect()}
    assert {n: (r["class"], r.label, None if r.triangles is None else len(r.triangles)) for n, r in rows.items()} == {"x": ("b", 1, 3), "y": ("b", 1, 3), "z": ("a", 0, None), "w": ("a", 0, None), "u": ("c", 2, None)}
    assert [r.name for r in readers.read_meshes(spark, f"file://{tmp_path}", "test").collect()] == ["v"]


def test_sinks(spark, tmp_path):
    at = f"file://{tmp_path}"
    q = spark.createDataFrame([(1, "b", "k", '{"x": 1}', ["a"], "pending", 0, 2, None, None), (0, "a", "k", "{}", [], "running", 1, 2, "me", 5.0)], "pos int, name string, kind string, config string, requires array<string>, status string, retries int, max_retries int, owner string, heartbeat double")
    for _ in range(2):
        sinks.write_queue(q, f"{at}/q.yaml")
    back = readers.read_queue(spark, f"{at}/q.yaml").orderBy("pos").collect()
    assert [(r.name, r.status, r.config, r.requires, r.owner, r.heartbeat) for r in back] == [("a", "running", "{}", [], "me", 5.0), ("b", "pending", '{"x": 1}', ["a"], None, None)]
    sinks.write_json(spark.createDataFrame([("a", 1.5, 2), ("b", float("nan"), 3)], "k string, x double, n int"), f"{at}/r.json", "cells")
    assert json.loads((tmp_path / "r.json").read_text()) == {"cells": [{"k": "a", "n": 2, "x": 1.5}, {"k": "b", "n": 3}]}
    assert sinks.text_table(["a", "long"], [["wide cell", "x"]]) == ["a         | long", "----------+-----", "wide cell | x"]
    for step, more in ((1, {"loss": 0.5}), (2, {"lr": 0.1})):
        guard.append_log(spark, f"{at}/log", run="r", step=step, **more)
    last = guard.last_values(guard.read_log(spark, f"{at}/log"), "loss", "lr").first()
    assert (last.last_step, last.last_loss, last.last_lr) == (2, 0.5, 0.1)
    for _ in range(2):  # the second finds nothing new
        guard.write_log(guard.read_log(spark, f"{at}/log", True).select("run", "step", "loss"), f"{at}/copy", f"{at}/cp").awaitTermination(120)
    assert {r.step: r.loss for r in guard.read_log(spark, f"{at}/copy").collect()} == {1: 0.5, 2: None}
    made = []
    for _ in range(2):
        assert sinks.cached(spark, f"{at}/cache", lambda: made.append(1) or spark.range(3)).count() == 3
    assert len(made) == 1
    for k in range(2):
        sinks.append_rows(spark.createDataFrame([(k,)], "k int"), f"{at}/sessions")
    assert spark.read.parquet(f"{at}/sessions").count() == 2
    (tmp_path / "p.yaml").write_text("name: x\npaths: {data: '${HOME_OF:-/d}/a'}\ncorpus: {frames: 8, categories: 8, holdout_category_fraction: 0.25, shard_size: 4, image_hw: [64, 80]}\n")
    p = readers.read_profile(spark, f"{at}/p.yaml", {})
    assert p["paths"]["data"] == "/d/a" and p["corpus"].image_hw == (64, 80)
    with pytest.raises(ValueError):
        readers.Corpus(8, 8, 1.0, 4, (1, 1))


def test_boxes_are_checked(spark):
    df = lambda *b: spark.createDataFrame([b], "x_min int, y_min int, x_max int, y_max int")
    assert G.checked_box(df(0, 0, 1, 1)).count() == 1 and G.inside(df(-5, -5, 5, 5), 10, 10).first().x_max == 5
    for bad in (G.checked_box(df(-1, 0, 1, 1)), G.checked_box(df(0, 0, 0, 1)), G.inside(df(20, 0, 30, 5), 10, 10)):
        with pytest.raises(Exception, match="a box"):
            bad.collect()
    with pytest.raises(Exception, match="needs its distance"):
        spark.range(1).select(parsing.with_context(F.lit("p"), F.lit("s"), F.lit(None).cast("double"))).collect()
