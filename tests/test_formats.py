"""Data sources, the committed shard writer, the streamed ledger and claims with timers."""

import os
import tarfile
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.sources import formats, readers


def put(path, data):
    """A file, put in place whole."""
    draft = f"{path}.draft"
    with open(draft, "wb") as f:
        f.write(data)
    os.rename(draft, path)


def depth_files(folder, ids):
    os.makedirs(folder / "depth", exist_ok=True), os.makedirs(folder / "rgb", exist_ok=True)
    for i in ids:
        r = np.random.default_rng(i)
        image = r.integers(0, 255, (4, 6, 3)).astype(np.uint8)
        put(folder / f"rgb/{i:04d}.png", readers.png_bytes(image))
        depth = r.uniform(0.5, 3, (4, 6)).astype(np.float32)
        put(folder / f"depth/{i:04d}.{'npy' if i % 2 else 'png'}", readers.npy_bytes(depth) if i % 2 else readers.png_bytes((depth * 1000).astype(np.uint16)))


def shown(rows):
    return sorted((r.frame_id, r.h, r.w, r.depth, None if r.rgb is None else bytes(r.rgb), r.intrinsics, r.error) for r in rows)


def test_frames_as_batch(spark, tmp_path):
    depth_files(tmp_path, range(10))
    put(tmp_path / "k.npy", readers.npy_bytes(np.array([[5.0, 0, 2], [0, 6.0, 3], [0, 0, 1]])))
    put(tmp_path / "depth/0100.png", b"no picture")
    put(tmp_path / "depth/0101.npy", readers.npy_bytes(np.zeros(3)))
    put(tmp_path / "rgb/0100.png", readers.png_bytes(np.zeros((4, 6, 3), np.uint8)))
    df = formats.frames(spark, f"file://{tmp_path}/depth", rgb=f"file://{tmp_path}/rgb", intrinsics=f"file://{tmp_path}/k.npy", framesPerTask=5)
    assert df.rdd.getNumPartitions() == 3
    rows = {r.frame_id: r for r in df.collect()}
    assert len(rows) == 12 and rows["0100"].error and rows["0100"].depth is None and "dimensions" in rows["0101"].error
    plain = {r.frame_id: r for r in readers.read(spark, "depth", f"file://{tmp_path}/depth").collect()}
    assert plain["0100"].error and plain["0100"].depth is None and plain["0101"].error
    for i in range(10):
        image = np.random.default_rng(i).integers(0, 255, (4, 6, 3)).astype(np.uint8)
        r = rows[f"{i:04d}"]
        assert (r.h, r.w, bytes(r.rgb), r.intrinsics, r.error) == (4, 6, image.tobytes(), [5.0, 6.0, 2.0, 3.0], None) and r.depth == plain[f"{i:04d}"].depth
    assert readers.read(spark, "frames", f"{tmp_path}/depth").where("error IS NULL AND rgb IS NULL AND intrinsics IS NULL").count() == 10
    with pytest.raises(Exception, match="FileNotFound"):
        formats.frames(spark, f"file://{tmp_path}/nowhere").count()
    with pytest.raises(Exception, match="a frame at least"):
        formats.frames(spark, f"file://{tmp_path}/depth", framesPerTask=0).count()


def test_frames_as_a_stream_that_is_killed(spark, tmp_path):
    """A stream that dies inside a batch and is started again gives the rows of a batch read, each once."""
    depth_files(tmp_path, range(6))
    source, seen, broken = f"file://{tmp_path}/depth", [], [True]

    def sink(df, number):
        rows = df.collect()
        if number == 1 and broken[0]:
            raise RuntimeError("killed")
        seen.append((number, shown(rows)))

    def run():
        rows = formats.frames(spark, source, streaming=True, settle=0, framesPerTask=2, rgb=f"file://{tmp_path}/rgb")
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    run()
    assert [n for n, _ in seen] == [0] and len(seen[0][1]) == 6
    depth_files(tmp_path, range(6, 9))
    with pytest.raises(Exception, match="killed"):
        run()
    depth_files(tmp_path, range(9, 11))  # they come while the stream is down
    broken[0] = False
    run()
    assert [n for n, _ in seen][:2] == [0, 1] and [r[0] for r in seen[1][1]] == ["0006", "0007", "0008"]  # the batch that died, as it was planned
    run()
    got = sorted(r for _, rows in seen for r in rows)
    assert got == shown(formats.frames(spark, source, rgb=f"file://{tmp_path}/rgb").collect()) and len(got) == 11
    run()
    assert sum(len(rows) for _, rows in seen) == 11


def test_settling_files_wait(tmp_path):
    depth_files(tmp_path, range(3))
    options = {"path": f"file://{tmp_path}/depth", "settle": "3600"}
    old = tmp_path / "depth/0001.npy"
    os.utime(old, (1, 1))
    stream = formats.FrameStream(options)
    end = stream.latestOffset()
    assert [formats.stem(p) for g in stream.partitions(stream.initialOffset(), end) for p in g.paths] == ["0001"]
    again = formats.FrameStream({**options, "settle": "0"})  # after a restart
    assert [formats.stem(p) for g in again.partitions(end, again.latestOffset()) for p in g.paths] == ["0000", "0002"]


def some(part, parts):
    yield from ((i, f"row {i}") for i in range(part, 10, parts))


def test_samples_from_an_iterator(spark):
    df = formats.samples(spark, "tests.test_formats:some", "i int, text string", 3)
    assert df.rdd.getNumPartitions() == 3 and sorted(map(tuple, df.collect())) == [(i, f"row {i}") for i in range(10)]


def members(spark, n):
    return spark.range(n).select(F.col("id").alias("frame_idx"), F.create_map(F.lit("a.bin"), F.encode(F.concat(F.lit("x"), F.col("id")), "utf-8"), F.lit("meta.json"), F.encode(F.lit("{}"), "utf-8")).alias("members")).repartition(5)


def test_shards_are_committed_together(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    bad = members(spark, 40).withColumn("members", F.when(F.col("frame_idx") == 37, F.create_map(F.lit("a.bin"), F.raise_error(F.lit("lost")).cast("binary"))).otherwise(F.col("members")))
    with pytest.raises(Exception, match="lost"):
        readers.write_shards(bad, root, 4)
    assert not (tmp_path / "out").exists() or os.listdir(tmp_path / "out") == []
    done = readers.write_shards(members(spark, 40), root, 4).orderBy("shard").collect()
    assert [(r.shard, r.n) for r in done] == [(i, 4) for i in range(10)]
    before = {f: (tmp_path / "out" / f).read_bytes() for f in sorted(os.listdir(tmp_path / "out"))}
    assert [*before] == [f"shard-{i:06d}.tar" for i in range(10)]
    with pytest.raises(Exception, match="lost"):  # what is there stays
        readers.write_shards(bad, root, 4)
    readers.write_shards(members(spark, 40).repartition(3), root, 4)
    assert {f: (tmp_path / "out" / f).read_bytes() for f in sorted(os.listdir(tmp_path / "out"))} == before
    with tarfile.open(tmp_path / "out/shard-000009.tar") as tar:
        assert tar.getnames() == [f"{i:08d}.{s}" for i in range(36, 40) for s in ("a.bin", "meta.json")]
    formats.register(spark)
    apart = members(spark, 40).withColumn("shard", F.lit(1).cast("long")).repartition(4, "frame_idx")
    with pytest.raises(Exception, match="stand together"):
        apart.write.format("shards").mode("append").save(root)
    assert sorted(os.listdir(tmp_path / "out")) == [*before]


def test_broken_shards_are_rows(spark, tmp_path):
    os.makedirs(tmp_path / "s")
    put(tmp_path / "s/shard-000000.tar", b"no tar at all")
    ok = {"corrupted_depth.npy": readers.npy_bytes(np.ones((2, 2))), "meta.json": b'{"split": "heldout"}'}
    rows = spark.createDataFrame([(0, ok), (1, {**ok, "meta.json": b"{"}), (2, {**ok, "corrupted_depth.npy": b"x"})], "frame_idx long, members map<string, binary>")
    readers.write_shards(rows.withColumn("frame_idx", F.col("frame_idx") + 10), f"file://{tmp_path}/s", 10)
    got = {(r.shard, r.stem): r.error for r in readers.read_shards(spark, f"file://{tmp_path}/s").collect()}
    assert len(got) == 4 and got["shard-000001.tar", "00000010"] is None and sum(e is not None for e in got.values()) == 3


def ledger_rows(spark, n=400):
    key = F.concat(F.lit("k"), F.col("id") % 37)
    return spark.range(n).select(key.alias("config_hash"), ((F.col("id") * 7919) % n).alias("seq"), F.col("id").alias("id"), (F.col("id") * 2).alias("score"), F.lit(1).cast("long").alias("n_writes"))


def test_streamed_ledger_survives_a_kill(spark, tmp_path):
    """A stream that dies after the ledger has a batch, and before its own checkpoint has it, gives what one batch over all rows gives."""
    from plumbline.streaming.upsert import Ledger

    root, source = f"file://{tmp_path}", f"file://{tmp_path}/in"
    ledger_rows(spark).repartition(8).write.parquet(source)
    make = lambda name: Ledger(spark, f"{root}/{name}", added=("n_writes",), buckets=5)
    streamed, deaths = make("streamed"), [2, 5]

    def run():
        put_batch = streamed.sink("results")

        def sink(batch, number):
            put_batch(batch, number)
            if deaths and number == deaths[0]:
                deaths.pop(0)
                raise RuntimeError("killed")

        rows = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
        rows.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    for _ in range(2):
        with pytest.raises(Exception, match="killed"):
            run()
    run()
    whole = make("whole")
    assert whole.read() is None and whole.apply(ledger_rows(spark), "all", 0) and not whole.apply(ledger_rows(spark), "all", 0)
    show = lambda df: sorted(map(tuple, df.select("config_hash", "seq", "id", "score", "n_writes").collect()))
    assert show(streamed.read()) == show(whole.read()) and streamed.version()["batches"] == {"results": 7}
    want = {}
    for r in sorted(ledger_rows(spark).collect(), key=lambda r: r.seq):
        first, n = want.get(r.config_hash, (r.id, 0, 0))[0], want.get(r.config_hash, (0, 0))[1]
        want[r.config_hash] = (first, n + 1, r.seq, r.score)
    assert show(whole.read()) == sorted((k, s, i, score, n) for k, (i, n, s, score) in want.items())
    old = streamed.version()["number"] - 1
    assert streamed.read(old).count() > 0 and streamed.vacuum() > 0 and show(streamed.read()) == show(whole.read()) and len(streamed.versions()) == 1


def test_ledger_writers_and_buckets(spark, tmp_path):
    from plumbline.streaming import upsert

    ledger = upsert.Ledger(spark, f"file://{tmp_path}/l", buckets=8)
    one = lambda key, seq: spark.createDataFrame([(key, seq, seq)], "config_hash string, seq long, id long")
    assert ledger.apply(one("a", 1), "s", 0) and ledger.apply(one("b", 1), "s", 1) and ledger.apply(one("a", 3).limit(0), "s", 2)
    v = ledger.version()
    assert len(set(v["folders"].values())) == 2 and v["batches"] == {"s": 2}
    before = v["folders"]
    assert ledger.apply(one("a", 2), "s", 3)
    after = ledger.version()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1  # the other bucket isn't rewritten
    assert upsert.Ledger(spark, f"file://{tmp_path}/l", buckets=3).buckets == 8
    assert sorted(map(tuple, ledger.read().collect())) == [("a", 2, 1), ("b", 1, 1)]
    real = ledger.version
    ledger.version = lambda number=None: {**real(number), "number": 0, "batches": {}}
    with pytest.raises(upsert.Conflict):
        ledger.apply(one("c", 1), "s", 9)
    ledger.version = real
    with pytest.raises(Exception, match="without config_hash"):
        ledger.apply(one(None, 1), "s", 10)
    assert ledger.read().count() == 2


def test_claims_run_out_without_rows(spark, tmp_path):
    """A claim that isn't renewed is pending after its time, though nothing comes in; one that is renewed isn't."""
    from plumbline.streaming import claims

    os.makedirs(tmp_path / "events")
    number = iter(range(99))

    def send(*events):
        lines = "".join(f'{{"name": "{n}", "owner": "{o}", "kind": "{k}", "outcome": {x}, "at": {at}}}\n' for n, o, k, x, at in events)
        put(tmp_path / f"events/{next(number):03d}.json", lines.encode())

    seen = []
    send(("a", "w1", "claim", "null", 1.0), ("b", "w1", "claim", "null", 1.0), ("a", "w2", "claim", "null", 2.0), ("c", "w1", "claim", "null", 1.0), ("c", "w1", "release", '"failed"', 2.0), ("d", "w1", "beat", "null", 1.0))
    rows = claims.claims(spark.readStream.schema(claims.EVENTS).json(f"file://{tmp_path}/events"), 8.0)
    with claims.configured(spark):
        q = rows.writeStream.foreachBatch(lambda df, n: seen.extend((time.time(), *r) for r in df.collect())).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(processingTime="1 second").start()
    try:
        def wait(event, seconds=60):
            end = time.time() + seconds
            while not any(s[4] == event for s in seen) and time.time() < end and q.isActive:
                time.sleep(0.2)

        wait("claim")
        first = {(s[1], s[4]) for s in seen}
        assert first == {("a", "claim"), ("a", "refused"), ("b", "claim"), ("c", "claim"), ("c", "release"), ("d", "refused")}
        for k in range(3):  # b is renewed
            send(("b", "w1", "beat", "null", 2.0 + k))
            time.sleep(3)
        wait("expired")
        gone = [s[1:] for s in seen if s[4] == "expired"]
        assert gone[:1] == [("a", None, "pending", "expired", 0)] and "b" not in {g[0] for g in gone}
        end = time.time() + 40
        while sum(s[4] == "expired" for s in seen) < 2 and time.time() < end:
            time.sleep(0.2)
        assert [s[1] for s in seen if s[4] == "expired"] == ["a", "b"]
    finally:
        q.stop()


def test_claims_follow_the_queue():
    from plumbline.streaming.claims import transition

    state = ("pending", None, 0)
    for event, want in ((("w", "claim", None), ("running", "w", 0)), (("v", "claim", None), ("running", "w", 0)), (("v", "beat", None), ("running", "w", 0)), (("w", "release", "failed"), ("pending", None, 1)), (("w", "claim", None), ("running", "w", 1)), (("w", "release", "preempted"), ("pending", None, 1)), (("w", "claim", None), ("running", "w", 1)), (("w", "release", "failed"), ("failed", None, 2)), (("w", "claim", None), ("failed", None, 2))):
        state, _ = transition(state, *event, 1)
        assert state == want, event
    assert transition(("running", "w", 0), "w", "release", "lost", 1) == (("running", "w", 0), "refused")
    assert transition(("running", "w", 0), "w", "release", "completed", 1)[0] == ("done", None, 0)


def test_guard_passes_lines_without_a_loss(spark, tmp_path):
    from plumbline.streaming import guard

    lines = [("r", i, None if i % 3 == 0 else 1.0 / (i + 1)) for i in range(12)] + [("s", 0, None), ("s", 1, 2.0)]
    log = spark.createDataFrame(lines, guard.LOG)
    rows = guard.guard_batch(log).collect()
    whole = guard.guard_batch(log.where("loss IS NOT NULL")).collect()
    assert sorted(map(tuple, (r for r in rows if r.event))) == sorted(map(tuple, whole)) and sum(r.event is None for r in rows) == 5
    log.coalesce(1).write.json(f"file://{tmp_path}/log")
    out = []
    q = guard.guard_stream(spark.readStream.schema(guard.LOG).json(f"file://{tmp_path}/log")).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, out)) == sorted(map(str, rows))


def test_model_is_asked_once(spark, tmp_path):
    """Each request meets the model once, in batches, whatever is done with its answer; a box outside its image is one request's failure."""
    from plumbline.operators import geometry as G
    from plumbline.plans import ground

    os.makedirs(tmp_path / "asked")

    def load(folder=str(tmp_path / "asked")):
        import uuid

        def model(prompts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(p.split("'")[1] for p in prompts))
            said = {"far": '{"bbox_2d": [5, 5, 9, 9]}', "none": "nothing"}
            return [said.get(p.split("'")[1].split(" ")[0], '{"bbox_2d": [1, 1, 4, 3]}') for p in prompts]

        return model

    frames = spark.createDataFrame([(i, 4, 5, [2.0 + 0.01 * j for j in range(20)]) for i in range(3)], "frame_id long, h int, w int, depth array<float>")
    names = ["box", "none", "far"]
    asked = spark.createDataFrame([(i, i % 3, f"{names[i % 3]} {i}", 100, 100, "{}", "c", "s", "x", 0.0, [1, 1, 4, 3], [[0.0, 0.0, 2.0], [1.0, 1.0, 2.5]]) for i in range(24)], "req_id long, frame_id long, query string, width int, height int, meta string, category string, split string, source string, severity double, bbox_2d array<int>, aabb_3d array<array<double>>")
    k, ask = G.Intrinsics(5.0, 5.0, 2.0, 2.0), ground.answered(ground.served(load, 4))

    def calls():
        out = [f.read_text().split("\n") for f in (tmp_path / "asked").iterdir()]
        for f in (tmp_path / "asked").iterdir():
            f.unlink()
        return out

    rows = {r.req_id: r for r in ground.grounded(asked.repartition(3), frames, ask, k, ground.naive).collect()}
    made = calls()
    assert sorted(x for c in made for x in c) == sorted(f"{names[i % 3]} {i}" for i in range(24)) and max(map(len, made)) <= 4
    assert all(rows[i].success == (i % 3 == 0) and rows[i].error == [None, ground.NO_BOX, ground.NO_LIFT][i % 3] for i in range(24))
    both = ground.evaluated(asked, frames, ask, k, "both").collect()
    assert len(both) == 48 and sum(map(len, calls())) == 24


def test_places_without_one_task(spark):
    from plumbline import core
    from plumbline.plans import ledger as L, training

    r = np.random.default_rng(5)
    data = [(None if i % 11 == 0 else int(i % 4), float(r.integers(0, 30)), i) for i in range(900)]
    df = spark.createDataFrame(data, "g int, x double, id long").repartition(7)
    got = core.numbered(df, [F.desc("x"), F.col("id")]).collect()
    assert [(n, i) for n, (_, i) in enumerate(sorted((-x, i) for _, x, i in data), 1)] == sorted((y.number, y.id) for y in got)
    place = {y.id: (y.place, y.n) for y in core.ranked(df, "g", [F.asc("x"), F.col("id")]).collect()}
    for g in (None, 0, 1, 2, 3):
        ids = [i for _, i in sorted((x, i) for h, x, i in data if h == g)]
        assert [place[i] for i in ids] == [(p, len(ids)) for p in range(1, len(ids) + 1)]
    plan = training.resumed(df, ["id"], 5)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and training.resumed(df, ["id"], 5).count() == 895 and core.numbered(df.limit(0), ["id"]).count() == 0
    led = spark.createDataFrame([(i, "h", "done", f'{{"max_steps": {10 ** (i % 2)}, "a": {i}}}', f"x{i}", i, float(i % 5)) for i in range(30)], "id long, hypothesis string, status string, config_json string, config_hash string, created_at long, loss double")
    up = L.promotions(led, "h", (1, 10, 100), "loss")
    text = up._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in text and "ArrowEvalPython" in text and up.count() == 10
    assert all(L.config_hash({"a": x.id, "max_steps": (10, 100)[x.rung]}) == x.config_hash for x in up.collect())


def test_closed_meshes(spark):
    """Two cubes that share a vertex, and one with a face turned round, are not closed."""
    from plumbline.operators import shape as S

    cube = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    beside = [tuple(x + 8 for x in f) for f in cube]
    touching = [tuple(0 if x == 8 else x for x in f) for f in beside]
    meshes = {0: cube, 1: cube[:-1], 2: [(0, 1, 2), *cube[1:]], 3: cube + beside, 4: cube + touching, 5: cube + cube, 6: [(0, 0, 1)], 7: [tuple(reversed(f)) for f in cube]}
    df = spark.createDataFrame([(m, n, *f) for m, faces in meshes.items() for n, f in enumerate(faces)], "mesh_id int, fid int, i int, j int, k int").repartition(5)
    assert {r.mesh_id: r.closed for r in S.watertight(df).collect()} == {0: True, 1: False, 2: False, 3: True, 4: False, 5: False, 6: False, 7: True}


def test_nearest_over_cells(spark, monkeypatch):
    """A cloud cut over many cells and parts gives the distances that all pairs give: outliers, equal points, lines and single points included."""
    from plumbline.operators import cloud

    r = np.random.default_rng(8)
    clouds = {
        1: np.concatenate([r.normal(size=(300, 3)), [[40.0, 0, 0], [0, 90.0, 1], [0, 90.0, 1]]]), 2: np.repeat(r.normal(size=(3, 3)), 30, axis=0), 3: np.stack([np.arange(50.0), np.zeros(50), np.zeros(50)], 1),
        4: np.zeros((1, 3)), 5: r.uniform(size=(2, 3)),
    }
    rows = [(c, i, *map(float, p)) for c, ps in clouds.items() for i, p in enumerate(ps)] + [(1, 9000, None, 0.0, 0.0), (1, 9001, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "cloud_id long, pt_id long, x double, y double, z double").repartition(3)
    monkeypatch.setattr(cloud, "PART", 7)
    got = {(x.cloud_id, x.pt_id): x.d for x in cloud.nearest_others(df, 4).collect()}
    assert len(got) == sum(map(len, clouds.values()))
    for c, ps in clouds.items():
        for i, p in enumerate(ps):
            want = np.sort(np.linalg.norm(np.delete(ps, i, 0) - p, axis=1))[:4]
            assert np.allclose(got[c, i], want, atol=1e-12), (c, i)
    assert cloud.nearest_others(df.limit(0), 2).count() == 0
    near = {x.cloud_id: x.mean_nn for x in cloud.neighbour_distances(df).collect()}
    assert near[4] == 0.05 and near[3] == 1
    kept = cloud.unstrayed(df, 4).groupBy("cloud_id").count().collect()
    assert {x.cloud_id: x["count"] for x in kept}[1] == len(clouds[1]) - 3


def test_tiles_equal_whole_frames(spark):
    """Kernels over small tiles with halos give what they give over whole frames, borders, voids and outliers included."""
    from plumbline.operators import raster as R

    r, frames = np.random.default_rng(9), {}
    for i, (h, w) in enumerate(((100, 100), (7, 90), (33, 16))):
        d = 2 + 0.01 * r.normal(size=(h, w)) + np.arange(w) / 200
        d[r.uniform(size=(h, w)) < 0.3] = 0
        d[h // 4 : h // 4 + 30, w // 4 : w // 4 + 30] = 0
        d.ravel()[r.integers(0, h * w, 9)] += 0.7 * (d.ravel()[r.integers(0, h * w, 9)] > 0)
        frames[i] = d
    frames[3] = np.zeros((20, 20))
    rows = [(i, v, u, float(d[v, u])) for i, d in frames.items() for v in range(d.shape[0]) for u in range(d.shape[1])]
    px = spark.createDataFrame(rows, "frame_id long, v int, u int, depth double").repartition(5).cache()

    def image(df, name):
        out = {i: np.zeros(d.shape) for i, d in frames.items()}
        got = df.select("frame_id", "v", "u", name).collect()
        for x in got:
            out[x.frame_id][x.v, x.u] = x[name]
        assert len(got) == len(rows)
        return out

    small = {
        "smooth": (R.bilateral_smooth(px, "depth", tile=16), R.bilateral_kernel), "closed": (R.closed_pixels(px, tile=16), R.close_kernel),
        "inpainted": (R.inpainted_pixels(px, tile=16), R.inpaint_kernel), "restored": (R.restored_pixels(px, tile=16), R.restore_kernel),
    }
    for name, (df, kernel) in small.items():
        for i, got in image(df, name).items():
            assert np.allclose(got, kernel(frames[i]), atol=1e-9), (name, i)
    with pytest.raises(ValueError, match="halo"):
        R.bilateral_smooth(px, "depth", tile=3)


def test_default_space_and_grid(spark):
    from plumbline.plans import ledger as L

    rows = L.default_grid(spark).orderBy("pos").collect()
    assert len(rows) == 12 and rows[0].name == "lora-r8-cur=curriculum-vocab=wide" and rows[-1].name == "lora-r32-cur=uniform-vocab=narrow" and {tuple(r.requires) for r in rows} == {("datagen-mini",)}
    schema = "id long, hypothesis string, status string, config_json string, config_hash string, created_at long, ema_loss double"
    empty = spark.createDataFrame([], schema)
    queue = L.default_grid(spark).limit(0)
    made = L.default_scheduler().proposals(queue, empty)
    assert len(made) == 3 and all(m["name"].startswith("h8-lora-") and m["config"]["max_steps"] == 250 and m["config"]["rank"] in (4, 8, 16, 32) and 5e-5 <= m["config"]["learning_rate"] <= 5e-4 for m in made)
    assert made == L.default_scheduler().proposals(queue, empty)
