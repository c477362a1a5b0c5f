"""Readers of frames, shards, queue files and telemetry, and the writers that go with them."""

from __future__ import annotations

import io
import json
import os
import re
import struct
import tarfile
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..core import file_system, fresh_path, spread
from ..functions import parsing
from . import formats

FRAMES = "frame_id string, h int, w int, depth array<float>"
READERS: dict = {}


def reader(name: str):
    """Registers a reader under a format name."""
    def add(f):
        if name in READERS:
            raise ValueError(f"reader {name} exists")
        READERS[name] = f
        return f

    return add


def read(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    if kind not in READERS:
        raise ValueError(f"unknown source {kind}")
    return READERS[kind](spark, path, **options)


class FrameSource:
    """Frames one at a time from any DataFrame of them: connect, get_frame until None, close; also a context and an iterator.

    Rows come through the driver's local iterator, a partition at a time.
    """

    def __init__(self, frames: DataFrame):
        self.frames, self.rows = frames, None

    def connect(self) -> FrameSource:
        self.rows = self.frames.toLocalIterator(prefetchPartitions=True)
        return self

    def get_frame(self) -> dict | None:
        if self.rows is None:
            raise RuntimeError("connect first")
        row = next(self.rows, None)
        return None if row is None else {**row.asDict(), "depth": np.asarray(row.depth, np.float32).reshape(row.h, row.w)}

    def close(self) -> None:
        self.rows = None

    def __enter__(self) -> FrameSource:
        return self.connect()

    def __exit__(self, *_) -> None:
        self.close()

    def __iter__(self):
        while (frame := self.get_frame()) is not None:
            yield frame


CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def png(data: bytes) -> np.ndarray:
    """A PNG of 8 or 16 bits, grey or in colour, with or without alpha, not interlaced: h x w, or h x w x channels."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, body, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            head = struct.unpack_from(">IIBBBBB", data, at + 8)
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    if head is None:
        raise ValueError("a PNG without a header")
    w, h, bits, colour, _, _, lace = head
    if colour not in CHANNELS or bits not in (8, 16) or lace:
        raise ValueError("only PNGs of 8 or 16 bits without palette and interlacing are read")
    step, size = CHANNELS[colour] * bits // 8, w * CHANNELS[colour] * bits // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(h, 1 + size)
    out, above = np.zeros((h, size), np.uint8), np.zeros(size, np.uint8)
    for y, (kind, *_) in enumerate(raw[:, :1].tolist()):
        line = raw[y, 1:]
        if kind == 1:  # differences to the pixel before: sums along each channel
            line = np.cumsum(line.reshape(-1, step), 0, np.uint8).reshape(-1)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = chained(line.tolist(), above.tolist(), step, kind)
        out[y] = above = line
    image = out.view(">u2").astype(np.uint16) if bits == 16 else out
    return image.reshape(h, w) if colour == 0 else image.reshape(h, w, -1)


def chained(line: list[int], above: list[int], step: int, kind: int) -> np.ndarray:
    """A line whose bytes were stored as differences to the mean (3) or the likeliest (4) of the bytes before, above and before that: each needs the last."""
    out, above = [0] * step, [0] * step + above
    for x, d in enumerate(line):
        a, b, c = out[x], above[x + step], above[x]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out.append((d + guess) & 255)
    return np.array(out[step:], np.uint8)


def png_grey(data: bytes) -> np.ndarray:
    image = png(data)
    if image.ndim != 2:
        raise ValueError("depth is a grey PNG")
    return image


def png_bytes(image: np.ndarray) -> bytes:
    """A PNG of an 8- or 16-bit grey or 8-bit RGB image."""
    wide, colour = image.dtype == np.uint16, 0 if image.ndim == 2 else 2
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = (image.astype(">u2") if wide else image.astype(np.uint8)).reshape(image.shape[0], -1).view(np.uint8).reshape(image.shape[0], -1)
    raw = np.column_stack([np.zeros(len(lines), np.uint8), lines]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 16 if wide else 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def npy_bytes(x: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, x)
    return out.getvalue()


def decoded(path: str, content: bytes) -> np.ndarray:
    """Metres: .npy as it is, .png in millimetres."""
    return np.load(io.BytesIO(content)).astype(np.float32) if path.endswith(".npy") else (png_grey(content) / 1000.0).astype(np.float32)


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (rows.option("pathGlobFilter", glob) if glob else rows).load(path).select("path", "content")


@reader("frames")
def read_frames(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """Frames with their pictures and lenses, as formats.FRAME names their columns; what can't be read has an `error`."""
    return formats.frames(spark, path, **options)


@reader("depth")
def read_depth(spark: SparkSession, path: str) -> DataFrame:
    """Dense frames from .npy and 16-bit .png files under path, one task per few files. A file that can't be read is a row with `error` and no pixels."""
    found = files(spark, path).where(F.col("path").rlike(r"\.(npy|png)$"))
    schema = StructType.fromDDL(f"{FRAMES}, error string")
    kind = to_arrow_schema(schema)

    def one(path: str, content: bytes) -> tuple:
        try:
            image = decoded(path, content)
            if image.ndim != 2:
                raise ValueError("depth has two dimensions")
            return formats.stem(path), *map(int, image.shape), image.ravel(), None
        except formats.DAMAGE as e:
            return formats.stem(path), None, None, None, f"{type(e).__name__}: {e}"

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(one(path.as_py(), content.as_py()), kind, strict=True)], schema=kind)

    return found.mapInArrow(run, schema)


RGBD = "frame_id string, h int, w int, rgb binary, depth array<float>, intrinsics array<double>"


@reader("rgbd")
def read_rgbd(spark: SparkSession, path: str, depth: str, intrinsics: str | None = None) -> DataFrame:
    """One frame from an RGB PNG (or none, where path is empty), its depth (.npy, or .png in millimetres) and its intrinsics (.npy).

    A file that is missing or can't be read is a FileNotFoundError, the image's first.
    """
    out = {}
    for name, at in (("rgb", path), ("depth", depth), ("intrinsics", intrinsics)):
        if not at:
            out[name] = None
            continue
        fs, p = file_system(spark, at)
        try:
            content = bytes(files(spark, at).first().content) if fs.exists(p) else None
            out[name] = None if content is None else png(content) if name == "rgb" else decoded(at, content) if name == "depth" else np.load(io.BytesIO(content))
        except (ValueError, zlib.error, struct.error) as e:
            raise FileNotFoundError(f"{at} can't be read") from e
        if out[name] is None:
            raise FileNotFoundError(at)
    d, rgb, k = out["depth"], out["rgb"], out["intrinsics"]
    if k is not None and k.shape == (3, 3):
        k = np.array([k[0, 0], k[1, 1], k[0, 2], k[1, 2]])
    row = (os.path.basename(depth).split(".", 1)[0], *map(int, d.shape), None if rgb is None else bytearray(rgb[..., :3].astype(np.uint8).tobytes()), d.ravel().tolist(), None if k is None else [float(x) for x in k.ravel()[:4]])
    return spark.createDataFrame([row], RGBD)


def load_frame(spark: SparkSession, rgb: str | None = None, depth: str | None = None, intrinsics: str | None = None, **made) -> DataFrame:
    """The frame in the given files, or a made one where there are none."""
    if depth:
        return read_rgbd(spark, rgb or "", depth, intrinsics)
    return synthetic_frames(spark, 1, **{"h": 100, "w": 100, "depth": 2.0, **made})


SAMPLES = (
    "shard string, stem string, split string, category string, query_text string, severity double, bbox_2d array<int>, aabb_3d array<array<double>>, intrinsics array<double>, meta string, rgb binary, "
    "clean_h int, clean_w int, clean array<float>, corrupted array<float>, rgb_h int, rgb_w int, error string"
)


@reader("shards")
def read_shards(spark: SparkSession, path: str, split: str = "heldout", max_samples: int | None = None) -> DataFrame:
    """Complete samples of tar shards in order of shard and stem; the limit counts rows after the split filter, and split "all" takes any.

    A shard or sample that can't be read is a row with `error`, whatever the split.
    """
    found = files(spark, path, "*.tar")
    if found.isEmpty():
        raise FileNotFoundError(f"no shards under {path}")
    schema = StructType.fromDDL(SAMPLES)
    kind = to_arrow_schema(schema)

    def samples(content: bytes):
        members: dict[str, dict[str, bytes]] = {}
        with tarfile.open(fileobj=io.BytesIO(content)) as tar:
            for m in tar:
                if m.isfile():
                    stem, _, suffix = os.path.basename(m.name).partition(".")
                    members.setdefault(stem, {})[suffix] = tar.extractfile(m).read()
        return sorted(members.items())

    def sample(stem: str, parts: dict[str, bytes]) -> tuple:
        meta = json.loads(parts["meta.json"])
        bad = np.load(io.BytesIO(parts["corrupted_depth.npy"])).astype(np.float32)
        clean = np.load(io.BytesIO(parts["clean_depth.npy"])).astype(np.float32).ravel().tolist() if "clean_depth.npy" in parts else None
        rgb = png(parts["rgb.png"])[..., :3].astype(np.uint8) if "rgb.png" in parts else None
        text = lambda name: None if meta.get(name) is None else str(meta[name])
        list_of = lambda name, f: None if meta.get(name) is None else [f(x) for x in meta[name]]
        return (
            stem, text("split"), text("category"), text("query_text"), float((meta.get("corruption_params") or {}).get("void_ratio", 0.0)), list_of("bbox_2d", int),
            list_of("aabb_3d", lambda p: [float(x) for x in p]), list_of("intrinsics", float), parts["meta.json"].decode(), None if rgb is None else rgb.tobytes(), *map(int, bad.shape), clean, bad.ravel().tolist(),
            *((None, None) if rgb is None else map(int, rgb.shape[:2])), None,
        )

    def rows_of(content: bytes):
        broken = lambda stem, e: (stem, *[None] * (len(kind) - 3), f"{type(e).__name__}: {e}")
        try:
            found = samples(content)
        except formats.DAMAGE as e:
            yield broken(None, e)
            return
        for stem, parts in found:
            if {"corrupted_depth.npy", "meta.json"} <= parts.keys():
                try:
                    yield sample(stem, parts)
                except formats.DAMAGE as e:
                    yield broken(stem, e)

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for row in rows_of(content):
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((os.path.basename(path), *row), kind, strict=True)], schema=kind)

    rows = found.mapInArrow(run, schema)
    if split != "all":
        rows = rows.where((F.col("split") == split) | F.col("error").isNotNull())
    return rows if max_samples is None else rows.orderBy("shard", "stem").limit(max_samples)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(shard, stem, suffix, body) of all files in tar shards, shard being the number in the tar's name."""
    found = files(spark, path, "*.tar").select(F.regexp_extract("path", r"(\d+)\.tar$", 1).try_cast("long").alias("shard"), "content")

    def run(batches):
        for b in batches:
            for shard, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with tarfile.open(fileobj=pa.input_stream(content.as_buffer())) as tar:
                    rows = [(shard, *os.path.basename(m.name).partition(".")[::2], tar.extractfile(m).read()) for m in tar if m.isfile()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)], ["shard", "stem", "suffix", "body"])

    return found.mapInArrow(run, "shard long, stem string, suffix string, body binary")


def preview(samples: DataFrame, n: int) -> DataFrame:
    """The first n samples with a picture and a clean depth, in order of shard and stem."""
    return samples.where("rgb IS NOT NULL AND clean IS NOT NULL").orderBy("shard", "stem").limit(n)


def write_shards(samples: DataFrame, path: str, shard_size: int, first: int = 0) -> DataFrame:
    """(shard, n, path) of tar files of shard_size samples each, from shard `first` on.

    samples: frame_idx and `members`, a map of file suffixes to bytes. A shard's bytes follow
    from its samples alone. All shards get their names when all are written: a job that
    fails leaves none, and one that is repeated, or goes on from the first shard that is missing,
    gives the same files.
    """
    if shard_size <= 0:
        raise ValueError("shard_size must be positive")
    spark, manifest = samples.sparkSession, fresh_path(samples.sparkSession, "shards")
    formats.register(spark)
    shard = F.floor(F.col("frame_idx") / shard_size).cast("long")
    rows = samples.select(shard.alias("shard"), "frame_idx", "members").where(F.col("shard") >= first)
    rows = spread(rows, "shard").sortWithinPartitions("shard", "frame_idx")
    rows.write.format("shards").options(manifest=manifest).mode("append").save(path)
    return spark.read.schema("shard long, n long, path string").json(manifest)


def n_shards(frames: int, shard_size: int) -> int:
    """Shards that so many frames make, the last of them maybe smaller."""
    return -(-frames // shard_size)


def sample_members(frames: DataFrame) -> DataFrame:
    """(frame_idx, members) for write_shards from made frames (operators.compose)."""

    def run(it):
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                grid = lambda x, kind, r=r: np.asarray(x, kind).reshape(r.h, r.w)
                meta = {"frame_idx": int(r.frame_id), "category": r.category, "query_text": r.query_text, "split": r.split, **{k: json.loads(v) for k, v in (("bbox_2d", r.box), ("aabb_3d", r.truth), ("aabb_3d_lifted_clean", r.lifted), ("intrinsics", r.k), ("corruption_params", r.params)) if v}}
                rgb = np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3)
                out.append({"rgb.png": png_bytes(rgb), "clean_depth.npy": npy_bytes(grid(r.clean, np.float32)), "corrupted_depth.npy": npy_bytes(grid(r.corrupted, np.float32)), "instance.png": png_bytes(grid(r.instance, np.uint16)), "meta.json": json.dumps(meta, sort_keys=True).encode()})
            yield pd.DataFrame({"frame_idx": pdf.frame_id, "members": out})

    text = {"box": "bbox_2d", "truth": "aabb_3d", "lifted": "aabb_3d_lifted_clean", "k": "intrinsics", "params": "corruption_params"}
    return frames.select("*", *(F.to_json(c).alias(n) for n, c in text.items())).mapInPandas(run, "frame_idx long, members map<string, binary>")


def write_triples(spark: SparkSession, root: str, n: int = 8, h: int = 480, w: int = 640, seed: int = 0) -> None:
    """A small corpus of image, depth (millimetres) and meta files of one near box on a rough ground, for tests of real-like scans. Its box, distances and lens."""
    r, (x0, y0, x1, y1), f = np.random.default_rng(seed), (200, 150, 360, 320), 525.0
    fs, base = pafs.FileSystem.from_uri(root)
    for kind in ("image", "depth", "meta"):
        fs.create_dir(f"{base}/{kind}", recursive=True)
    for i in range(n):
        rgb = r.integers(0, 255, (h, w, 3)).astype(np.uint8)
        depth = r.uniform(0.5, 3.0, (h, w))
        depth[y0:y1, x0:x1] = 1.5
        corners = [[(x - w / 2) / f * z, (y - h / 2) / f * z, z] for z in (1.4, 1.6) for y in (y0, y1) for x in (x0, x1)]
        meta = {"label": "chair", "category": "chair", "query_text": "the chair", "bbox_2d": [x0, y0, x1, y1], "aabb_3d": corners, "intrinsics": [f, f, w / 2, h / 2]}
        for kind, suffix, body in (("image", "png", png_bytes(rgb)), ("depth", "png", png_bytes((depth * 1000).astype(np.uint16))), ("meta", "json", json.dumps(meta).encode())):
            with fs.open_output_stream(f"{base}/{kind}/{i:05d}.{suffix}") as out:
                out.write(body)


def off_mesh(text: str) -> tuple[list[list[float]], list[list[int]]] | None:
    """(vertices, triangles) of an OFF file, whose header may have lost its line break; None if it holds no triangle. Larger faces are cut into fans."""
    body = text.lstrip("\ufeff \t")
    if not body.startswith("OFF"):
        return None
    words = [x for line in body[3:].splitlines() for x in line.split("#", 1)[0].split()]
    try:
        nv, nf = int(words[0]), int(words[1])
        v = np.array(words[3 : 3 + 3 * nv], float).reshape(nv, 3)
        at, faces = 3 + 3 * nv, []
        for _ in range(nf):
            k = int(words[at])
            face = [int(x) for x in words[at + 1 : at + 1 + k]]
            if len(face) < k or any(not 0 <= x < nv for x in face):
                return None
            faces += [[face[0], face[j], face[j + 1]] for j in range(1, k - 1)]
            at += 1 + k
    except (ValueError, IndexError):
        return None
    return (v.tolist(), faces) if faces and nv else None


@reader("meshes")
def read_meshes(spark: SparkSession, path: str, split: str = "train") -> DataFrame:
    """(class, label, name, vertices, triangles) of <class>/<split>/*.off files; label is the class's place by name. Files that can't be read have null triangles, so they can be counted."""
    found = files(spark, path, "*.off").select(F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)$", 1).alias("class"), F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)$", 2).alias("split"), parsing.stem(F.col("path")).alias("name"), "content")
    names = found.select("class").distinct()
    labels = names.withColumn("label", F.row_number().over(W.orderBy("class")) - 1)  # a row per class

    def run(it):
        for pdf in it:
            got = [off_mesh(bytes(c).decode("utf-8", "replace")) for c in pdf.content]
            yield pdf[["class", "name"]].assign(vertices=[g and g[0] for g in got], triangles=[g and g[1] for g in got])

    rows = found.where(F.col("split") == split).select("class", "name", "content").mapInPandas(run, "class string, name string, vertices array<array<double>>, triangles array<array<int>>")
    return rows.join(F.broadcast(labels), "class")


def memory_gauges() -> dict[str, float]:
    """Gauges of a graphics device's memory; none where there is no device, as on Spark's executors."""
    return {}


@reader("queue")
def read_queue(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """A YAML queue file; strict reading wants a list `experiments` with unique names."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    entries = (yaml.safe_load(text) or {}).get("experiments")
    if not isinstance(entries, list):
        if not lenient:
            raise ValueError("a queue file needs a list of experiments")
        entries = []
    names = [e.get("name") for e in entries]
    if not lenient and len(set(names)) < len(names):
        raise ValueError("names must be unique")
    if any(not e.get("name") or not e.get("kind") for e in entries):
        raise ValueError("an entry needs name and kind")

    def number(v, kind, default):
        try:
            return kind(v)
        except (TypeError, ValueError):
            return default

    rows = [(i, str(e["name"]), str(e["kind"]), json.dumps(e.get("config") or {}, sort_keys=True, default=str), [str(x) for x in e.get("requires") or []], str(e.get("status") or "pending"), number(e.get("retries"), int, 0), number(e.get("max_retries"), int, 2), e.get("owner"), number(e.get("heartbeat"), float, None)) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "pos int, name string, kind string, config string, requires array<string>, status string, retries int, max_retries int, owner string, heartbeat double")


@reader("gpu")
def read_gpu(spark: SparkSession, path: str) -> DataFrame:
    """A headerless telemetry log; rows whose use doesn't parse are left out."""
    rows = spark.read.schema("ts string, util string, mem_used string, mem_total string").csv(path)
    return gpu_rows(rows)


def gpu_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("util_pct", F.regexp_replace("util", "[ %]+$", "").try_cast("double")).where("util_pct IS NOT NULL")


TRIPLES = "frame_id string, h int, w int, depth array<float>, rgb binary, query_text string, category string, bbox_2d array<int>, aabb_3d array<array<double>>, intrinsics array<double>, error string"


@reader("triples")
def read_triples(spark: SparkSession, path: str, max_frames: int | None = None) -> DataFrame:
    """Frames from images with a depth (.png, else .npy) and a meta of the same stem; images without either are left out. The limit counts images before that. What can't be read is a row with `error`."""
    found = files(spark, path).select("path", F.regexp_extract("path", r"/(\w+)/[^/]+$", 1).alias("kind"), parsing.stem(F.col("path")).alias("stem"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("suffix"), "content")
    images = found.where("kind = 'image'").select("stem", F.col("content").alias("image"))
    images = images if max_frames is None else images.orderBy("stem").limit(max_frames)
    depth = found.where("kind = 'depth' AND suffix IN ('png', 'npy')").groupBy("stem").agg(F.min_by(F.struct("path", "content"), F.when(F.col("suffix") == "png", 0).otherwise(1)).alias("d"))
    meta = found.where("kind = 'meta'").select("stem", F.col("content").cast("string").alias("meta"))
    both = images.join(depth, "stem").join(meta, "stem").select("stem", "image", "d.path", "d.content", "meta")

    def run(it):
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                try:
                    d, m = decoded(r.path, bytes(r.content)), json.loads(r.meta)
                    rows.append((r.stem, *d.shape, d.ravel(), png(bytes(r.image))[..., :3].astype(np.uint8).tobytes(), m.get("query_text"), m.get("category"), m.get("bbox_2d"), m.get("aabb_3d"), m.get("intrinsics"), None))
                except formats.DAMAGE as e:
                    rows.append((r.stem, *[None] * 9, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in TRIPLES.split(", ")], dtype=object)
            yield out.astype({"h": "Int32", "w": "Int32"})

    return both.mapInPandas(run, TRIPLES)


def expand(text: str, env: dict[str, str]) -> str:
    """${NAME} and ${NAME:-default}; the default holds for a variable that isn't set, not for an empty one."""
    return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1], m[2] or ""), text)


@dataclass(frozen=True)
class Corpus:
    frames: int
    categories: int
    holdout: float
    shard_size: int
    image_hw: tuple[int, int]

    def __post_init__(self):
        if not 0 < self.holdout < 1 or min(self.frames, self.shard_size) <= 0:
            raise ValueError("a corpus needs frames, shards of some size and a share to hold out between 0 and 1")


def read_profile(spark: SparkSession, path: str, env: dict[str, str] | None = None) -> dict:
    """A YAML profile, with the variables in its strings expanded and its `corpus` checked."""
    import yaml

    env = dict(os.environ) if env is None else env
    walk = lambda x: {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else [*map(walk, x)] if isinstance(x, list) else expand(x, env) if isinstance(x, str) else x
    profile = walk(yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or {})
    if c := profile.get("corpus"):
        profile["corpus"] = Corpus(int(c["frames"]), int(c["categories"]), float(c["holdout_category_fraction"]), int(c["shard_size"]), tuple(c["image_hw"]))
    return profile


def synthetic_frames(spark: SparkSession, n: int, h: int, w: int, depth: float, void_ratio: float = 0.6, noise: float = 0.1, seed: int = 0) -> DataFrame:
    """Constant frames with normal noise, cut at 0, and exactly int(h * w * void_ratio) voids; a seed per frame."""
    if depth <= 0 or not 0 <= void_ratio <= 1:
        raise ValueError("depth must be positive and void_ratio between 0 and 1")

    def run(it):
        for pdf in it:
            out = []
            for i in pdf.id:
                r = np.random.default_rng((seed, int(i)))
                x = np.maximum(depth + r.normal(0, noise, h * w), 0).astype(np.float32)
                x[r.choice(h * w, int(h * w * void_ratio), replace=False)] = 0
                out.append(x)
            yield pd.DataFrame({"frame_id": pdf.id.astype(str), "h": h, "w": w, "depth": out})

    return spark.range(n).mapInPandas(run, FRAMES)


@reader("synthetic")
def read_synthetic(spark: SparkSession, path: str = "", n: int = 1, h: int = 100, w: int = 100, depth: float = 2.0, **options) -> DataFrame:
    """Made frames instead of files, for a config that names no other source."""
    return synthetic_frames(spark, n, h, w, depth, **options)
