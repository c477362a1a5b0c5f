"""Data sources and sinks of Spark's own: ``spark.read.format("frames")``, the same as a stream, ``"samples"`` from a user's iterator, and a committed ``"shards"`` writer.

Frames are depth files (.npy in metres, .png in millimetres) below `path`, each with a picture
and a lens where the options `rgb` and `intrinsics` name folders with files of the same stem (or one lens for all).
A file is read by the task that has its group, one frame at a time. What can't be read is a row with
`error` and no pixels, so one broken file costs no scan.

As a stream, files come in order of their time and path; that pair is the offset, so a restarted stream goes
on behind the last file that it committed. Files are put in place whole, by a rename, and stay there. A file
younger than `settle` seconds waits for a later batch, since another of the same time could still come.
"""

from __future__ import annotations

import importlib
import io
import json
import os
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FRAME = "frame_id string, path string, h int, w int, depth array<float>, rgb binary, intrinsics array<double>, error string"
ARROW = pa.schema([("frame_id", pa.string()), ("path", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("depth", pa.list_(pa.float32())), ("rgb", pa.binary()), ("intrinsics", pa.list_(pa.float64())), ("error", pa.string())])
#: What reading a damaged file may raise.
DAMAGE = (ValueError, zlib.error, struct.error, EOFError, OSError, KeyError, TypeError, tarfile.TarError)


def stem(path: str) -> str:
    return os.path.basename(path).split(".", 1)[0]


def read_bytes(path: str) -> bytes:
    fs, at = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(at) as f:
        return f.read()


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


class Frames:
    """What batch and stream readers share: the options, the list of files, and the frames of a group."""

    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("frames need a path")
        uri = lambda p: p if not p or "://" in p or ":/" in p else f"file://{os.path.abspath(p)}"
        self.path, self.rgb, self.lens = (uri(options.get(n, "")).rstrip("/") for n in ("path", "rgb", "intrinsics"))
        self.group, self.settle = int(options.get("framespertask", 16)), float(options.get("settle", 1.0))
        if self.group < 1:
            raise ValueError("a task has a frame at least")

    def listed(self) -> list[tuple[int, str]]:
        """(time, path) of all depth files, oldest first."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        prefix = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else self.path.split("://", 1)[0] + "://"
        return sorted((f.mtime_ns or 0, prefix + f.path) for f in found if f.is_file and f.path.endswith((".npy", ".png")) and not os.path.basename(f.path).startswith((".", "_")))

    def groups(self, paths: list[str]) -> list[Files]:
        return [Files(tuple(paths[i : i + self.group])) for i in range(0, len(paths), self.group)]

    def beside(self, folder: str, path: str, suffix: str) -> str:
        return folder if folder.endswith(suffix) else f"{folder}/{stem(path)}{suffix}"

    def frame(self, path: str) -> tuple:
        from .readers import decoded, png

        try:
            depth = decoded(path, read_bytes(path))
            if depth.ndim != 2:
                raise ValueError("depth has two dimensions")
            rgb = png(read_bytes(self.beside(self.rgb, path, ".png"))) if self.rgb else None
            if rgb is not None and (rgb.ndim != 3 or rgb.shape[:2] != depth.shape):
                raise ValueError("the picture has another size than the depth")
            k = np.load(io.BytesIO(read_bytes(self.beside(self.lens, path, ".npy")))).astype(float) if self.lens else None
            if k is not None and k.shape == (3, 3):
                k = k[[0, 1, 0, 1], [0, 1, 2, 2]]
            return stem(path), path, *map(int, depth.shape), depth.ravel(), None if rgb is None else rgb[..., :3].astype(np.uint8).tobytes(), None if k is None else k.ravel()[:4], None
        except DAMAGE as e:
            return stem(path), path, None, None, None, None, None, f"{type(e).__name__}: {e}"

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(self.frame(path), ARROW, strict=True)], schema=ARROW)


class FrameReader(Frames, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.groups([p for _, p in self.listed()])


class FrameStream(Frames, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    @staticmethod
    def place(offset: dict) -> tuple[int, str]:
        return offset["time"], offset["path"]

    def latestOffset(self) -> dict:
        young = time.time_ns() - int(self.settle * 1e9)
        found = [f for f in self.listed() if f[0] <= young]
        if found and found[-1] > self.place(self.last):
            self.last = {"time": found[-1][0], "path": found[-1][1]}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        if self.place(end) > self.place(self.last):
            self.last = end
        return self.groups([f[1] for f in self.listed() if self.place(start) < f <= self.place(end)])

    def commit(self, end: dict) -> None:
        """Files stay, so there is nothing to give up."""


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options)

    def streamReader(self, schema: StructType) -> FrameStream:
        return FrameStream(self.options)


@dataclass
class Part(InputPartition):
    number: int


class SampleReader(DataSourceReader):
    def __init__(self, options: dict):
        module, _, name = options["factory"].partition(":")
        self.module, self.name, self.parts = module, name, int(options.get("parts", 1))
        if not name or self.parts < 1:
            raise ValueError("samples need a factory, as module:function, and a part at least")

    def partitions(self) -> list[Part]:
        return [Part(i) for i in range(self.parts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        yield from getattr(importlib.import_module(self.module), self.name)(partition.number, self.parts)


class SampleSource(DataSource):
    """Rows of a user's generator: option `factory` names a function of (part, parts) that yields tuples of the given schema."""

    @classmethod
    def name(cls) -> str:
        return "samples"

    def reader(self, schema: StructType) -> SampleReader:
        return SampleReader(self.options)


# shards

@dataclass
class Drafts(WriterCommitMessage):
    shards: tuple[tuple[int, int, str], ...]  # shard, samples, draft


class ShardWriter(DataSourceArrowWriter):
    """Tar files of rows (shard, frame_idx, members) that stand together by shard and in order. They get their names in commit, when all tasks have ended well."""

    def __init__(self, options: dict):
        self.path, self.manifest, self.job = options["path"].rstrip("/"), options.get("manifest"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Drafts:
        fs, root = pafs.FileSystem.from_uri(self.path)
        made, now, tar, out = [], None, None, None

        def close() -> None:
            if tar is not None:
                tar.close()
                out.close()

        try:
            for batch in iterator:
                for shard, frame, members in zip(*(batch.column(n) for n in ("shard", "frame_idx", "members")), strict=True):
                    if shard.as_py() != now:
                        close()
                        now, draft = shard.as_py(), f"{root}/_drafts-{self.job}/{uuid.uuid4().hex}.tar"
                        fs.create_dir(os.path.dirname(draft), recursive=True)
                        out = fs.open_output_stream(draft)
                        tar = tarfile.open(fileobj=out, mode="w|", format=tarfile.USTAR_FORMAT)  # noqa: SIM115
                        made.append([now, 0, draft])
                    made[-1][1] += 1
                    for suffix, body in sorted(members.as_py()):
                        info = tarfile.TarInfo(f"{frame.as_py():08d}.{suffix}")
                        info.size = len(body)
                        tar.addfile(info, io.BytesIO(body))
        finally:
            close()
        return Drafts(tuple(map(tuple, made)))

    def commit(self, messages: list[Drafts | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        made = sorted(x for m in messages if m is not None for x in m.shards)
        if twice := {a[0] for a, b in zip(made, made[1:], strict=False) if a[0] == b[0]}:
            raise ValueError(f"shards {sorted(twice)[:5]} come from more than one run of rows: they must stand together")
        rows = []
        for shard, n, draft in made:
            name = f"{root}/shard-{shard:06d}.tar"
            if fs.get_file_info(name).type != pafs.FileType.NotFound:
                fs.delete_file(name)
            fs.move(draft, name)
            rows.append(json.dumps({"shard": shard, "n": n, "path": name}))
        self.tidy()
        if self.manifest:
            at, folder = pafs.FileSystem.from_uri(self.manifest)
            at.create_dir(folder, recursive=True)
            with at.open_output_stream(f"{folder}/shards.json") as f:
                f.write("\n".join(rows).encode())

    def abort(self, messages: list[Drafts | None]) -> None:
        self.tidy()

    def tidy(self) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        if fs.get_file_info(f"{root}/_drafts-{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/_drafts-{self.job}")


class ShardSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shards"

    def writer(self, schema: StructType, overwrite: bool) -> ShardWriter:
        if overwrite:
            raise ValueError("shards are added or replaced one by one: append")
        return ShardWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session; once more is no harm."""
    for source in (FrameSource, SampleSource, ShardSink):
        spark.dataSource.register(source)


def frames(spark: SparkSession, path: str, streaming: bool = False, **options: object) -> DataFrame:
    register(spark)
    return (spark.readStream if streaming else spark.read).format("frames").options(**options).load(path)


def samples(spark: SparkSession, factory: str, schema: str, parts: int = 1) -> DataFrame:
    register(spark)
    return spark.read.format("samples").schema(schema).options(factory=factory, parts=parts).load()
