"""ISO base media containers: nested boxes and sample tables, read without decoding payloads.

``mux`` stores bytes as the samples of one uncompressed grey video track (24 x 24 pixels of
8 bits: 576 bytes a sample), so every byte comes back. ``walk`` reads any ISO container:
64-bit box sizes, boxes up to the end of the file, 32- and 64-bit chunk offsets, fixed,
listed and compact sample sizes, movie fragments, and tracks without a sync table (all
samples are keyframes).

A null or empty container has no tracks; a damaged one has the error's text in `error`
and no tracks. Equal payloads make equal containers: no clock and no random part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices

SIDE = 24
SAMPLE = SIDE * SIDE
#: Samples between keyframes, samples in a chunk, and samples in a second.
GOP, CHUNK, RATE = 12, 16, 25
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
#: Boxes within boxes; real files have under ten.
DEPTH = 32
IDENTITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(text: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a sample."""
    return text + b"\xff" * (-len(text) % SAMPLE or (0 if text else SAMPLE))


def mux(payload: bytes) -> bytes:
    """A container whose samples hold the payload, a positive multiple of 576 bytes."""
    n = len(payload) // SAMPLE
    if not n or len(payload) % SAMPLE:
        raise ValueError("the payload must be a positive multiple of 576 bytes")
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    media = box(b"mdat", payload)
    first = len(head) + len(media) - len(payload)
    offsets = first + SAMPLE * CHUNK * np.arange(-(-n // CHUNK), dtype=np.uint64)
    rest = n % CHUNK
    runs = [(1, CHUNK, 1)] * (n >= CHUNK) + [(n // CHUNK + 1, rest, 1)] * (rest > 0)
    keys = np.arange(1, n + 1, GOP, dtype=">u4")
    entry = struct.pack(">6xH16xHHII4xH32sHh", 1, SIDE, SIDE, 0x480000, 0x480000, 1, b"\x04grey".ljust(32, b"\0"), 8, -1)
    wide = bool(offsets[-1] >= 2**32)
    stbl = box(
        b"stbl",
        full(b"stsd", struct.pack(">I", 1), box(b"raw ", entry)),
        full(b"stts", struct.pack(">III", 1, n, 1)),
        full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", SAMPLE, n)),
        full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), offsets.astype(">u8" if wide else ">u4").tobytes()),
    )
    minf = box(b"minf", full(b"vmhd", bytes(8), flags=1), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)), full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"grey\0"), minf)
    tkhd = full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n, 0, 0, 0, 0), IDENTITY, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), IDENTITY, bytes(24), struct.pack(">I", 2))
    return head + media + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


def boxes(data: memoryview) -> Iterator[tuple[tuple, int, int]]:
    """(path of box types, start, end of its body), depth first in file order; boxes nest at most DEPTH deep."""
    open_ends, path, start = [len(data)], [], 0
    while open_ends:
        end = open_ends[-1]
        if start >= end:
            start = open_ends.pop()
            if path:
                path.pop()
            continue
        if end - start < 8:
            raise ValueError(f"a box header is cut off at byte {start}")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"a box header is cut off at byte {start}")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"the box {kind!r} at byte {start} doesn't fit")
        yield (*path, kind), body, start + size
        if kind in CONTAINERS:
            if len(open_ends) > DEPTH:
                raise ValueError(f"boxes nest more than {DEPTH} deep")
            open_ends.append(start + size)
            path.append(kind)
            start = body
        else:
            start += size


def numbers(data: memoryview, at: int, end: int, kind: str, per: int) -> np.ndarray:
    """The rows of a table: a count of 32 bits, then so many rows of `per` numbers."""
    n = field(data, ">I", at, end)[0]
    width = per * np.dtype(kind).itemsize
    if at + 4 + n * width > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, kind, n * per, at + 4).astype(np.int64).reshape(n, per)


def field(data: memoryview, form: str, at: int, end: int) -> tuple:
    """Numbers at a place inside a box."""
    if at + struct.calcsize(form) > end:
        raise ValueError("a box is too short for its fields")
    return struct.unpack_from(form, data, at)


def few_bits(data: memoryview, a: int, b: int) -> np.ndarray:
    """Sizes of a compact table, of 4, 8 or 16 bits each."""
    bits, n = field(data, ">BI", a + 7, b)
    if bits not in (4, 8, 16):
        raise ValueError("compact sizes have 4, 8 or 16 bits")
    if a + 12 + (n * bits + 7) // 8 > b:
        raise ValueError("a sample table is cut off")
    if bits == 4:
        raw = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
        return np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n].astype(np.int64)
    return np.frombuffer(data, ">u2" if bits == 16 else np.uint8, n, a + 12).astype(np.int64)


def fragment(data: memoryview, a: int, b: int, head: dict, usual: dict, whole: int) -> tuple[np.ndarray, ...]:
    """(starts, sizes, durations, is keyframe) of a run of samples in a movie fragment."""
    flags, n = field(data, ">II", a, b)
    flags &= 0xFFFFFF
    at, first_flags = a + 8, None
    if flags & 0x1:
        head["at"] = head["base"] + field(data, ">i", at, b)[0]
        at += 4
    if flags & 0x4:
        first_flags = field(data, ">I", at, b)[0]
        at += 4
    names = [x for bit, x in ((0x100, "duration"), (0x200, "size"), (0x400, "flags"), (0x800, "shift")) if flags & bit]
    defaults = {**usual, **head}
    if at + 4 * n * len(names) > b or ("size" not in names and (defaults["size"] < 1 and n or n * defaults["size"] > whole)):
        raise ValueError("a run of samples doesn't fit")
    rows = np.frombuffer(data, ">u4", n * len(names), at).astype(np.int64).reshape(n, len(names))
    of = lambda x: rows[:, names.index(x)] if x in names else np.full(n, defaults[x], np.int64)
    sizes, durations, marks = of("size"), of("duration"), of("flags").copy()
    if n and first_flags is not None:
        marks[0] = first_flags
    starts = head["at"] + np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
    head["at"] += int(sizes.sum())
    return starts, sizes, durations, marks & 0x10000 == 0


def walk(container: bytes | None) -> list[dict]:
    """The tracks: codec, handler, timescale, duration, sizes and offsets of samples, byte ranges of keyframes.

    Samples of movie fragments follow those of the tables. A count is believed only as far
    as the file can hold it: ValueError where it can't, as for all other damage.
    """
    if not container:
        return []
    data, tracks, usual, head, moof = memoryview(container), [], {}, None, 0
    whole = len(data)
    for path, a, b in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            tracks.append({"codec": None, "handler": None, "timescale": 0, "duration": 0, "id": len(tracks) + 1, "runs_of": []})
        elif kind == b"trex":
            number, _, *rest = field(data, ">5I", a + 4, b)
            usual[number] = dict(zip(("duration", "size", "flags"), rest, strict=True))
        elif kind == b"moof":
            moof = a - 8
        elif kind == b"tfhd":
            flags, number = field(data, ">II", a, b)
            at, head = a + 8, {"id": number, "base": moof}
            for bit, name, form in ((0x1, "base", ">Q"), (0x2, None, ">I"), (0x8, "duration", ">I"), (0x10, "size", ">I"), (0x20, "flags", ">I")):
                if flags & bit:
                    value = field(data, form, at, b)[0]
                    at += struct.calcsize(form)
                    if name:
                        head[name] = value
            if head["base"] > whole:
                raise ValueError("a fragment's base lies outside the file")
            head["at"] = head["base"]
        elif kind == b"trun":
            owner = next((t for t in tracks if head and t["id"] == head["id"]), None)
            if owner is None or b"traf" not in path:
                raise ValueError("a run of samples has no track")
            owner["runs_of"].append(fragment(data, a, b, head, usual.get(head["id"], {"duration": 0, "size": 0, "flags": 0}), whole))
        if b"trak" not in path or len(path) < 3:
            continue
        t = tracks[-1]
        if kind == b"tkhd":
            t["id"] = field(data, ">I", a + (20 if field(data, ">B", a, b)[0] == 1 else 12), b)[0]
        elif kind == b"mdhd":
            t["timescale"], t["duration"] = field(data, ">IQ", a + 20, b) if field(data, ">B", a, b)[0] == 1 else field(data, ">II", a + 12, b)
        elif kind == b"hdlr" and path[-2] == b"mdia":
            t["handler"] = field(data, ">4s", a + 8, b)[0].decode("latin-1")
        elif kind == b"stsd":
            t["codec"] = field(data, ">4s", a + 12, b)[0].decode("latin-1")
        elif kind == b"stsz":
            one, n = field(data, ">II", a + 4, b)
            if one and n * one > whole:
                raise ValueError("the samples are larger than the file")
            t["sizes"] = np.full(n, one, np.int64) if one else numbers(data, a + 8, b, ">u4", 1)[:, 0]
        elif kind == b"stz2":
            t["sizes"] = few_bits(data, a, b)
        elif kind in (b"stco", b"co64"):
            t["chunks"] = numbers(data, a + 4, b, ">u4" if kind == b"stco" else ">u8", 1)[:, 0]
        elif kind == b"stsc":
            t["runs"] = numbers(data, a + 4, b, ">u4", 3)
        elif kind == b"stts":
            t["times"] = numbers(data, a + 4, b, ">u4", 2)
        elif kind == b"stss":
            t["sync"] = numbers(data, a + 4, b, ">u4", 1)[:, 0]
    for t in tracks:
        sizes, chunks, runs = t.pop("sizes", np.zeros(0, np.int64)), t.pop("chunks", np.zeros(0, np.int64)), t.pop("runs", np.zeros((0, 3), np.int64))
        times, more = t.pop("times", np.zeros((0, 2), np.int64)), t.pop("runs_of")
        del t["id"]
        lasts = np.diff(np.append(runs[:, 0], len(chunks) + 1))
        if len(runs) and (runs[0, 0] != 1 or (lasts < 0).any()):
            raise ValueError("the runs of chunks are out of order")
        per = np.minimum(np.repeat(runs[:, 1], lasts) if len(runs) else np.zeros(len(chunks), np.int64), len(sizes))
        if per.sum() < len(sizes):
            raise ValueError("the chunks hold fewer samples than there are sizes")
        firsts = np.minimum(np.concatenate([[0], np.cumsum(per)]), len(sizes))
        chunk = np.repeat(np.arange(len(chunks)), np.diff(firsts))
        before = np.concatenate([[0], np.cumsum(sizes)])
        starts = chunks[chunk] + before[:-1] - before[firsts[:-1]][chunk] if len(sizes) else sizes
        sync = t.pop("sync", np.arange(1, len(sizes) + 1)) - 1
        key = np.zeros(len(sizes), bool)
        key[sync[(sync >= 0) & (sync < len(sizes))]] = True
        lasting = int((times[:, 0].astype(object) * times[:, 1]).sum()) if len(times) else 0
        if more:
            starts, sizes, key = (np.concatenate([x, *(r[i] for r in more)]) for x, i in ((starts, 0), (sizes, 1), (key, 3)))
            lasting += sum(int(r[2].sum()) for r in more)
        if len(starts) and (starts.min() < 0 or starts.max() > whole or (starts + sizes).max() > whole):
            raise ValueError("a sample lies outside the file")
        t |= {"starts": starts, "sizes": sizes, "keyframes": [(int(starts[i]), int(starts[i] + sizes[i])) for i in np.flatnonzero(key)]}
        t["duration"] = min(t["duration"] or lasting, 2**63 - 1)
    return tracks


def samples(container: bytes, track: dict) -> bytes:
    """A track's samples in order; neighbours are read as one range."""
    starts, ends = track["starts"], track["starts"] + track["sizes"]
    if not len(starts):
        return b""
    cut = np.flatnonzero(starts[1:] != ends[:-1])
    data = memoryview(container)
    return b"".join(data[a:b] for a, b in zip(starts[np.append(0, cut + 1)].tolist(), ends[np.append(cut, len(ends) - 1)].tolist(), strict=True))


def feature(track: dict) -> str:
    ranges = ",".join(f"{a}-{b}" for a, b in track["keyframes"])
    return f"codec={track['codec']};timescale={track['timescale']};duration={track['duration']};samples={len(track['sizes'])};keyframes={ranges}"


MEDIA_COLUMNS = "error string, tracks array<struct<codec: string, handler: string, timescale: bigint, duration: bigint, n_samples: bigint, keyframes: array<struct<start: bigint, end: bigint>>>>"


def media_columns(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, error, tracks) of each container in the binary column `content`; payloads stay undecoded."""
    rows = df.select(F.col(key).alias("k"), F.col(content).cast("binary").alias("c"))

    def one(c):
        try:
            return None, [{"codec": t["codec"], "handler": t["handler"], "timescale": t["timescale"], "duration": t["duration"], "n_samples": len(t["sizes"]), "keyframes": [{"start": a, "end": b} for a, b in t["keyframes"]]} for t in walk(c)]
        except ValueError as e:
            return str(e), []

    i64 = pa.int64()
    kind = pa.list_(pa.struct([("codec", pa.string()), ("handler", pa.string()), ("timescale", i64), ("duration", i64), ("n_samples", i64), ("keyframes", pa.list_(pa.struct([("start", i64), ("end", i64)])))]))

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "c")):
            got = [one(c.as_py()) for c in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], kind)], names=["k", "error", "tracks"])

    return rows.mapInArrow(run, f"k {rows.schema['k'].dataType.simpleString()}, {MEDIA_COLUMNS}").withColumnRenamed("k", key)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, container) of each document's whole text (null: empty)."""

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "container"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, container binary")


def read_back(stored: DataFrame) -> DataFrame:
    """Digests of the payload read back through the sample tables, and the track's features."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "container")):
            rows = []
            for c in b.column(2):
                container = c.as_buffer()
                (track,) = walk(container)
                payload = samples(container, track)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(container), hashlib.sha256(container).hexdigest(), feature(track)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=names)

    return stored.mapInArrow(run, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
