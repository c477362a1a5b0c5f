"""Packing by powers of two.

A document of n tokens is cut into pieces of 2048 and then of the powers of two in the
binary form of what remains. Pieces of one length make one bucket (its number is log2 of
the length), and each task's sequences stand bucket by bucket; each piece is a whole
sequence of that length, so no sequence crosses documents and none is padded.

Null and empty texts are one piece: the end token. Repeated rows are packed each for
themselves. Sequence ids follow the scan's partitions: sixteen times a row's place plus
log2 of the length, so an id names its bucket too.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import lean, slices

MAX_LENGTH, END_ID = 2048, 1
#: Sequence ids leave room for so many pieces of a text: one of 2 GB has an eighth of them at MAX_LENGTH.
PIECES = 1 << 24
#: Parts of words whose ids a Python worker remembers; a full store keeps the ones it learnt first.
REMEMBERED, KEPT = 200_000, 60_000
#: Documents tokenised at a time, the characters of a longer text that are (up to the next space), and parts encoded in one call.
GROUP, PIECE, CALL = 128, 1 << 18, 256
#: How the vocabulary's own rule splits lower-case Latin-1 text: contractions, letters, single numbers, other runs.
LETTERS, NUMBERS, SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\x09-\\x0d\\x20\x85\xa0"
PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+").findall
CUT, CUT_PLAIN = re.compile(r"[\x20\x09-\x0D]"), re.compile(r"[\x20\x09-\x0D0-9]")


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A Latin-1 text doesn't change under NFC and lowers character by character, so it is
    split into the vocabulary's parts here, and the tokenizer sees each new part once.
    Other texts, and those that may hold a special token, are split at ASCII white space,
    which separates tokens anyhow, and the tokenizer sees each new word once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def split(self, text: str | None) -> tuple[dict, list[str]]:
        """The store for a text's strings, and those strings."""
        text = text or ""
        if "<|" not in text:
            try:
                text.encode("latin-1")
                return self.parts, PARTS(text.lower())
            except UnicodeEncodeError:
                pass
        return self.words, [w.decode() for w in text.encode().split()]

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, store: dict[str, bytes], new: list[str]) -> None:
        groups = [new[i : i + CALL] for i in range(0, len(new), CALL)]
        if store is self.words:
            for g in groups:
                store.update(zip(g, self.ids(g), strict=True))
            return
        for g, raw in zip(groups, self.ids([" ".join(g) for g in groups]), strict=True):
            cut = (4 * (np.flatnonzero(self.last[np.frombuffer(raw, "<u4")]) + 1)).tolist()
            if len(cut) == len(g):
                store.update({p: raw[a:b] for p, a, b in zip(g, [0, *cut], cut, strict=False)})
            else:
                store.update(zip(g, self.ids(g), strict=True))

    def group(self, texts: list[str]) -> list[bytes]:
        for name in ("parts", "words"):
            if len(store := getattr(self, name)) >= REMEMBERED:
                setattr(self, name, dict(islice(store.items(), KEPT)))
        found, new = [], (set(), set())
        for t in texts:
            store, strings = self.split(t)
            ids = [*map(store.get, strings)]
            if None in ids:
                new[store is self.words].update([s for s, k in zip(strings, ids, strict=True) if k is None])
                ids = None
            found.append((store, strings, ids))
        self.learn(self.parts, list(new[0]))
        self.learn(self.words, list(new[1]))
        return [b"".join(ids if ids is not None else map(store.__getitem__, strings)) for store, strings, ids in found]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Each text's ids. However long the texts are, the strings of a few pieces are held at a time."""
        at, held = 0, []
        for group in grouped(texts):
            for (k, _), raw in zip(group, self.group([p for _, p in group]), strict=True):
                if k > at:
                    yield b"".join(held)
                    at, held = k, []
                held.append(raw)
        if texts:
            yield b"".join(held)


def pieces(text: str) -> Iterator[str]:
    """A text, cut where no token lies across: before ASCII white space and, in a Latin-1 text, before a single number too."""
    if len(text) <= PIECE:
        yield text
        return
    plain = "<|" not in text and (text.isascii() or max(text) <= "\xff")
    cut, at = (CUT_PLAIN if plain else CUT).search, 0
    while len(text) - at > PIECE and (end := cut(text, at + PIECE)):
        yield text[at : end.start()]
        at = end.start()
    yield text[at:]


def grouped(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """Pieces with their text's number, so many that they hold PIECE characters or are GROUP pieces."""
    group, size = [], 0
    for k, t in enumerate(texts):
        for p in pieces(t or ""):
            group.append((k, p))
            size += len(p)
            if size >= PIECE or len(group) == GROUP:
                yield group
                group, size = [], 0
    if group:
        yield group


_loaded: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One store per worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def lengths(n: int, most: int = MAX_LENGTH) -> list[int]:
    rest = n % most
    return [most] * (n // most) + [1 << k for k in range(most.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, most: int = MAX_LENGTH, place: Column | None = None) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset) of each piece; ids as little-endian 32-bit bytes.

    `most` must be a power of two. docs is only scanned: nothing is shuffled or gathered.
    With place, the rows' number from 0, sequence_id follows it, and else the order of the scan.
    """
    if most < 1 or most & most - 1:
        raise ValueError("the longest sequence must be a power of two")
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), (F.lit(None) if place is None else place).cast("long").alias("place"))
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "place", "piece"]
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        t = tokens(path)
        for b in batches:
            for part in slices(b, "text", GROUP, 4 * PIECE):
                owner, starts, sizes, ids, totals, numbers = [], [], [], [], [], []
                for k, raw in enumerate(t.encode(part.column(1).to_pylist())):
                    raw += end
                    n, at = len(raw) // 4, 0
                    for number, size in enumerate(lengths(n, most)):
                        numbers.append(number), owner.append(k), starts.append(at), sizes.append(size), ids.append(raw[4 * at : 4 * (at + size)]), totals.append(n)
                        at += size
                i64 = pa.int64()
                owner = pa.array(owner, i64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(owner), pa.array(starts, i64), pa.array(sizes, i64), pa.array(ids, pa.binary()), pa.array(totals, i64), part.column(2).take(owner), pa.array(numbers, i64)], names=names)

    pieces = rows.mapInArrow(lean(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, place bigint, piece bigint")
    bucket = F.round(F.log2("length")).cast("int")
    numbered = F.when(F.col("place") < (1 << 59) // PIECES, F.col("place") * PIECES + F.col("piece")).otherwise(F.raise_error(F.lit("more rows than sequence ids of 63 bits can number")))
    number = F.monotonically_increasing_id() if place is None else numbered
    return pieces.select(*names[:5], bucket.alias("bucket"), (number * 16 + bucket).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def placed(docs: DataFrame) -> tuple[DataFrame, Column | None]:
    """docs and the number of each row in the order in which they were written; None where docs aren't Parquet files.

    Scans take files by size. Writers number them by partition, and a row's index in its
    file and the rows of the files before give its number without a shuffle of the texts.
    """
    meta = F.col("_metadata")
    try:
        rows = docs.select("*", meta["file_path"].alias("__path"), meta["row_index"].alias("__row"))
    except AnalysisException:
        return docs, None
    name = F.regexp_extract("__path", r"[^/]*$", 0)
    files = rows.groupBy("__path").agg(F.count("*").alias("n")).withColumn("part", F.regexp_extract(name, r"^part-(\d+)", 1).try_cast("long")).withColumn("name", name)
    order = W.orderBy("part", "name", "__path").rowsBetween(W.unboundedPreceding, -1)  # a row per file
    files = files.select(F.col("__path").alias("__at"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(files), F.col("__path") == F.col("__at")), F.col("__before") + F.col("__row")


def bucketed(packed: DataFrame) -> DataFrame:
    """The sequences of each task by length, so that a file's row groups hold one bucket or two and readers of a bucket skip the others; nothing is shuffled."""
    return packed.sortWithinPartitions("bucket", "sequence_id")


def write_buckets(packed: DataFrame, path: str, files: int = 8) -> None:
    """The sequences, a folder for each length; the salt deals a large bucket over `files` tasks."""
    packed.repartition(F.col("bucket"), F.pmod(F.xxhash64("sequence_id"), F.lit(files))).write.partitionBy("bucket").parquet(path)


def digests(packed: DataFrame, *more: str) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket", *more)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(digests(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
