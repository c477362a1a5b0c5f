"""Ranked lexical search with a bit-sliced impact index.

Terms are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased.
Documents stand in blocks, numbered within a block by ascending doc_id. A block is made by
the task that reads its documents, so the index costs no shuffle. For each term of a block
the index holds the numbers, counts and lengths of the documents that have it; with the
term's weight these give integer impacts, and an impact's bits are bitmaps over the block.

A search sends the index rows of the items' terms to their block and adds the bitmaps of an
item's terms to its accumulator, itself a set of bitmaps, by carries from the least
significant bit on. The best k of a block are then found from the most significant bitmap
down, and the best of all blocks by rank. Only words of 64 documents that hold a term are
touched. Items are dealt in groups, so that a task holds the accumulators of one group.

A null text has no terms and is no document; nor is a text without terms. Rows that repeat
a doc_id are documents of their own; null doc_ids come last among equal scores. Rows that
repeat an item_id are one item with the terms of all; null is an item_id too. Whole texts
count, in pieces of a few megabytes. An empty table gives an empty result, and only
doc_id, item_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..core import spread
from .common import Written, slices, table
from .mixing import carrier

#: A-Z to a-z, and what is neither letter, digit nor beyond ASCII to a blank.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Documents and postings of a block at most, bytes of a text that are split at once, and bits of a score.
BLOCK, POSTINGS, PIECE, BITS = 8192, 1 << 22, 1 << 22, 63
#: Items whose accumulators a task holds together, about.
ITEMS = 256

INDEX = "block long, term string, n_docs int, docs binary, counts binary, lengths binary, n_terms long, doc_ids array<long>"


def term_counts(text: bytes) -> Counter:
    """How often each term occurs in a text."""
    text, out, at = text.translate(TERM_BYTES), Counter(), 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        out.update(text[at:end].split())
        at = end
    return out


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, term counts) of each row of two columns."""
    for batch in batches:
        for part in slices(batch, batch.schema.names[1]):
            for key, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                yield key, term_counts(text or b"")


def packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values: the bytes of `values` up to each end."""
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows of a task's documents: for each block one without a term, with its doc_ids, and one for each term."""
    task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def block() -> pa.RecordBatch:
        held.sort(key=lambda d: (d[0] is None, d[0] or 0))
        number: dict[bytes, int] = {}
        terms = np.fromiter((number.setdefault(t, len(number)) for _, c in held for t in c), np.int64, size)
        counts = np.fromiter((n for _, c in held for n in c.values()), "<u4", size)
        each, lengths = np.array([len(c) for _, c in held]), np.array([c.total() for _, c in held], "<u4")
        docs, order = np.repeat(np.arange(len(held)), each), np.argsort(terms, kind="stable")
        n_docs = np.bincount(terms, minlength=len(number))
        ends, n = np.cumsum(n_docs), len(number)
        per_term = (docs[order].astype("<u2"), counts[order], lengths[docs[order]])
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(n + 1, task << 32 | made)), pa.concat_arrays([pa.nulls(1, pa.string()), pa.array([*number], pa.binary()).cast(pa.string())]),
            pa.array(np.concatenate([[len(held)], n_docs]), pa.int32()), *(pa.concat_arrays([pa.nulls(1, pa.binary()), packed(v, ends)]) for v in per_term),
            pa.concat_arrays([pa.array([int(lengths.sum())]), pa.nulls(n, pa.int64())]), pa.concat_arrays([pa.array([[d for d, _ in held]], pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int64()))]),
        ], ["block", "term", "n_docs", "docs", "counts", "lengths", "n_terms", "doc_ids"])

    for key, counted in texts(batches):
        if counted and held and (len(held) == BLOCK or size + len(counted) > POSTINGS):
            yield block()
            made, held, size = made + 1, [], 0
        if counted:
            held.append((key, counted))
            size += len(counted)
    if held:
        yield block()


def index(docs: DataFrame) -> DataFrame:
    """The index rows of all documents, as INDEX names them. Write them: a block's number is that of the task that made it."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index_blocks, INDEX)


def item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for key, counted in texts(batches):
        if counted:
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(counted), pa.int64()), pa.array([*counted], pa.binary()).cast(pa.string()), pa.array([*counted.values()], pa.int64())], ["item_id", "term", "n"])


def impacts(counts: np.ndarray, lengths: np.ndarray, weight: int, n_docs: int, n_terms: int) -> np.ndarray:
    """A term's part of the score of the documents that hold it."""
    counts, m = counts.astype(np.int64), 25 + 75 * n_docs * lengths.astype(np.int64) // n_terms
    return weight * (1_000_000_000 * counts // (1000 * counts + 8 * m))


def bitmaps(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words that hold a document, a row of those words for each bit of the values)."""
    words, place = np.unique(docs >> 6, return_inverse=True)
    n = int(values.max()).bit_length()
    bits = np.zeros((n, len(words) * 64), np.uint8)
    bits[:, place * 64 + (docs & 63)] = values >> np.arange(n)[:, None] & 1
    return words, np.packbits(bits, axis=1, bitorder="little").view("<u8")


def add(sums: np.ndarray, words: np.ndarray, rows: np.ndarray, shift: int = 0) -> None:
    """Adds rows of bitmaps to the sums at `words`, from the bit `shift` on, by carry arithmetic."""
    there = sums[:, words]
    carry = np.zeros(len(words), "<u8")
    for bit, row in enumerate(rows, shift):
        old = there[bit]
        either = old ^ row
        both = old & row
        there[bit] = either ^ carry
        carry &= either
        carry |= both
    bit = shift + len(rows)
    while carry.any():
        there[bit], carry = there[bit] ^ carry, there[bit] & carry
        bit += 1
    sums[:, words] = there


def best(sums: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(number, score) of the k documents of the largest scores above 0, the smaller number first among equal ones."""
    numbers = lambda words: np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))
    sure, maybe = np.zeros_like(sums[0]), np.bitwise_or.reduce(sums)  # among the k; may be, and equal in all bits so far
    for row in sums[::-1]:
        if not row.any():
            continue
        more = sure | maybe & row
        n = int(np.bitwise_count(more).sum())
        if n > k:
            maybe &= row
        else:
            sure, maybe = more, maybe & ~row
            if n == k:
                break
    found = numbers(sure)
    found = np.concatenate([found, numbers(maybe)[: k - len(found)]])
    bits = sums[:, found >> 6] >> (found & 63).astype("<u8") & np.uint64(1)
    scores = (bits << np.arange(len(sums), dtype="<u8")[:, None]).sum(axis=0)
    return sorted(zip(found.tolist(), scores.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def searcher(n_docs: int, n_terms: int, k: int):
    """Over rows sorted by block and group, a block's own row first: the best of each block for each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sums = None, [], {}

        def found() -> Iterator[pa.RecordBatch]:
            rows = [(item, ids[d], score) for item, s in sums.items() for d, score in best(s, k)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["item_id", "doc_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["block"], r["part"]) != now:
                    yield from found()
                    now, sums = (r["block"], r["part"]), {}
                if r["term"] is None:
                    ids = r["doc_ids"]
                    continue
                values = impacts(np.frombuffer(r["counts"], "<u4"), np.frombuffer(r["lengths"], "<u4"), r["weight"], n_docs, n_terms)
                if not values.any():
                    continue
                words, rows = bitmaps(np.frombuffer(r["docs"], "<u2").astype(np.int64), values)
                for x in r["items"]:
                    if x["item_id"] not in sums:
                        sums[x["item_id"]] = np.zeros((BITS, (len(ids) + 63) // 64), "<u8")
                    for shift in (b for b in range(x["n"].bit_length()) if x["n"] >> b & 1):
                        add(sums[x["item_id"]], words, rows, shift)
        yield from found()

    return run


def weight(n_docs: Column, df: Column) -> Column:
    return F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * df + 1))).cast("long")


def search(index: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of a written index for each item."""
    spark = index.sparkSession
    out, n = Written(spark, "lexical"), F.coalesce(F.sum("n_docs"), F.lit(0))
    size = index.where(F.col("term").isNull()).agg(n.alias("docs"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("terms")).first()
    words = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(item_terms, "item_id long, term string, n long")
    words, _ = out.put(words.groupBy("item_id", "term").agg(F.sum("n").alias("n")))
    groups = -(-words.select("item_id").distinct().count() // ITEMS) or 1

    of_terms = index.where(F.col("term").isNotNull())
    asked = words.select("term").distinct()
    df = of_terms.select("term", "n_docs").join(carrier(asked, "term")(asked), "term").groupBy("term").agg(F.sum("n_docs").alias("df"))
    group = F.coalesce(F.pmod(F.xxhash64("item_id"), F.lit(groups)), F.lit(0)).cast("int").alias("part")
    lists = words.groupBy("term", group).agg(F.collect_list(F.struct("item_id", "n")).alias("items"))
    lists, _ = out.put(lists.join(df, "term").withColumn("weight", weight(F.lit(size.docs), F.col("df"))).drop("df"))
    # an item takes at least 24 bytes of its list
    small = lists.agg(F.coalesce(F.sum(F.octet_length("term") + 64 + 24 * F.size("items")), F.lit(0)).alias("n")).first().n <= 20_000_000

    rows = of_terms.drop("n_terms", "doc_ids", "n_docs").join(F.broadcast(lists) if small else lists, "term")
    own = index.where(F.col("term").isNull()).select("block", "doc_ids", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    rows = spread(rows.unionByName(own, allowMissingColumns=True), "block", "part").sortWithinPartitions("block", "part", F.col("term").asc_nulls_first())
    found = rows.mapInArrow(searcher(size.docs, size.terms, k), "item_id long, doc_id long, score long")
    order = W.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    built, _ = Written(spark, "lexical-index").put(index(table(spark, sf_dir, "documents")))
    return search(built, table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS terms FROM d WHERE len(ts) > 0
), q AS (
  SELECT item_id, term, count(*) AS n FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term
), p AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM d) GROUP BY r, doc_id, n, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * max(g.docs) + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, g GROUP BY term
), s AS (
  SELECT q.item_id, p.r, p.doc_id, CAST(sum(q.n * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * g.docs) // g.terms)))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY q.item_id, p.r, p.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""
