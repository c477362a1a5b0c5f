"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core import Written, delete, file_system, fresh_path, shared_dir  # noqa: F401

#: ASCII white space, as every word rule of this package reads it.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, rows: int = 256, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and `size` bytes of a text column; a longer text is a slice of its own."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and (i - start == rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives freed memory back to the machine: workers serve one task after another, and would keep what the largest took."""

    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return out


def spare(columns: list[str], name: str) -> str:
    """name, or name with underscores before it until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def n_words(text: Column) -> Column:
    """The number of words of a text, 0 for null: starts of runs that are not white space."""
    text = F.coalesce(text, F.lit(""))
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def fold(doc_id: Column, k: int = 5) -> Column:
    """crc32 of doc_id's text modulo k; rows of fold 0 are held out from every fit. Null ids are fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % k, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most `bound` labelled documents outside fold 0, dealt by a hash of doc_id: (text, label).

    The sample's size is fixed, so joining it by broadcast is bounded. An id labelled
    more than once gets its largest label; rows with a null id, label or text don't count.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
        .groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull()).select("doc_id", "text", "label")
