"""Quality rules: statistics of each whole text, scored by gradient-boosted trees.

Words are runs of characters other than ASCII white space. A text that is null or has no
word has all statistics 0 and fails the base rule. Equal texts get equal rows; rows are
judged one by one, so repeated ids and empty tables are no special case.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .boosting import Trees, fit
from .common import labelled, slices

#: The most labelled rows that the trees are fitted on.
SAMPLE_ROWS = 6000
#: A document whose score is at least this is kept.
KEEP = 0.5
#: Statistics the trees see, and whether the score may only rise (1) or fall (-1) with one.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "distinct_ratio": 0,
    "upper_ratio": 0, "digit_ratio": 0, "pipe_ratio": -1, "bang_ratio": -1, "top_word_ratio": -1, "stop_ratio": 0, "same_next_ratio": -1, "non_ascii_ratio": 0,
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS, SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated(words: list[bytes], distinct: int, ids: np.ndarray) -> int:
    """Words inside 5-word windows that occur at least twice in the text."""
    n = len(words) - 4
    if n < 2 or distinct == len(words):
        return 0
    i = ids.astype(np.uint64) + np.uint64(1)
    h = i[:n]
    for k in range(1, 5):
        h = (h ^ (h >> np.uint64(31))) * MIX + i[k : k + n]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(h, twice))
    # equal digests are confirmed on the words themselves
    _, which, count = np.unique(np.lib.stride_tricks.sliding_window_view(ids, 5)[at], axis=0, return_inverse=True, return_counts=True)
    at = at[count[which.reshape(-1)] > 1]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + 5, -1)
    return int((np.cumsum(edge) > 0).sum())


def less(b: bytes, chars: bytes) -> int:
    return len(b) - len(b.translate(None, chars))


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one text."""
    text = text or ""
    b = text.encode()
    words = b.split()
    n = len(words)
    if not n:
        return [0, 0, less(b, SYMBOLS), 0, 0], [0.0] * len(FEATURES)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines = [x for x in b.split(b"\n") if x.strip()]
    chars, symbols, dup, rep = len(text) - less(b, SPACE), less(b, SYMBOLS), len(lines) - len(set(lines)), repeated(words, len(seen), ids)
    freq = np.bincount(ids)
    short = sum(len(w) <= 3 for w in words)
    return [n, chars, symbols, dup, rep], [
        np.log1p(n), chars / n, symbols / chars, dup / len(lines), rep / n, len(seen) / n, less(b, UPPER) / len(b), less(b, DIGITS) / len(b),
        b.count(b"|") / n, b.count(b"!") / n, freq.max() / n, short / n, float((ids[1:] == ids[:-1]).mean()) if n > 1 else 0.0, 1 - len(text) / len(b),
    ]


def fit_rules(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees fitted on at most `rows` labelled documents outside the held-out fold."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            got = [statistics(t)[1] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(got, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    sample = labelled(docs, labels, "quality", rows).select(F.col("text").cast("string").alias("text"), F.col("doc_id").cast("string").alias("doc_id"), "label")
    # a repeated doc_id counts once, by its smallest statistics
    sample = sample.mapInArrow(run, "doc_id string, label int, x array<double>").groupBy("doc_id", "label").agg(F.min("x").alias("x"))
    found = sorted((r.doc_id, tuple(r.x), r.label) for r in sample.collect())
    x = np.array([f[1] for f in found], float).reshape(-1, len(FEATURES))
    return fit(x, np.array([f[2] for f in found], float), np.array(list(FEATURES.values())))


def apply_rules(docs: DataFrame, model: Trees, keep: float = KEEP) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept)."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    i64 = pa.int64()

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            got = [statistics(t) for t in b.column(1).to_pylist()]
            base = np.array([g[0] for g in got], np.int64).reshape(-1, len(BASE))
            score = model.score(np.array([g[1] for g in got], float).reshape(-1, len(FEATURES)))
            failed = (base[:, 0] < 10) | (100 * base[:, 4] > 20 * base[:, 0])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, i64) for c in base.T), pa.array(failed), pa.array(score), pa.array(~failed & (score >= keep))], names=["doc_id", *BASE, "base_failed", "score", "kept"])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {', '.join(f'{c} bigint' for c in BASE)}, base_failed boolean, score double, kept boolean"
    return rows.mapInArrow(run, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return apply_rules(docs, fit_rules(docs, labels))
