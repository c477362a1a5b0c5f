"""Quality classifier: a byte-level convolutional network in numpy.

A whole text's UTF-8 bytes are cut into overlapping chunks. Filters of WIDTH taps slide
over the bytes (each tap of a filter has a learned weight for each byte value), every
filter's largest response in a chunk is kept, and the chunks' responses are combined by
their mean, largest and smallest values into one hidden layer and one probability.

Null and empty texts are one chunk of zero bytes and so all get one score. The score
depends on the text alone: equal texts get equal scores, and labels, lang, source and
doc_id are no inputs. Without labels the network is untrained and all scores are 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from .common import fold, labelled, lean, slices

#: Labelled rows to train on at most, and chunks of one of them to train on at most (drawn by the text's hash; scoring uses all).
SAMPLE_ROWS, SAMPLE_CHUNKS = 2400, 24
CHUNK, STEP, WIDTH, FILTERS, HIDDEN = 256, 192, 4, 16, 24
#: Epochs over the sample, or more so that a small sample also gets STEPS steps.
EPOCHS, STEPS, BATCH, RATE, SEED = 14, 700, 48, 0.01, 7
KEEP = 0.3
#: Chunks convolved at a time, so that the responses stay in the CPU's cache.
TILE = 96


@dataclass
class Network:
    taps: np.ndarray  # WIDTH x 256 x FILTERS
    bias: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @staticmethod
    def new(seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        n = lambda scale, *shape: r.normal(0, scale, shape).astype(np.float32)
        return Network(n(0.3, WIDTH, 256, FILTERS), np.zeros(FILTERS, np.float32), n(0.15, 3 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN, np.float32), np.zeros(1, np.float32))

    def params(self) -> list[np.ndarray]:
        return [self.taps, self.bias, self.w1, self.b1, self.w2, self.b2]

    def responses(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, positions, filters) of a uint8 array of chunks."""
        n = CHUNK - WIDTH + 1
        out = self.taps[0][chunks[:, :n]]
        for j in range(1, WIDTH):
            out += self.taps[j][chunks[:, j : j + n]]
        return out

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        parts = [self.responses(chunks[i : i + TILE]).max(1) for i in range(0, len(chunks), TILE)]
        return np.maximum(np.concatenate(parts) + self.bias, 0)

    def combine(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        counts = np.diff(np.append(starts, len(pooled)))[:, None]
        return np.concatenate([np.add.reduceat(pooled, starts) / counts, np.maximum.reduceat(pooled, starts), np.minimum.reduceat(pooled, starts)], 1)

    def head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.w1 + self.b1, 0)
        return h, 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -30, 30)))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        chunks, starts = cut(texts)
        return self.head(self.combine(self.pooled(chunks), starts))[1].astype(float)


def cut(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' chunks as rows of bytes, and each text's first row. Chunks overlap by CHUNK - STEP bytes; the last is padded with zeros."""
    raw = [(t or "").encode() for t in texts]
    counts = np.array([max(1, -(-(len(b) - CHUNK + STEP) // STEP)) for b in raw])
    starts = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros((starts[-1], CHUNK), np.uint8)
    for b, at, n in zip(raw, starts[:-1].tolist(), counts.tolist(), strict=True):
        buffer = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
        buffer[: len(b)] = np.frombuffer(b, np.uint8)
        out[at : at + n] = np.lib.stride_tricks.sliding_window_view(buffer, CHUNK)[::STEP]
    return out, starts[:-1]


def drawn(text: str, most: int = SAMPLE_CHUNKS) -> tuple[bytes, np.ndarray]:
    """The text's digest and the chunks of it to train on."""
    digest, (chunks, _) = xxhash.xxh3_128_digest(text.encode()), cut([text])
    if len(chunks) > most:
        chunks = chunks[np.sort(np.random.default_rng(list(digest)).choice(len(chunks), most, replace=False))]
    return digest, chunks


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on the logistic loss, from each document's chunks; of each filter and chunk only the place of the largest response learns."""
    net, r = Network.new(seed), np.random.default_rng(seed)
    if not len(docs):
        return net
    epochs = max(epochs, -(-STEPS // -(-len(docs) // BATCH)))
    m, v, step = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    total = epochs * -(-len(docs) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            part = order[at : at + BATCH]
            chunks = np.concatenate([docs[i] for i in part])
            sizes = np.array([len(docs[i]) for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            best, where = np.empty((len(chunks), FILTERS), np.float32), np.empty((len(chunks), FILTERS), np.int64)
            for i in range(0, len(chunks), TILE):
                got = net.responses(chunks[i : i + TILE])
                where[i : i + TILE] = got.argmax(1)
                best[i : i + TILE] = np.take_along_axis(got, where[i : i + TILE, None], 1)[:, 0]
            pooled = np.maximum(best + net.bias, 0)
            x = net.combine(pooled, starts)
            h, p = net.head(x)
            d = ((p - labels[part]) / len(part)).astype(np.float32)
            dh = d[:, None] * net.w2 * (h > 0)
            dx = dh @ net.w1.T
            owner = np.repeat(np.arange(len(part)), sizes)
            mean, top, low = (dx[:, k * FILTERS : (k + 1) * FILTERS] for k in range(3))
            big, small = (pooled == x[owner, k * FILTERS : (k + 1) * FILTERS] for k in (1, 2))
            share = lambda hit, g: g[owner] * hit / np.add.reduceat(hit.astype(np.float32), starts)[owner]
            dp = (mean / sizes[:, None])[owner] + share(big, top) + share(small, low)
            dp *= pooled > 0
            taps = np.zeros_like(net.taps)
            rows, f = np.arange(len(chunks))[:, None], np.broadcast_to(np.arange(FILTERS), where.shape)
            for j in range(WIDTH):
                np.add.at(taps[j], (chunks[rows, where + j], f), dp)
            step += 1
            rate = RATE * (1 - 0.9 * step / total)
            for k, (q, g) in enumerate(zip(net.params(), [taps, dp.sum(0), x.T @ dh, dh.sum(0), h.T @ d, d.sum(keepdims=True)], strict=True)):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                q -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


def fit_network(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chunks: int = SAMPLE_CHUNKS) -> Network:
    """Trained on at most `rows` labelled documents outside the held-out fold, and at most `chunks` chunks of each.

    Executors cut the texts, so the driver gets no more than that, however long the texts
    are. A repeated doc_id counts once, by the text of the smallest digest. Other columns
    aren't read; without labelled rows the network is untrained.
    """

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                got = [drawn(t, chunks) for t in part.column(2).cast(pa.string()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())], names=["doc_id", "label", "digest", "chunks"])

    sample = labelled(docs, labels, "quality", rows).select(F.col("doc_id").cast("string").alias("doc_id"), "label", F.col("text").cast("string").alias("text"))
    sample = sample.mapInArrow(lean(run), "doc_id string, label int, digest binary, chunks binary").groupBy("doc_id", "label").agg(F.min(F.struct("digest", "chunks")).alias("x"))
    # equal texts teach once, so a large group of copies doesn't outweigh the rest
    found: dict[bytes, tuple[str, int, bytes]] = {}
    for r in sorted(sample.collect(), key=lambda r: r.doc_id):
        found[bytes(r.x.digest)] = (r.doc_id, r.label, bytes(r.x.chunks))
    chosen = sorted(found.values())
    return train([np.frombuffer(c, np.uint8).reshape(-1, CHUNK) for _, _, c in chosen], np.array([y for _, y, _ in chosen], np.float32))


def classify(docs: DataFrame, net: Network, keep: float = KEEP, score: str = "score", predicted: str = "predicted") -> DataFrame:
    """docs with its score (0 to 1) and 1 if score >= keep, else 0, in columns of the given names, which must be free."""
    if taken := {score.lower(), predicted.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has columns {sorted(taken)}; name others for the results")

    def run(batches):
        for b in batches:
            for part in slices(b, "text"):
                s = net.score(part.column("text").cast(pa.string()).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s, pa.float64()), pa.array((s >= keep).astype(np.int32))], names=[*part.schema.names, score, predicted])

    return docs.mapInArrow(lean(run), StructType([*docs.schema.fields]).add(score, DoubleType()).add(predicted, IntegerType()))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = classify(docs.select("doc_id", "text"), fit_network(docs, labels))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
