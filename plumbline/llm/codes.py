"""Codes of vectors by product quantisation over whole numbers, learned from distinct parts.

A component x is floor(1024 * x). Vectors are cut into equal parts, and equal parts of a
position are one row with a weight. Lloyd's rounds run over these rows: a task adds up its
rows' components by entry, and only those sums, as many as the codebooks have components,
reach the driver. Codes and errors are joined back to the vectors by part. All arithmetic is of
whole numbers, so the result depends neither on the order of rows nor on the number of tasks.

A part that over 1/256 of all rows share is dealt to 64 tasks in that join; there are fewer than 256
such parts in a position, so telling the rows of them takes a broadcast of bounded size.

Rows whose vector is null or holds null or non-finite components take no part; nor do
vectors of another length than that of the smallest vec_id (its shortest), or of a length
that isn't a positive multiple of the number of parts. Null vec_ids stand last. Repeated rows are rows of
their own; rows of one vec_id have the order of their components. With fewer rows than entries the
codebooks have an entry for each row. Components and errors beyond 64 bits are
held at the largest or smallest such number. Labels may be null, and null ones are equal. An empty
table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Written, table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: A part of more than 1 / HOT of all rows is dealt to SALTS tasks. Rows of a product, and rows compared one by one where numbers are large.
HOT, SALTS, ROWS, FEW = 256, 64, 1 << 14, 64
MOST = (1 << 63) - 1
#: A table of at most so many bytes is sent to every executor.
MAX_SENT = 20_000_000


def whole(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """(row, vec_id, label, cut): the parts of each kept vector as whole numbers. row tells repeated rows apart once this is written."""
    finite = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", "label", F.col("vector").cast("array<double>").alias("vector")).where(F.coalesce(finite & (F.size("vector") > 0), F.lit(False)))
    first = rows.select("vec_id", F.size("vector").alias("n")).orderBy(F.col("vec_id").asc_nulls_last(), "n").first()
    width = first.n // parts if first and first.n % parts == 0 else 0
    numbers = F.transform("vector", lambda x: F.floor(x * 1024).cast("long"))
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("numbers", p * width + 1, F.lit(max(width, 1))))
    rows = rows.where(F.size("vector") == (width * parts or -1)).withColumn("numbers", numbers)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", cut.alias("cut"))


def matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def nearest(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, squared distance) of the nearest entry of each row, the lower index among equal ones."""
    codes, errors = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    most = max((float(np.abs(x.astype(float)).max()) for x in (rows, book) if x.size), default=0.0)
    if 4 * rows.shape[1] * most * most < 2**53:  # all sums are whole numbers that doubles hold
        b = book.astype(float)
        own = (b * b).sum(axis=1)
        for at in range(0, len(rows), ROWS):
            r = rows[at : at + ROWS].astype(float)
            far = (r * r).sum(axis=1)[:, None] - 2 * (r @ b.T) + own
            code = far.argmin(axis=1)
            codes[at : at + ROWS], errors[at : at + ROWS] = code, far[np.arange(len(r)), code]
        return codes, errors
    b = book.astype(object)
    for at in range(0, len(rows), FEW):
        far = ((rows[at : at + FEW].astype(object)[:, None, :] - b) ** 2).sum(axis=2)
        for i, f in enumerate(far.tolist(), at):
            error = min(f)
            codes[i], errors[i] = f.index(error), min(error, MOST)
    return codes, errors


def positions(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, places in the batch, their parts)."""
    pos, rows = batch.column("pos").to_numpy(zero_copy_only=False), matrix(batch.column("part"))
    for p in np.unique(pos):
        here = np.flatnonzero(pos == p)
        yield int(p), here, rows[here]


def summed(books: np.ndarray):
    """Over distinct parts: each entry's weighted sum, as sums of upper and lower halves, and weight, by component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(books.shape, np.int64), np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            weights = batch.column("weight").to_numpy(zero_copy_only=False)
            for p, here, rows in positions(batch):
                code, w = nearest(rows, books[p])[0], weights[here]
                np.add.at(n[p], code, w)
                np.add.at(high[p], code, (rows >> 32) * w[:, None])
                np.add.at(low[p], code, (rows & 0xFFFFFFFF) * w[:, None])
        pos, entry = np.nonzero(n)
        d = books.shape[2]
        keys = [pa.array(x, pa.int32()) for x in (np.repeat(pos, d), np.repeat(entry, d), np.tile(np.arange(d), len(pos)))]
        yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x) for x in (np.repeat(n[pos, entry], d), high[pos, entry].ravel(), low[pos, entry].ravel()))], ["pos", "entry", "at", "n", "high", "low"])

    return run


def coder(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for p, here, rows in positions(batch):
                code[here], error[here] = nearest(rows, books[p])
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("part"), batch.column("weight"), pa.array(code, pa.int32()), pa.array(error)], ["pos", "part", "weight", "code", "error"])

    return run


def distinct_parts(cut: DataFrame) -> DataFrame:
    """(pos, part, weight): equal parts of a position are one row."""
    return cut.select(F.posexplode("cut").alias("pos", "part")).groupBy("pos", "part").agg(F.count("*").alias("weight"))


def learn(distinct: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, component) after Lloyd's rounds over weighted distinct parts."""
    books = start
    for _ in range(rounds):
        sums = distinct.mapInArrow(summed(books), "pos int, entry int, at int, n long, high long, low long").groupBy("pos", "entry", "at").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"))
        books = books.copy()
        for r in sums.collect():  # as many rows as the codebooks have components
            books[r.pos, r.entry, r["at"]] = ((r.high << 32) + r.low) // r.n
    return books


def join_back(cut: DataFrame, coded: DataFrame, n: int) -> DataFrame:
    """(row, vec_id, label, pos, code, error): the codes of distinct parts, joined to the vectors that have them."""
    is_hot = F.col("weight") * HOT > n
    hot = coded.where(is_hot).select("pos", "part", F.lit(True).alias("hot"))
    rows = cut.select("row", "vec_id", "label", F.posexplode("cut").alias("pos", "part")).join(F.broadcast(hot), ["pos", "part"], "left")
    rows = rows.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    codes = coded.select("pos", "part", "code", "error", F.explode(salts).alias("salt"))
    key = F.xxhash64("pos", "part").alias("h")  # numbers sort faster than arrays
    return rows.drop("hot").select("*", key).join(codes.select("*", key), ["h", "pos", "salt", "part"]).select("row", "vec_id", "label", "pos", "code", "error")


def sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error), codebooks) of a table with columns vec_id, vector and label."""
    out = Written(vectors.sparkSession, "codes")
    cut, _ = out.put(whole(vectors, parts))
    n = cut.count()
    first = cut.orderBy(F.col("vec_id").asc_nulls_last(), "cut").limit(entries).select("cut").collect()
    start = np.array([r.cut for r in first], np.int64).swapaxes(0, 1) if first else np.zeros((parts, 0, 0), np.int64)
    distinct, _ = out.put(distinct_parts(cut))
    books = learn(distinct, start, rounds if first else 0)
    coded, _ = out.put(distinct.mapInArrow(coder(books), "pos int, part array<long>, weight long, code int, error long"))
    digits = max(2, len(f"{entries - 1:x}"))
    code = F.concat(*(F.lpad(F.lower(F.hex(F.max(F.when(F.col("pos") == p, F.col("code"))))), digits, "0") for p in range(parts)))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    rows = join_back(cut, coded, n).groupBy("row", "vec_id", "label").agg(code.alias("code"), total.alias("error"))
    rows, _ = out.put(rows.drop("row"))
    return rows, books


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with the sum of the errors of their label. Few labels are sent to the rows; many are joined by a shuffle whose skewed tasks Spark splits."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    totals, _ = Written(rows.sparkSession, "label-errors").put(rows.groupBy(F.col("label").alias("of")).agg(total.alias("label_error")))
    size = totals.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col("of").cast("string")), F.lit(0)) + 64), F.lit(0)).alias("n")).first().n
    return rows.join(F.broadcast(totals) if size <= MAX_SENT else totals, F.col("label").eqNullSafe(F.col("of"))).drop("of")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"), "label"))
    return with_label_error(rows).select("vec_id", "code", "error", "label_error", F.lit(sha256(books)).alias("codebooks_sha256"))


def _sql() -> str:
    assign = """a{i} AS MATERIALIZED (
  SELECT r, pos, arg_min(e, d * 1000 + e) AS e, min(d) AS d FROM (
    SELECT p.r, p.pos, b.e, CAST(list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x) AS BIGINT) AS d FROM p JOIN b{i} b USING (pos)
  ) GROUP BY r, pos
)"""
    move = """b{j} AS MATERIALIZED (
  SELECT b.pos, b.e, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN (
    SELECT pos, e, list(v ORDER BY place) AS x FROM (
      SELECT a.pos, a.e, t.place, floor(sum(p.x[t.place]) / count(*)) AS v FROM a{i} a JOIN p USING (r, pos), (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM p))) AS place) t GROUP BY a.pos, a.e, t.place
    ) GROUP BY pos, e
  ) n USING (pos, e)
)"""
    steps = [s for i in range(ROUNDS) for s in (assign.format(i=i), move.format(i=i, j=i + 1))]
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, pos, x[pos * (len(x) // {PARTS}) + 1 : (pos + 1) * (len(x) // {PARTS})] AS x FROM k, (SELECT unnest(range({PARTS})) AS pos)
), b0 AS MATERIALIZED (
  SELECT pos, r AS e, x FROM p WHERE r < {ENTRIES}
), {", ".join(steps)}, {assign.format(i=ROUNDS)}, c AS (
  SELECT r, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r
), s AS (
  SELECT sha256(string_agg(CAST(CAST(v AS BIGINT) AS VARCHAR), ',' ORDER BY pos, e, place)) AS sha FROM (SELECT pos, e, unnest(x) AS v, unnest(range(len(x))) AS place FROM b{ROUNDS})
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, s.sha AS codebooks_sha256 FROM k JOIN c USING (r), s
"""


SQL = _sql()
