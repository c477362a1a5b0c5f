"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Sources in code-point order (null last) have repeating weights. They share all words by
weight; a target stops at `most` times its source's size and the excess goes to the others
by weight: targets are min(most * size, level * weight) for the one level at which they
sum to all words.

Within its source a document has a place in one fixed order, by a hash of doc_id and text.
A pass over the source takes all of them. The last pass is to take a share of the source:
of its large documents (over a hundredth of it, so under a hundred) the first by hash that
come nearest to that share of their words, then of the others the first by hash whose
words come nearest to what is left. So size has no part in who is taken, and the mix ends
inside a small document. Cumulative words come from sums of hash buckets, more of them for
larger sources, so no source is ever gathered in one task.

A copy's cumulative words are a share of its source's demand. The integral of the source's
weight schedule over the run, inverted at that share, is the copy's training position.

Null texts have size 0 and are never taken; a null source is a source. Repeated rows are
rows of their own, and equal ones may change places; they share a bucket, in which sums
spill to disk. Null ids are dealt by their texts. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import Written, n_words

WEIGHTS, MOST = (5, 2, 1), 3
#: A schedule is (time, weight) knots from time 0 to 1, linear in between; one for each weight above.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 2.0)), ((0.0, 2.0), (0.5, 1.0), (1.0, 0.25)))
#: A table of at most so many bytes is sent to every executor; a larger one is joined by a shuffle. What a row takes beside its source.
MAX_SENT, ROW_BYTES = 20_000_000, 100
#: Rows of a source that its hash buckets have about; a bucket takes 1 to 16 times fewer.
BUCKET_ROWS = 4_000


def is_large() -> Column:
    """Of over a hundredth of its source."""
    return F.col("size") * 100 > F.col("source_size")

def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, kind, target) from one row (source, source_size) per source."""
    place = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("kind", ((F.row_number().over(place) - 1) % len(weights)).cast("int"))
    rows = rows.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("kind") + 1)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything, order = W.partitionBy(), W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", rest / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    # levels only fall from the first source that isn't full on, and that source's level holds for all
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return rows.withColumn("level", level).select("source", "source_size", "kind", F.round(F.least("cap", F.col("level") * F.col("weight")), 6).alias("target"))


def position(kind: Column, share: Column, schedules: Sequence = SCHEDULES) -> Column:
    """The time by which a schedule has spent `share` of its integral."""
    out = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        if knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)) or any(w < 0 for _, w in knots):
            raise ValueError("a schedule needs rising times from 0 to 1 and no negative weight")
        parts = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
        if sum(parts) <= 0:
            raise ValueError("a schedule must have some weight")
        demand, at, before = share * sum(parts), F.lit(1.0), sum(parts)
        for (t0, w0), (t1, w1), part in reversed([*zip(knots, knots[1:], parts, strict=False)]):
            before -= part
            slope, left = (w1 - w0) / (t1 - t0), demand - before
            inside = left / w0 if slope == 0 else (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * left)) - w0) / slope
            if part > 0:
                at = F.when(demand < before + part, F.least(F.lit(t1), t0 + inside)).otherwise(at)
        out = F.when(kind == k, at).otherwise(out)
    return out


def carrier(table: DataFrame, text: str) -> Callable[[DataFrame], DataFrame]:
    """A mark for tables of such rows to be sent, if their measured size allows; so the texts beside them needn't be shuffled."""
    size = table.agg((F.count("*") * ROW_BYTES + F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).alias("n")).first().n
    return F.broadcast if size <= MAX_SENT else lambda df: df


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, schedules: Sequence = SCHEDULES, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken, positions) of each row, and the columns named in keep as kept_ and their name."""
    out = Written(docs.sparkSession, "mixing")
    # the texts are read once for their sizes; only what keep names is read again
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).cast("binary"))
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest.alias("h"), *(F.col(c).alias(f"kept_{c}") for c in keep))
    slim, _ = out.put(sized.select("doc_id", "source", "size", "h"))
    rows = sized if keep else slim

    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(totals.drop("n"), weights, most).join(totals.select(F.col("source").alias("s"), "n"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    digits = F.greatest(F.lit(1), F.least(F.lit(8), F.ceil(F.log(F.greatest(F.col("n") / BUCKET_ROWS, F.lit(1.0))) / math.log(16)))).cast("int")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.select("source", "source_size", "kind", "target", digits.alias("digits"), passes.alias("passes"))
    goal, _ = out.put(goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")))
    sent = carrier(goal, "source")

    # a source has under a hundred large documents, so they fit a window
    own = lambda name: F.col("source").eqNullSafe(F.col(name))
    facts = lambda name, *cols: goal.select(F.col("source").alias(name), *cols)
    large = slim.join(sent(facts("s", "source_size", "rest")), own("s")).where(is_large())
    by_hash = W.partitionBy("source").orderBy("h", "doc_id", "size")
    large = large.withColumn("all", F.sum("size").over(W.partitionBy("source"))).withColumn("at", F.coalesce(F.sum("size").over(by_hash.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    share = F.col("rest") / F.col("source_size") * F.col("all")
    large = large.groupBy("source").agg(F.max("all").alias("all"), F.sum(F.when(F.col("at") + F.col("size") / 2.0 < share, F.col("size")).otherwise(0)).alias("used"))
    done = goal.join(large.select(F.col("source").alias("s"), "all", "used"), own("s"), "left").drop("s").na.fill(0, ["all", "used"]).withColumnRenamed("source", "s")

    rows = rows.join(sent(done), own("s")).drop("s")
    bucket = F.col("h").substr(F.lit(1), F.col("digits"))
    rows = rows.withColumns({"bucket": bucket, "big": F.when(is_large(), F.col("size")).otherwise(0)})
    sums = slim.join(sent(facts("s", "source_size", "digits")), own("s")).groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("n"), F.sum(F.when(is_large(), F.col("size")).otherwise(0)).alias("n_big"))
    back = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), *(F.coalesce(F.sum(c).over(back), F.lit(0)).alias(f"before_{c}") for c in ("n", "n_big")))
    sums, _ = out.put(sums)
    rows = rows.join(carrier(sums, "s")(sums), own("s") & (F.col("bucket") == F.col("b"))).drop("s", "b")
    inside = W.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    so_far = lambda c, before: F.col(before) + F.coalesce(F.sum(c).over(inside), F.lit(0))
    rows = rows.withColumns({"at": so_far("size", "before_n"), "at_big": so_far("big", "before_n_big")})
    middle = F.col("size") / 2.0
    last = F.when(is_large(), F.col("at_big") + middle < F.col("rest") / F.col("source_size") * F.col("all")).otherwise(F.col("at") - F.col("at_big") + middle < F.col("rest") - F.col("used"))
    rows = rows.withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + last.cast("int")).otherwise(0).cast("int"))
    places = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda k: position(F.col("kind"), F.least(F.lit(1.0), (F.col("at") + k * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1.0))), schedules)))
    places = places.otherwise(F.array().cast("array<double>"))
    return rows.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), places.alias("positions"), *(f"kept_{c}" for c in keep))


def in_order(planned: DataFrame) -> DataFrame:
    """One row per copy with its position, in training order over range partitions; the hash settles ties."""
    copies = planned.select("*", F.explode("positions").alias("position")).drop("positions")
    key = ["position", F.xxhash64("doc_id"), "doc_id"]
    return copies.repartitionByRange(*key).sortWithinPartitions(*key)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first_position is that of a document's first copy, null where the mix takes none; rows stand in its order."""
    planned = plan(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("first_position", F.round(F.get("positions", F.lit(0)), 6))
    key = [F.col("first_position").asc_nulls_last(), F.xxhash64("doc_id"), F.col("doc_id")]
    return planned.repartitionByRange(*key).sortWithinPartitions(*key).select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), k AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind, source_size * 3.0::DOUBLE AS cap FROM s
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][kind + 1] AS weight FROM k
), l AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, kind, round(least(cap, max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight), 6) AS target FROM l
), r AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS passes FROM t
), p AS (
  SELECT d.*, r.source_size, r.kind, r.target, r.passes, r.target - r.passes * r.source_size AS rest, d.size * 100 > r.source_size AS large,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_any,
         coalesce(sum(d.size) OVER (PARTITION BY d.source, d.size * 100 > r.source_size ORDER BY d.h, d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_like,
         coalesce(sum(CASE WHEN d.size * 100 > r.source_size THEN d.size END) OVER (PARTITION BY d.source), 0) AS all_large
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), g AS (
  SELECT *, large AND at_like + size / 2.0::DOUBLE < rest / source_size * all_large AS large_last FROM p
), c AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE passes + CASE WHEN large_last OR (NOT large AND at_like + size / 2.0::DOUBLE
            < rest - coalesce(sum(CASE WHEN large_last THEN size END) OVER (PARTITION BY source), 0)) THEN 1 ELSE 0 END END AS copies,
         least(1.0::DOUBLE, at_any / greatest(target, 1.0::DOUBLE)) AS x FROM g
)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS INTEGER) AS copies,
       CASE WHEN copies > 0 THEN round(CASE kind WHEN 0 THEN x
         WHEN 1 THEN CASE WHEN x * 1.125 < 0.375 THEN (sqrt(0.25 + 2.0::DOUBLE * (x * 1.125)) - 0.5)
                          WHEN x * 1.125 < 1.125 THEN 0.5 + (sqrt(1.0::DOUBLE + 4.0 * (x * 1.125 - 0.375)) - 1.0) / 2.0 ELSE 1.0 END
         ELSE CASE WHEN x * 1.0625 < 0.75 THEN (sqrt(4.0::DOUBLE - 4.0 * (x * 1.0625)) - 2.0) / -2.0
                   WHEN x * 1.0625 < 1.0625 THEN 0.5 + (sqrt(greatest(0.0::DOUBLE, 1.0 - 3.0 * (x * 1.0625 - 0.75))) - 1.0) / -1.5 ELSE 1.0 END END + 0.0, 6) END AS first_position
FROM c
"""
