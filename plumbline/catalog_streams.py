"""Registered queries of data sources, sinks and streams: what Spark derives from the tables is written, read back or streamed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from .catalog import GUARD, PX, SQL, px, query, r6, results, runs, t
from .core import Written, fresh_path, spread
from .operators import raster as R
from .sources import formats, readers
from .streaming import claims, guard
from .streaming.upsert import Ledger


def frame_files(spark, sf) -> str:
    """A folder with a .npy file for each frame of the events' depth, written by the tasks that have the frames."""
    path = fresh_path(spark, "frames")
    frames = R.to_frames(px(spark, sf), "double")

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(path)
        fs.create_dir(root, recursive=True)
        for b in batches:
            for name, h, w, depth in zip(*(b.column(n) for n in ("frame_id", "h", "w", "depth")), strict=True):
                at = f"{root}/{name.as_py():012d}.npy"
                draft = f"{root}/.{name.as_py():012d}"
                with fs.open_output_stream(draft) as out:
                    out.write(readers.npy_bytes(depth.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(h.as_py(), w.as_py())))
                fs.move(draft, at)
            yield pa.RecordBatch.from_arrays([b.column("frame_id").cast(pa.int64())], ["frame_id"])

    spread(frames).mapInArrow(run, "frame_id long").write.format("noop").mode("overwrite").save()
    return path


def of_frames(frames):
    """Figures of frames: pixels of a frame are a row's array, so no pixel is shuffled."""
    valid = F.filter("depth", lambda d: d > 0)
    total = F.aggregate(valid, F.lit(0.0), lambda a, d: a + d.cast("double"))
    return frames.select(F.col("frame_id").cast("long").alias("frame_id"), "h", "w", F.size(valid).cast("long").alias("n_valid"), F.round(total / F.greatest(F.size(valid), F.lit(1)), 3).alias("mean_depth"), F.col("error").isNull().alias("whole"))


FRAMES_SQL = f"""WITH {PX} SELECT CAST(frame_id AS BIGINT) AS frame_id, CAST(max(v) + 1 AS INTEGER) AS h, CAST(max(u) + 1 AS INTEGER) AS w, count(*) FILTER (WHERE depth > 0) AS n_valid,
round(sum(CAST(CAST(depth AS FLOAT) AS DOUBLE)) / greatest(count(*) FILTER (WHERE depth > 0), 1), 3) AS mean_depth, true AS whole FROM px GROUP BY frame_id"""


@query(FRAMES_SQL)
def s1_frames(spark, sf):
    return of_frames(formats.frames(spark, frame_files(spark, sf)))


@query(FRAMES_SQL)
def t1_frame_stream(spark, sf):
    """The same frames, streamed into a table."""
    path, out = frame_files(spark, sf), fresh_path(spark, "streamed")
    rows = of_frames(formats.frames(spark, path, streaming=True, settle=0))
    rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


@query("""WITH o AS (SELECT o_orderkey AS i, length(o_orderpriority) AS n FROM orders)
SELECT CAST(i // 500 AS BIGINT) AS shard, count(*) AS n, CAST(sum(n) AS BIGINT) AS n_bytes, min(i) AS first, max(i) AS last FROM o GROUP BY i // 500""")
def k1_shards(spark, sf):
    """Orders as samples of shards of 500, committed together, and read back from the tar files."""
    rows = results(spark, sf)
    samples = rows.select(F.col("id").alias("frame_idx"), F.create_map(F.lit("txt"), F.encode("hypothesis", "utf-8")).alias("members"))
    path = fresh_path(spark, "tars")
    written = readers.write_shards(samples, path, 500).select("shard", "n")
    return written.join(readers.read_members(spark, path).groupBy("shard").agg(F.sum(F.octet_length("body")).alias("n_bytes"), F.min(F.col("stem").cast("long")).alias("first"), F.max(F.col("stem").cast("long")).alias("last")), "shard")


@query("""SELECT sha1(CAST(o_custkey % 50 AS VARCHAR)) AS config_hash, max(o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS score, min(o_orderkey) AS id, count(*) AS n_writes FROM orders GROUP BY 1""")
def x9_streamed_ledger(spark, sf):
    """Results streamed into the ledger file by file, half of the batches sent twice; n_writes adds up."""
    rows = results(spark, sf).select("config_hash", F.col("id").alias("seq"), "score", "id", F.lit(1).cast("long").alias("n_writes"))
    table, path = Written(spark, "feed").put(rows.repartition(6, "seq"))
    out = fresh_path(spark, "ledger")
    ledger = Ledger(spark, out, added=("n_writes",), buckets=8)
    put = ledger.sink("feed")

    def twice(batch, number):
        put(batch, number)
        if number % 2:
            put(batch, number)

    feed = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(path)
    feed.writeStream.foreachBatch(twice).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return ledger.read().select("config_hash", "seq", "score", "id", "n_writes")


@query(SQL["t3_loss_guard"])
def t3_guard_stream(spark, sf):
    """The loss guard over a stream: a file for each run, whose steps a batch brings in order."""
    table, path = Written(spark, "runs").put(runs(spark, sf).repartition(8, "run").sortWithinPartitions("run", "step"))
    log, out = spark.readStream.schema(table.schema).parquet(path), fresh_path(spark, "guarded")
    events = guard.guard_stream(log.select("run", "step", "loss"), GUARD)
    events.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).outputMode("append").start(out).awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select("run", "step", *r6("ema_loss", "best_ema"), "best_step", "worsening", "rollbacks", "event")


@query("""SELECT name, owner, 'running' AS status, CASE WHEN k = 1 THEN 'claim' ELSE 'refused' END AS event, n FROM (
SELECT name, owner, k, count(*) AS n FROM (SELECT CAST(o_custkey AS VARCHAR) AS name, CAST(min(o_orderkey) OVER w AS VARCHAR) AS owner, least(2, row_number() OVER (w ORDER BY o_orderkey)) AS k FROM orders WINDOW w AS (PARTITION BY o_custkey)) GROUP BY name, owner, k)""")
def t5_claims(spark, sf):
    """Orders claim their customer, streamed: the first one wins, and all others are refused until its claim runs out, which takes longer than this."""
    text = lambda c: F.col(c).cast("string")
    events = t(spark, sf, "orders").select(text("o_custkey").alias("name"), text("o_orderkey").alias("owner"), F.lit(claims.CLAIM).alias("kind"), F.lit(None).cast("string").alias("outcome"), F.col("o_orderkey").cast("double").alias("at"))
    table, path = Written(spark, "claims").put(events)
    out = fresh_path(spark, "claimed")
    with claims.configured(spark):  # one batch: with timers there would always be a next one
        rows = claims.claims(spark.readStream.schema(table.schema).parquet(path), 1e6)
        rows.writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(once=True).outputMode("append").start(out).awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("name", "owner", "status", "event").agg(F.count("*").alias("n"))
