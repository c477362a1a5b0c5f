"""The work queue as pure transitions of a table.

queue: pos, name, kind, config (JSON), requires (array), status, retries, max_retries,
owner, heartbeat (epoch seconds). Each function returns the next table; Spark tables have
no compare-and-set, so writers take turns. `now` is always given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..core import Written, numbered

PENDING, RUNNING, DONE, FAILED = "pending", "running", "done", "failed"


class QueueError(ValueError):
    pass


def claimable(queue: DataFrame, now: float, ttl: float) -> DataFrame:
    """Entries that may be claimed: all they require is done, and they are pending, or running with no heartbeat or one older than ttl."""
    needs = queue.select("name", F.explode("requires").alias("need"))
    done = queue.where(F.col("status") == DONE).select(F.col("name").alias("need"))
    blocked = needs.join(done, "need", "left_anti").select("name").distinct()
    free = (F.col("status") == PENDING) | ((F.col("status") == RUNNING) & (F.col("heartbeat").isNull() | (F.lit(now) - F.col("heartbeat") > ttl)))
    return queue.where(free).join(blocked, "name", "left_anti")


def claim_next(queue: DataFrame, owner: str, now: float, ttl: float) -> DataFrame:
    """The queue after the first claimable entry in file order went to owner."""
    first = claimable(queue, now, ttl).orderBy("pos").limit(1).select(F.col("name").alias("won"))
    q = queue.join(F.broadcast(first), F.col("name") == F.col("won"), "left")  # one row at most
    won = F.col("won").isNotNull()
    return q.withColumns({"status": F.when(won, RUNNING).otherwise(F.col("status")), "owner": F.when(won, owner).otherwise(F.col("owner")), "heartbeat": F.when(won, float(now)).otherwise(F.col("heartbeat"))}).drop("won")


def owned(queue: DataFrame, name: str, owner: str) -> None:
    row = queue.where(F.col("name") == name).select("owner", "status").first()
    if row is None or row.owner != owner or row.status != RUNNING:
        raise QueueError(f"{name} is not running for {owner}")


def heartbeat(queue: DataFrame, name: str, owner: str, now: float) -> DataFrame:
    owned(queue, name, owner)
    return queue.withColumn("heartbeat", F.when(F.col("name") == name, float(now)).otherwise(F.col("heartbeat")))


def released(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """After outcomes (name, outcome): completed is done; preempted is pending again at no cost; failed costs a retry and fails for good beyond max_retries."""
    q = queue.join(outcomes, "name", "left")
    o, more = F.col("outcome"), F.col("retries") + 1
    q = q.withColumn("status", F.when(o == "completed", DONE).when(o == "preempted", PENDING).when(o == "failed", F.when(more <= F.col("max_retries"), PENDING).otherwise(FAILED)).otherwise(F.col("status")))
    q = q.withColumn("retries", F.when(o == "failed", more).otherwise(F.col("retries")))
    return q.withColumns({c: F.when(o.isNull(), F.col(c)) for c in ("owner", "heartbeat")}).drop("outcome")


def release(queue: DataFrame, name: str, owner: str, outcome: str) -> DataFrame:
    owned(queue, name, owner)
    return released(queue, queue.sparkSession.createDataFrame([(name, outcome)], "name string, outcome string"))


def extended(queue: DataFrame, new: DataFrame) -> DataFrame:
    """New entries whose names aren't there yet, in order behind the others; of a repeated new name the first."""
    from pyspark.sql import Window as W

    first = new.withColumn("r", F.row_number().over(W.partitionBy("name").orderBy("pos"))).where("r = 1").drop("r").join(queue.select("name"), "name", "left_anti")
    last = queue.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("last"))
    first = numbered(first, ["pos", "name"], "__pos").withColumn("pos", F.col("__pos")).drop("__pos").join(F.broadcast(last)).withColumn("pos", (F.col("pos") + F.col("last")).cast(queue.schema["pos"].dataType)).drop("last")
    return queue.unionByName(first.select(queue.columns))


def merged(queue: DataFrame, new: DataFrame) -> DataFrame:
    """New entries whose names aren't there yet, as they are: a name repeated among them stays repeated, and checked() finds it."""
    return queue.unionByName(new.join(queue.select("name"), "name", "left_anti").select(queue.columns))


def pending(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("status") == PENDING).alias("n"))


def fail_unsatisfiable(queue: DataFrame) -> DataFrame:
    """Pending entries that require a failed one fail too, until nothing changes. Entries that run are left alone.

    Only names travel: each round joins the last round's failures to the pending entries
    that require them, and its result is written so that lineage doesn't grow.
    """
    out = Written(queue.sparkSession, "queue")
    needs, _ = out.put(queue.where(F.col("status") == PENDING).select("name", F.explode("requires").alias("need")).distinct())
    new = queue.where(F.col("status") == FAILED).select("name")
    gone = None
    while True:
        hit = needs.join(new.select(F.col("name").alias("need")), "need", "left_semi").select("name").distinct()
        new, _ = out.put(hit if gone is None else hit.join(gone, "name", "left_anti"))
        if new.isEmpty():
            break
        gone = new if gone is None else gone.unionAll(new)
    if gone is None:
        return queue
    q = queue.join(gone.select(F.col("name").alias("hit")), F.col("name") == F.col("hit"), "left")
    return q.withColumn("status", F.when(F.col("hit").isNotNull(), FAILED).otherwise(F.col("status"))).drop("hit")


def is_drained(queue: DataFrame) -> DataFrame:
    return queue.agg(F.coalesce(F.bool_and(F.col("status").isin(DONE, FAILED)), F.lit(True)).alias("drained"))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    b = before.select("name", F.col("status").alias("was"))
    return after.join(b, "name").where(F.col("status") != F.col("was")).select("name", "was", "status")


def touched(before: DataFrame, after: DataFrame) -> DataFrame:
    """Names of the entries whose status changed and of those that run."""
    return changed(before, after).select("name").unionAll(after.where(F.col("status") == RUNNING).select("name")).distinct()


def duplicates(queue: DataFrame) -> DataFrame:
    """(name, n) of the names that come more than once."""
    return queue.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def checked(queue: DataFrame) -> DataFrame:
    """The queue; fails on repeated names."""
    if twice := [r.name for r in duplicates(queue).limit(5).collect()]:
        raise QueueError(f"names must be unique: {twice}")
    return queue
