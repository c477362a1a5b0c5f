"""A ledger that streams feed: one row per key, in buckets, changed by whole batches that count once.

A version of the ledger is a small file that names the folder of each bucket and the last
batch of each stream. A batch reads and rewrites only the buckets of its keys, and then puts the
next version's file in place, which fails if another writer was there first. A batch whose
number the ledger has is left out, so what a stream sends again after a crash changes
nothing, sums included. Old versions stay readable until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..core import delete, file_system
from ..sources.sinks import put_new

LOG = "_versions"


class Conflict(RuntimeError):
    """Another writer made the next version."""


class Ledger:
    """Rows by `key`: of equal keys the row of the largest seq, `kept` columns of the smallest, and sums of the `added` columns.

    Rows of one key with one seq are ordered by their other columns. Rows without a key or seq
    are an error, since they would belong to no row. `buckets` is fixed when the ledger is
    made; a bucket's rows are rewritten together, so choose as many as tasks should write.
    """

    def __init__(self, spark: SparkSession, root: str, key: str = "config_hash", seq: str = "seq", kept: tuple[str, ...] = ("id", "config_json"), added: tuple[str, ...] = (), buckets: int = 64):
        if buckets < 1:
            raise ValueError("a ledger needs a bucket")
        self.spark, self.root, self.key, self.seq, self.kept, self.added, self.buckets = spark, root.rstrip("/"), key, seq, kept, added, buckets
        self.fs, log = file_system(spark, f"{self.root}/{LOG}")
        self.fs.mkdirs(log)
        self.buckets = self.version().get("n_buckets", buckets)

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(file_system(self.spark, f"{self.root}/{LOG}")[1]))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self, number: int | None = None) -> dict:
        """What a version's file says; of the newest, or of none yet."""
        known = self.versions()
        if not known:
            return {"number": -1, "batches": {}, "folders": {}, "schema": None}
        at = known[-1] if number is None else number
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/{LOG}/{at:020d}.json", wholetext=True).collect()))

    def of_folders(self, version: dict, folders: list[str]) -> DataFrame | None:
        if version["schema"] is None or not folders:
            return None
        return self.spark.read.schema(StructType.fromJson(version["schema"])).parquet(*(f"{self.root}/{f}" for f in folders))

    def read(self, number: int | None = None) -> DataFrame | None:
        """The ledger's rows; None before the first batch."""
        v = self.version(number)
        rows = self.of_folders(v, sorted(set(v["folders"].values())))
        return None if rows is None else rows.drop("__first")

    def merged(self, old: DataFrame | None, new: DataFrame) -> DataFrame:
        lost = F.col(self.key).isNull() | F.col(self.seq).isNull()
        new = new.withColumn(self.key, F.when(lost, F.raise_error(F.lit(f"a row without {self.key} or {self.seq}"))).otherwise(F.col(self.key))).withColumn("__first", F.col(self.seq))
        rows = new if old is None else old.unionByName(new)
        kept, added = [c for c in self.kept if c in rows.columns], [c for c in self.added if c in rows.columns]
        rest = [c for c in rows.columns if c not in (self.key, "__first", *kept, *added)]
        out = rows.groupBy(self.key).agg(
            F.max(F.struct(self.seq, *(c for c in rest if c != self.seq))).alias("__last"), F.min(F.struct("__first", *kept)).alias("__start"), *(F.sum(c).cast(rows.schema[c].dataType).alias(c) for c in added)
        )
        pick = lambda c: F.col(c) if c == self.key or c in added else F.col(f"__start.{c}").alias(c) if c == "__first" or c in kept else F.col(f"__last.{c}").alias(c)
        return out.select(*map(pick, rows.columns))

    def apply(self, batch: DataFrame, stream: str, number: int) -> bool:
        """Whether batch `number` of a stream was new; if so, it is in the ledger now."""
        v = self.version()
        if v["batches"].get(stream, -1) >= number:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
        folders = dict(v["folders"])
        if touched:
            old = self.of_folders(v, [folders[str(b)] for b in touched if str(b) in folders])
            rows, made = self.merged(old, batch), f"rows-{uuid.uuid4().hex}"
            rows.withColumn("__bucket", bucket).repartition(len(touched), "__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{made}")
            folders |= {str(b): f"{made}/__bucket={b}" for b in touched}
        schema = json.loads(rows.schema.json()) if touched else v["schema"]
        new = {"number": v["number"] + 1, "n_buckets": self.buckets, "batches": {**v["batches"], stream: number}, "folders": folders, "schema": schema}
        if not put_new(self.spark, f"{self.root}/{LOG}/{new['number']:020d}.json", json.dumps(new, sort_keys=True)):
            raise Conflict(f"{self.root} has a version {new['number']} of another writer; send batch {number} again")
        return True

    def sink(self, stream: str) -> Callable[[DataFrame, int], None]:
        """For foreachBatch. `stream` names the query and goes with its checkpoint: a new checkpoint needs a new name, as it counts batches from 0."""
        return lambda batch, number: self.apply(batch, stream, number)

    def vacuum(self) -> int:
        """Removes versions before the newest and folders that it doesn't name; how many folders went."""
        v = self.version()
        for n in self.versions()[:-1]:
            delete(self.spark, f"{self.root}/{LOG}/{n:020d}.json")
        used, gone = {f.split("/")[0] for f in v["folders"].values()}, 0
        for s in self.fs.listStatus(file_system(self.spark, self.root)[1]):
            name = s.getPath().getName()
            if name.startswith("rows-"):
                here = {f.split("/")[1] for f in v["folders"].values() if f.startswith(f"{name}/")}
                for part in [None] if name not in used else [p.getPath().getName() for p in self.fs.listStatus(s.getPath())]:
                    if part is None or part.startswith("__bucket=") and part not in here:
                        delete(self.spark, f"{self.root}/{name}" + (f"/{part}" if part else ""))
                        gone += 1
        return gone
