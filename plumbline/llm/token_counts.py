"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch of changes is turned into signed deltas against the counts that are in force: an
insert adds a document's tokens, a delete takes its last count away, and a revised count,
source or language does both. Deltas are additive, so they are pre-aggregated before they
are shuffled, and totals are sums over the committed batches; no batch reads the corpus.

A batch is staged in a folder of its own and committed by renaming that folder to the place
behind the batches it has read, which fails if another writer was there first; then the batch is
worked out anew behind that one. Committing an id again changes nothing, and a batch that fails midway leaves
only a stage that nobody reads, so a driver may repeat any batch, and drivers may send one at the same time.
Stores without such a rename need one writer at a time.

Keys are (doc_id, tokenizer). Of several changes to one key in a batch the one with the
largest `seq` counts (of equal ones the larger count, then the delete last). Deleting what isn't there, or
inserting what is there already unchanged, gives no delta. So of a doc_id repeated in one
batch one text counts, the one of most tokens. Rows with a null doc_id can't be found
again: each insert of one adds and each delete takes away. Rows with a null tokenizer are
left out; a null source or language is a group of its own; a null text has no tokens. An
empty batch commits and changes nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

import public_tokenizers
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import delete, file_system, fresh_path, slices
from .packing import tokens

CHANGE = "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint, deleted boolean, seq bigint"
LEDGER = "doc_id bigint, tokenizer string, source string, lang string, n_tokens bigint, deleted boolean"
DELTA = "source string, lang string, tokenizer string, docs bigint, tokens bigint"
#: Versions that count_tokens knows: runs of other than ASCII white space, and a public vocabulary.
VERSIONS = ("words/1", "word_bpe_49k/1")
KEY, COMPACT = ["doc_id", "tokenizer"], "compact"
#: Rows of a bucket when the ledger is laid out.
BUCKET_ROWS = 1 << 20


class PlaceTaken(RuntimeError):
    """Another writer has committed behind the batches that were read; nothing has changed."""


def count_tokens(docs: DataFrame, versions: Sequence[str] = VERSIONS, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens) of every document's whole text under each version."""
    if unknown := set(versions) - set(VERSIONS):
        raise ValueError(f"unknown tokenizer versions: {sorted(unknown)}")
    path, versions = tokenizer or public_tokenizers.path("word_bpe_49k.json"), list(versions)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "lang", F.col("text").cast("string").alias("text"))

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, "text")):
            texts = b.column(3).to_pylist()
            of = {"words/1": lambda: [len((t or "").encode().split()) for t in texts], "word_bpe_49k/1": lambda: [len(x) // 4 for x in tokens(path).encode(texts)]}
            for v in versions:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([v] * b.num_rows, pa.string()), pa.array(of[v](), pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    return rows.mapInArrow(run, "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")


def changes(counts: DataFrame, deleted: bool = False, seq: Column | None = None) -> DataFrame:
    """Counts as inserts or revisions, or as deletes."""
    return counts.select("doc_id", "source", "lang", "tokenizer", "n_tokens", F.lit(deleted).alias("deleted"), (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"))


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


class TokenRollup:
    """The totals kept under a folder that all executors share.

    The ledger lies in folders by a hash of doc_id, each sorted by doc_id. The first batch, and each
    compaction anew, settles their number by the rows it has, `buckets` at least. A batch reads the
    folders of its own documents only, there the parts between its smallest and its largest id, and of them
    the rows with its own ids are aggregated. `compact` puts one ledger in the place of all earlier ones.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root, self.least = spark, root.rstrip("/"), buckets

    def marks(self, pattern: str) -> list[tuple[int, str]]:
        """(place, name) of folders that mark committed batches, in order."""
        fs, p = file_system(self.spark, f"{self.root}/committed/*/{pattern}")
        found = [s.getPath() for s in fs.globStatus(p) or []]
        return sorted((int(f.getParent().getName()), f.getName()) for f in found)

    def batches(self) -> list[str]:
        """Ids of the committed batches, in order; a batch's place here is its folder's name."""
        return [name.removeprefix("id=") for _, name in self.marks("id=*")]

    def in_use(self) -> list[int]:
        """Places of the last compaction and of the batches behind it."""
        names = self.batches()
        return list(range(max((i for i, n in enumerate(names) if n == COMPACT), default=0), len(names)))

    @property
    def buckets(self) -> int | None:
        """The number of buckets of the ledgers in use, None before the first batch."""
        settled = self.marks("buckets=*")
        return int(settled[-1][1].removeprefix("buckets=")) if settled else None

    def mark(self, stage: str, name: str) -> None:
        fs, p = file_system(self.spark, f"{stage}/{name}")
        fs.mkdirs(p)

    def settle(self, stage: str, rows: int) -> int:
        """As many buckets as hold so many rows, from this stage on."""
        buckets = max(self.least, -(-rows // BUCKET_ROWS))
        self.mark(stage, f"buckets={buckets}")
        return buckets

    def read(self, what: str, schema: str) -> DataFrame:
        """A table over the batches in use, with the batch's place as `batch`."""
        places = self.in_use()
        if not places:
            return self.spark.createDataFrame([], f"{schema}, batch bigint")
        # the folders' names bring `bucket` for the ledger, and prune what is read
        parts = [self.spark.read.schema(schema).parquet(f"{self.root}/committed/{n:09d}/{what}").withColumn("batch", F.lit(n).cast("bigint")) for n in places]
        return reduce(DataFrame.unionByName, parts)

    def in_force(self, keys: DataFrame | None = None) -> DataFrame:
        """The last entry of each key (doc_id, tokenizer), or of the given ones only; deleted ones included."""
        value, rows = F.struct("batch", "source", "lang", "n_tokens", "deleted"), self.read("ledger", f"{LEDGER}, bucket int")
        if keys is not None and (buckets := self.buckets):
            wanted = keys.groupBy(bucket_of(buckets).alias("bucket")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo IS NOT NULL").collect()  # a row per bucket at most
            rows = rows.where(F.col("bucket").isin([r.bucket for r in wanted]))
            if wanted:
                rows = rows.where(F.col("doc_id").between(min(r.lo for r in wanted), max(r.hi for r in wanted)))
            rows = rows.join(keys, KEY, "left_semi")
        return rows.groupBy(*KEY).agg(F.max_by(value, "batch").alias("v")).select(*KEY, "v.source", "v.lang", "v.n_tokens", "v.deleted")

    def put(self, ledger: DataFrame, path: str, buckets: int) -> None:
        ledger.withColumn("bucket", bucket_of(buckets)).repartition("bucket").sortWithinPartitions("bucket", "doc_id").write.partitionBy("bucket").parquet(path)

    def publish(self, stage: str, name: str, place: int) -> None:
        """Renames a stage to its place, if that is free; a reader sees all of a batch or nothing."""
        self.mark(stage, f"id={name}")
        fs, source = file_system(self.spark, stage)
        gateway, hadoop = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm.org.apache.hadoop.fs
        target = hadoop.Path(f"{self.root}/committed/{place:09d}")
        fs.mkdirs(target.getParent())
        context = hadoop.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(source, target, gateway.new_array(getattr(hadoop, "Options$Rename"), 0))  # no option: never onto what is there
        except Py4JJavaError:
            if not fs.exists(target):
                raise
            delete(self.spark, stage)
            raise PlaceTaken(f"batch {name} was overtaken at place {place}") from None

    def staged(self, name: str) -> str:
        return f"{self.root}/staged/{fresh_path(self.spark, name).rsplit('/', 1)[1]}"

    def commit(self, batch_id: str, change: DataFrame) -> bool:
        """Applies a batch once. False if a batch of that id has been committed before."""
        if not re.fullmatch(r"[\w.=-]+", batch_id) or batch_id == COMPACT:
            raise ValueError("a batch id may have letters, digits and . _ = - only, and not be the name of a compaction")
        while True:
            try:
                return self.applied(batch_id, change)
            except PlaceTaken:
                continue  # behind the other writer's batch, which may be this one

    def applied(self, batch_id: str, change: DataFrame) -> bool:
        done = self.batches()
        if batch_id in done:
            return False
        stage = self.staged(batch_id)
        entry = F.struct("seq", F.coalesce("n_tokens", F.lit(0)).alias("n"), "deleted", "source", "lang")
        # counting is the costly part of a change, and two tables come from it: it is written once
        change.where("tokenizer IS NOT NULL").select(*(F.col(c).cast(kind) for c, kind in (x.split(" ") for x in CHANGE.split(", ")))).write.parquet(f"{stage}/changes")
        change = self.spark.read.schema(CHANGE).parquet(f"{stage}/changes")
        new = change.where("doc_id IS NOT NULL").groupBy(*KEY).agg(F.max(entry).alias("e"))
        new = new.select(*KEY, "e.source", "e.lang", F.col("e.n").alias("n_tokens"), F.coalesce("e.deleted", F.lit(False)).alias("deleted"))
        self.put(new, f"{stage}/ledger", self.buckets or self.settle(stage, change.count()))
        new = self.spark.read.schema(f"{LEDGER}, bucket int").parquet(f"{stage}/ledger").drop("bucket")
        old = self.in_force(new.select(*KEY)).where("NOT deleted") if done else new.limit(0)
        # rows without an id can't be found again: each insert adds, each delete takes away
        loose = change.where("doc_id IS NULL").select("source", "lang", "tokenizer", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.when(F.coalesce("deleted", F.lit(False)), -1).otherwise(1).alias("sign"))
        signed = [df.select("source", "lang", "tokenizer", "n_tokens", F.lit(k).alias("sign")) for df, k in ((new.where("NOT deleted"), 1), (old, -1))]
        signed = signed[0].unionByName(signed[1]).unionByName(loose)
        delta = signed.groupBy("source", "lang", "tokenizer").agg(F.sum("sign").cast("bigint").alias("docs"), F.sum(F.col("sign") * F.col("n_tokens")).cast("bigint").alias("tokens"))
        delta.where("docs <> 0 OR tokens <> 0").write.parquet(f"{stage}/deltas")
        delete(self.spark, f"{stage}/changes")
        self.publish(stage, batch_id, len(done))
        return True

    def compact(self, remove: bool = False) -> None:
        """One ledger and one table of totals instead of all so far, in buckets for its size. With remove, older data go; their folders stay, as they hold the ids that were committed. PlaceTaken, and nothing is done, if a batch comes in between."""
        stage, before = self.staged("compact"), len(self.batches())
        self.put(self.in_force().where("NOT deleted"), f"{stage}/ledger", self.settle(stage, self.read("ledger", f"{LEDGER}, bucket int").count()))
        self.totals().select("source", "lang", "tokenizer", F.col("n_docs").alias("docs"), F.col("n_tokens").alias("tokens")).write.parquet(f"{stage}/deltas")
        self.publish(stage, COMPACT, before)
        for n in range(before) if remove else ():
            for what in ("ledger", "deltas"):
                delete(self.spark, f"{self.root}/committed/{n:09d}/{what}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of the groups that have documents."""
        sums = self.read("deltas", DELTA).groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 OR n_tokens <> 0")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents are inserted, those labelled toxic deleted again, and those with repeated lines revised to their count without; then the first two batches are sent once more."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rollup = TokenRollup(spark, fresh_path(spark, "token-counts"))
    rollup.commit("insert", changes(count_tokens(docs)))
    toxic = labels.where("toxic = 1").select(F.col("doc_id").cast("bigint").alias("doc_id")).distinct()
    gone = changes(rollup.in_force().join(toxic, "doc_id", "left_semi"), deleted=True)
    rollup.commit("delete-toxic", gone)
    lines = F.split("text", "\n", -1)
    repeated = docs.where(F.size(F.array_distinct(lines)) < F.size(lines)).withColumn("text", F.array_join(F.array_distinct(lines), "\n"))
    rollup.commit("revise-lines", changes(count_tokens(repeated.join(toxic, "doc_id", "left_anti"))))
    rollup.commit("insert", changes(count_tokens(docs)))
    rollup.commit("delete-toxic", gone)
    return rollup.totals()
