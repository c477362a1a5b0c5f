"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder of its own; on any
    other master that would be a folder per machine, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import atexit
    import shutil
    import tempfile

    made = getattr(shared_dir, "made", None)
    if made is None:
        made = shared_dir.made = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
    return f"file://{made}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str | Column) -> DataFrame:
    """df over as many tasks as shuffles have, for kernels that take long on few bytes: adaptive execution would join such rows to one task."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism), *keys)


def numbered(df: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """df with the place of each row in `order`, from 1 on.

    Rows are dealt by ranges of the order and sorted there, and written, so that their places stay what they are;
    the rows of each range then give the number at which the next one starts. No task has more
    than a range, and only the ranges' counts meet. Rows equal in the order are in one range.
    """
    spark, out = df.sparkSession, Written(df.sparkSession, "numbered")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    rows, _ = out.put(rows.select(*df.columns, F.shiftright("__at", 33).cast("int").alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__at")))
    counts = sorted(map(tuple, rows.groupBy("__part").agg(F.count("*").alias("n")).collect()))  # one a range
    starts = spark.createDataFrame([(p, before) for (p, _), before in zip(counts, accumulate((n for _, n in counts), initial=0), strict=False)], "__part int, __start long")
    return rows.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__at") + 1).select(*df.columns, name)


def ranked(df: DataFrame, by: str, order: list[Column], place: str = "place", size: str = "n") -> DataFrame:
    """df with the place of each row in its group, from 1 on, and the group's size. Groups of any size: the rows of all groups are numbered together, and a group's places start at its smallest number."""
    rows = numbered(df, [by, *order], "__number")
    groups = rows.groupBy(F.col(by).alias("__by")).agg(F.min("__number").alias("__least"), F.count("*").alias(size))
    return rows.join(groups, F.col(by).eqNullSafe(F.col("__by"))).withColumn(place, F.col("__number") - F.col("__least") + 1).select(*df.columns, place, size)


class Written:
    """Tables written to the shared folder to cut lineage; drop() removes the given ones, or all."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, fresh_path(spark, name), 0

    def put(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        if self.n == 1:  # what isn't dropped before goes with the driver
            fs, root = file_system(self.spark, self.root)
            fs.deleteOnExit(root)
        return self.spark.read.schema(df.schema).parquet(path), path

    def drop(self, *paths: str) -> None:
        for p in paths or (self.root,):
            delete(self.spark, p)


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = file_system(spark, path)
    fs.delete(p, True)
