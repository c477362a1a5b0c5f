"""A corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm import byte_cnn, mixing, near_dedup, packing, pii
from plumbline.llm.common import Written, spare, table

#: One of the stages can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It is trained on the labelled rows of docs."""
    net = byte_cnn.fit_network(docs, table(spark, sf_dir, "labels"))
    score, verdict = spare(docs.columns, "score"), spare(docs.columns, "predicted")
    return byte_cnn.classify(docs, net, score=score, predicted=verdict).where(F.col(verdict) == 1).select(docs.columns)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: five-word shingles, similarity 0.8."""
    return near_dedup.dedup(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by pseudonyms. n_chars follows the text, where it is a column."""
    out = pii.pseudonymise(docs, pii.key_of(spark))
    return (out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out).select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, in training order."""
    planned = mixing.plan(docs, keep=[c for c in docs.columns if c not in ("doc_id", "source")])
    rows = mixing.in_order(planned)
    return rows.select(*(c if c in ("doc_id", "source") else rows[f"kept_{c}"].alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's rows as sequences with their token ids, each of a power of two, numbered in training order; a task's sequences stand by bucket."""
    docs, place = packing.placed(docs)
    return packing.bucketed(packing.digests(packing.pack(docs, place=place), "ids"))


STAGES = [("quality classifier", quality), ("MinHash near-dedup", dedup), ("PII", private), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents. A stage's table goes when the next one is written."""
    out, docs, last = Written(spark, "pipeline"), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = out.put(stage(spark, docs, sf_dir))
        if last:
            out.drop(last)
        last = path
    return docs
