"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Language ID drops what has no letters or no certain language; near-dedup keeps one document of each group; benchmark
decontamination drops documents that hold a window of an item; personal data is replaced by [KIND]; best-fit packing
gives the bin and offset of every piece.  Stages return the columns of documents only; others are left out.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import decontaminate, langid, minhash, packing, pii
from riskloom.llm.common import exists, scratch, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is predicted without ambiguity; lang itself is left as it is."""
    found = langid.identify(docs.select(*COLUMNS), langid.train(docs))
    return found.filter((F.col("lang_pred") != langid.UND) & ~F.col("ambiguous")).select(*COLUMNS)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near-duplicates."""
    return minhash.without_near_duplicates(docs.select(*COLUMNS))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds a window of a benchmark item."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).filter(~F.col("contaminated")).select(*COLUMNS)


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; its spans of personal data become [KIND]."""
    found = pii.find_spans(docs.select(*COLUMNS)).withColumn("text", pii.redacted(F.col("text"), F.col("spans")))
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and offset of every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii_redaction", pii_redaction),
    ("best_fit_packing", best_fit_packing),
]

#: The stages aren't all expressible in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """All stages, in order, on documents.

    Each stage's own tables go once it is written.  With a folder of the shared store, a later run after a lost driver
    goes on behind the last stage that was finished there; it must be a new folder for other documents.
    """
    docs = table(spark, sf_dir, "documents")
    folder = folder or f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        if not exists(spark, f"{path}/_SUCCESS"):
            with scratch(spark):
                stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    return docs
