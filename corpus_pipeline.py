"""Cleaning a corpus: stages that each read what the one before kept, written as Parquet in between.

Toxic documents go; of documents whose word n-grams are similar, directly or over others, the one with the least id
stays; documents contaminated by the benchmark go; secrets are masked; what is left is packed into token sequences.
Every stage but the last returns the columns of its input.  Extra columns are carried along.

Stages pass whole texts to Python, so they ask for Arrow batches of at most ``BATCH_ROWS`` rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, ngram_join, packing, secrets, toxicity
from quadrille.plans.staging import stage

BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the scorer is fitted on the labels of those that are not held out."""
    _small_batches(spark)
    return toxicity.reject_toxic(docs, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component; documents without words stay."""
    _small_batches(spark)
    return ngram_join.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked; ``n_chars`` is that of the text as it is then."""
    _small_batches(spark)
    masked = secrets.redact(docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it starts, its ids' checksum, and its place in a sequence."""
    _small_batches(spark)
    pieces = packing.pack(docs.select("doc_id", "text"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("n-gram join", one_of_each_group), ("decontamination", drop_contaminated),
          ("secret scans", mask_secrets), ("packing", pack)]
#: SQL can express neither the fitted scorer nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
