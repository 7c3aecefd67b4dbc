"""A corpus pipeline: language ID, one document of each near-duplicate group, benchmark decontamination, secret redaction, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; other columns are left out.

Null and empty texts, and texts without letters, go in the first stage. Rows without id stay like any other, and of rows with one
id all stay if one does; equal rows with an id are rows of one document. Texts of any length are taken whole. An empty table gives an empty one in each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gustfield.llm import bpe, decontaminate, jaccard, language, secrets
from gustfield.llm.columnar import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models recognise; what they reject (no letters, or unlike every language) goes.

    Whole texts pass through Python here and in later stages, so that Arrow batches of this session become smaller.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    model = language.fit(docs)
    return language.identify(docs, model).where("not rejected").select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that the Jaccard join links."""
    return jaccard.keep_one(docs).select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.removed(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets redacted; n_chars follows the text where it changed."""
    clean = secrets.redact(docs.withColumn("_was", F.col("text")), secrets.train(docs))
    return clean.withColumn("n_chars", F.when(F.col("text") == F.col("_was"), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document (little-endian unsigned 32-bit integers) and their number."""
    return bpe.encode(docs.select("doc_id", "text")).select("doc_id", "n_tokens", "ids")


STAGES = [("language", known_language), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("secrets", without_secrets), ("tokens", tokens)]

#: Language models, connected components and BPE are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
