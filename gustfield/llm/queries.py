"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, jaccard, language, media, ngram_scores, packing, secrets, substrings, toxicity, urls, whitening
from .columnar import Step, apply, crc32_mod, shared_dir, table
from .digests import digest
from .oracles import ORACLES  # noqa: F401  registered with the queries


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.digest_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op3_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    read = apply(docs, "text", media.storer(), Step(lambda _: [], {}, ("text",)), media.reader())
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents").select("doc_id", "text"), crc32_mod("doc_id", 3) == 1
    model = toxicity.fit(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.classify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    steps = bpe.encoder(), Step(lambda _: [], {}, ("text",)), bpe.decoder(raw=True), digest("decoded", "decoded_sha256", "sha256"), digest("ids", "ids_sha256", "sha256")
    return apply(docs, "text", *steps).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), crc32_mod("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out))
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "packed")
    packing.write_packed(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return packing.read_packed(spark, path, digest("ids", "ids_crc32", "crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), decontaminate.items_digest("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs, secrets.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.spelled("base"), 256).alias("base_sha256"), secrets.spelled("spans").alias("spans"), "n_random")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_scores.score(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    white = whitening.whiten(vectors, whitening.fit(vectors))
    at = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "w")
    return white.select("vec_id", "n", "deviation", "identity_error", at).select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", F.col("w.whitened").alias("whitened"), F.col("w.explained").alias("explained"), "identity_error")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup, "op2_jaccard_join": op2_jaccard_join, "op3_media_jpeg": op3_media_jpeg, "op4_toxicity": op4_toxicity, "op5_byte_bpe": op5_byte_bpe, "op6_language": op6_language, "op7_bit_packing": op7_bit_packing, "op8_decontamination": op8_decontamination, "op9_secrets": op9_secrets, "op10_lm_scores": op10_lm_scores, "op11_url_filters": op11_url_filters, "op12_whitening": op12_whitening, "op13_collocations": op13_collocations}
