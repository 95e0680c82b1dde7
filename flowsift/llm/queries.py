"""One query per operator, with production parameters over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.llm import (
    co_training, decontamination, digest_index, html_content, kd_shards, language_id, lexical_search, merkle_manifest, mixing, near_copies,
    packing, secret_scan, vector_search)
from flowsift.sources.tables import table


def op1_html_content(spark: SparkSession, folder: str) -> DataFrame:
    return html_content.extract_pages(table(spark, folder, "pages"))


def op2_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return kd_shards.shard_documents(table(spark, folder, "documents"), shards=24)


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.scan(table(spark, folder, "documents"))


def op4_near_copies(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies.classes(table(spark, folder, "documents"), near_copies.Settings(words=2))


def op5_co_training(spark: SparkSession, folder: str) -> DataFrame:
    return co_training.co_trained_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=2048)


def op7_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    index = digest_index.DigestIndex(spark)
    return digest_index.mark_copies(table(spark, folder, "documents"), index).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_id.predict(docs, language_id.fit(docs, public_tokenizers.path("piece_bpe_32k.model")))


def op10_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, vector_search.Settings(k=20))


def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), lexical_search.Settings(k=10))


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, folder, "documents"))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_content": op1_html_content,
    "op2_kd_shards": op2_kd_shards,
    "op3_secret_scan": op3_secret_scan,
    "op4_near_copies": op4_near_copies,
    "op5_co_training": op5_co_training,
    "op6_packing": op6_packing,
    "op7_source_mixing": op7_source_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_vector_search": op10_vector_search,
    "op11_lexical_search": op11_lexical_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_decontamination": op13_decontamination,
}
