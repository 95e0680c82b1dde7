"""From documents to training sequences: language ID, exact dedup, near dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps with the columns of documents; the last
returns pieces of sequences. A stage's result is written as Parquet and read again as the next stage's docs, so a
lost executor costs at most one stage. Tables that a stage wrote for itself in the shared folder are removed when
the next stage starts: by then the stage's result has been written.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowsift.llm import digest_index, language_id, mixing, near_copies, packing
from flowsift.operators import staging
from flowsift.packaging import ship

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
_stage_tables: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        staging.remove(spark, _stage_tables)
        _stage_tables.clear()
        with staging.recorded(_stage_tables):
            return work(spark, docs)

    return run_stage


def identify_language(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Documents without a letter, or without a language that is more likely than all others, go."""
    return language_id.accepted(docs, language_id.fit(docs, PIECES))


def drop_exact_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return digest_index.drop_copies(docs, digest_index.DigestIndex(spark))


def drop_near_copies(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each class stays; shingles of two words, as in the operator's query."""
    return near_copies.drop_near_copies(docs, near_copies.Settings(words=2))


def mix_sources(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return packing.pack(docs, TOKENIZER)


STAGES = [
    ("language_id", _stage(identify_language)),
    ("exact_dedup", _stage(drop_exact_copies)),
    ("near_dedup", _stage(drop_near_copies)),
    ("source_mixing", _stage(mix_sources)),
    ("packing", _stage(pack_sequences)),
]

#: Language identification and near duplicates have no SQL; a test holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{staging.shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    written = None
    for name, stage in STAGES[:-1]:
        kept = stage(spark, docs, sf_dir)
        path = f"{folder}/{name}"
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if written:
            staging.remove(spark, [written])
        written = path
    staging.delete_at_exit(spark, folder)
    return STAGES[-1][1](spark, docs, sf_dir)
