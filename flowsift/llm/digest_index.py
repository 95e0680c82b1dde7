"""Exact duplicates by a persistent digest index.

The index is a table of distinct digests, bucketed and sorted by digest. New data is reduced to its distinct
digests, matched with the index by a sort-merge anti-join and appended; the digests that the index had are found by an
inner join. Both joins read the index bucket by bucket without shuffling it, so only digests of the new data and their
hits travel, whatever the size of the index.

Defined results: a null text counts as the empty text. A null doc_id is larger than all others. Rows with equal
text and equal doc_id are copies too; one of them stays. An empty table gives an empty result. Only the columns
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.llm.common import SPACES, text_or_empty
from flowsift.operators.staging import delete_at_exit, shared_folder, staged


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with each run of white space as one blank, 32 bytes."""
    return F.unhex(F.sha2(F.encode(F.regexp_replace(text, SPACES, " "), "UTF-8"), 256))


class DigestIndex:
    """Distinct digests seen so far, each with the smallest doc_id and count of the batch that brought it.

    ``location`` is a folder all executors reach; an index that lies there already is attached again. Without one the
    index lasts until the application ends. A failed
    append leaves the table as it was, and appending a batch twice adds nothing, so a batch can be rerun.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int = 64):
        self.spark = spark
        self.location = location or f"{shared_folder(spark)}/digest-index-{uuid.uuid4().hex}"
        self.temporary = location is None
        self.buckets = buckets
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'")

    def rows(self) -> DataFrame:
        """The index as a bucketed table."""
        return self.spark.table(self.name)

    def hits(self, groups: DataFrame) -> DataFrame:
        """The rows of the index whose digest the groups have."""
        return self.rows().join(groups.select("digest"), "digest")

    def append_new(self, groups: DataFrame) -> DataFrame:
        """Append the groups whose digest the index lacks; returns them."""
        fresh = staged(groups.join(self.rows().select("digest"), "digest", "left_anti"))
        (fresh.repartition(self.buckets, "digest").write.mode("append").format("parquet")
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name, path=self.location))
        self.spark.catalog.refreshTable(self.name)
        if self.temporary:
            delete_at_exit(self.spark, self.location)
        return fresh


def digests(docs: DataFrame) -> DataFrame:
    """(row_no, doc_id, digest) of every row, written once; row_no tells repeated rows apart."""
    return staged(docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("bigint").alias("doc_id"),
        text_digest(text_or_empty()).alias("digest")))


def digest_groups(rows: DataFrame) -> DataFrame:
    """One row per digest, combined before the shuffle, so a hot digest costs one row per task."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no"))
    return rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row_no").alias("keep_row"), "group_size")


def mark_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """Every row of docs with keep_id, group_size, kept and text_sha256, after adding docs to the index.

    ``kept`` is true for the row of each new digest that stays; texts the index had before keep no row.
    """
    rows = digests(docs)
    groups = staged(digest_groups(rows))
    # Written before the append, so that they are the earlier batches' rows.
    hits = staged(index.hits(groups))
    known = hits.withColumn("fresh", F.lit(False)).unionByName(index.append_new(groups).withColumn("fresh", F.lit(True)))
    matched = rows.join(known, "digest")
    return matched.select(
        "row_no", "doc_id", "keep_id", "group_size", (F.col("fresh") & (F.col("row_no") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of docs that stay, all columns. Texts are shuffled once, not stored again."""
    rows = digests(docs)
    stay = index.append_new(digest_groups(rows)).select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep_id"))
    # The row travels as one struct, so that its column names meet no others.
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), text_digest(text_or_empty()).alias("digest"))
    kept = own.join(stay, (own["digest"] == F.col("_digest")) & own["doc_id"].eqNullSafe(F.col("_keep_id")), "left_semi")
    if not rows.groupBy("digest", "doc_id").count().filter("count > 1").isEmpty():
        kept = kept.dropDuplicates(["digest"])  # rows equal in text and doc_id: one stays
    return kept.select("row.*")
