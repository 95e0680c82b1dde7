"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket, the bucket where a source's budget ends is refined until one hash
value is left, and rows are taken by comparing their hash with the threshold. Thresholds are nested: a larger
budget takes a superset. Nothing is sorted; only aggregates of at most 4096 rows a source meet in a window.

Defined results: a null text has size 0; a null source is a source of its own, ordered last. Rows with equal
doc_id and text share a hash and are taken together. Size-0 rows are taken 0 words. An empty table gives no row.
One row per source is ranked in one task; that list is metadata and has no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.common import text_or_empty, word_count
from flowsift.operators.staging import staged

BITS = 12
LEVELS = 5
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def row_hash() -> Column:
    """60 bits of the md5 of doc_id and text."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text_or_empty())
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 15), 16, 10).cast("bigint")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        word_count(text_or_empty()).alias("size"), row_hash().alias("h"))


def targets(by_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target: weighted shares of the whole, none above ``most`` times its source.

    Sources in order of size per weight reach their ceiling first; the rest share what is left by weight.
    """
    everything = Window.partitionBy(F.lit(0))
    ordered = everything.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(ordered) - 1) % len(weights) + 1)
    rated = by_source.withColumn("w", weight).withColumn("rn", F.row_number().over(ordered)).withColumn(
        "ceiling", most * F.col("source_size"))
    by_ratio = everything.orderBy(F.col("source_size").cast("double") / F.col("w"), "rn")
    told = rated.withColumns({
        "total": F.sum("source_size").over(everything),
        "held": F.coalesce(F.sum("ceiling").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "open_w": F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))})
    capped = told.withColumn(
        "capped", F.col("ceiling").cast("double") * F.col("open_w")
        < F.col("w").cast("double") * (F.col("total") - F.col("held")))
    shared = capped.withColumns({
        "left": F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("ceiling"))).over(everything), F.lit(0)),
        "free_w": F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)})
    target = F.when(F.col("capped"), F.col("ceiling").cast("double")).otherwise(
        F.col("w").cast("double") * F.col("left").cast("double") / F.col("free_w").cast("double"))
    return shared.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with repeats (whole passes over the source) and upto: rows with h < upto are taken once more."""
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = goals.withColumn("repeats", repeats.cast("bigint"))
    plan = staged(plan.withColumn("budget", F.col("target") - F.col("repeats") * F.col("source_size")))
    bound = staged(plan.select(
        F.col("source").alias("src"), "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below")))
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = rows.join(bound, rows["source"].eqNullSafe(bound["src"])).filter(
            F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = inside.groupBy("src", "budget", "prefix", "below", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("n"))
        run = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        ends = hist.withColumn("upto", F.col("below") + F.sum("n").over(run)).filter(F.col("upto") > F.col("budget"))
        # The first bucket whose end passes the budget; what lies before it is inside the budget.
        cut = F.min(F.struct("bucket", "upto", "n", "budget"))
        bound = staged(ends.groupBy("src").agg(cut.alias("c")).select(
            "src", F.col("c.budget").alias("budget"), F.col("c.bucket").alias("prefix"),
            (F.col("c.upto") - F.col("c.n")).alias("below"), F.col("c.n").alias("n")))
    # One hash value is left: take it too if that ends nearer to the budget.
    nearer = F.col("below") + F.col("n") - F.col("budget") < F.col("budget") - F.col("below")
    edge = bound.select("src", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("upto"))
    joined = plan.join(edge, plan["source"].eqNullSafe(edge["src"]), "left")
    return joined.select(
        F.col("source").alias("src"), "source_size", "target", "repeats", F.coalesce("upto", F.lit(0)).alias("upto"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows = staged(sized(docs))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    cut = staged(thresholds(rows, goals))
    met = rows.join(cut, rows["source"].eqNullSafe(cut["src"]))
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def copies() -> Column:
    return F.col("repeats") + F.when(F.col("h") < F.col("upto"), 1).otherwise(0)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows the mix takes, each as often as it is taken, all columns of docs."""
    rows = staged(sized(docs).select("source", "size", "h"))
    goals = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    cut = staged(thresholds(rows, goals))
    # The row travels as one struct, so that its column names meet no others.
    hashed = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), row_hash().alias("h"))
    met = hashed.join(cut, hashed["source"].eqNullSafe(cut["src"]))
    return met.select("row", F.explode(F.array_repeat(F.lit(1), copies().cast("int")))).select("row.*")
