"""Detection quality from a table of (truth, predicted)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.constants import ALL_CLASSES, BENIGN
from flowsift.operators.ordered import rank_rows


def confusion(df: DataFrame, truth: str = "truth", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, classes: Sequence[str] = tuple(ALL_CLASSES), truth="truth", predicted="predicted") -> DataFrame:
    """One row per true class, one column per predicted class; pivot values are fixed, so no extra pass."""
    spread = df.groupBy(truth).pivot(predicted, list(classes)).agg(F.count(F.lit(1)))
    return spread.na.fill(0, list(classes))


def class_dimension(spark, classes: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(c, i) for i, c in enumerate(classes)], "class string, class_no int")


def class_metrics(df: DataFrame, classes: Sequence[str] = tuple(ALL_CLASSES), truth="truth", predicted="predicted") -> DataFrame:
    """Precision, recall, F1 and support per class, 0 where a denominator is empty.

    The table is first reduced to its confusion counts, so everything after is at most
    |classes|^2 rows.
    """
    counts = confusion(df, truth, predicted)
    sides = counts.select(F.explode(F.array(
        F.struct(F.col(truth).alias("class"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("p")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("p")),
    )).alias("s"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit"))
    summed = sides.groupBy(F.col("s.class").alias("class")).agg(
        F.sum("s.t").alias("support"), F.sum("s.p").alias("claimed"), F.sum("hit").alias("hits2"))
    dim = class_dimension(df.sparkSession, classes)
    joined = F.broadcast(dim).join(summed, "class", "left").na.fill(0, ["support", "claimed", "hits2"])
    tp = (F.col("hits2") / 2).cast("bigint")

    def share(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)

    rated = joined.withColumns({
        "tp": tp, "precision": share(tp, F.col("claimed")), "recall": share(tp, F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return rated.withColumn(
        "f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0),
    ).select("class", "precision", "recall", "f1", "support")


def macro_metrics(df: DataFrame, classes: Sequence[str] = tuple(ALL_CLASSES), truth="truth", predicted="predicted") -> DataFrame:
    """Averages over classes with support, plus accuracy: one row."""
    per_class = class_metrics(df, classes, truth, predicted).filter("support > 0").agg(
        F.coalesce(F.avg("precision"), F.lit(0.0)).alias("macro_precision"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_recall"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"), F.lit(1).alias("_one"))
    overall = df.agg(
        F.coalesce(F.avg((F.col(truth) == F.col(predicted)).cast("double")), F.lit(0.0)).alias("accuracy"),
        F.count(F.lit(1)).alias("n"), F.lit(1).alias("_one"))
    return per_class.join(overall, "_one").drop("_one")


def benign_false_positives(df: DataFrame, truth="truth", predicted="predicted") -> DataFrame:
    benign = F.col(truth) == BENIGN
    return df.agg(F.try_divide(
        F.count_if(benign & (F.col(predicted) != BENIGN)), F.count_if(benign)).alias("benign_false_positive_rate"))


def brier(df: DataFrame, correct: Column, confidence: Column) -> DataFrame:
    """Mean squared gap between stated confidence and whether the class was right."""
    return df.agg(F.avg(F.pow(correct.cast("double") - confidence, 2)).alias("brier"))


def unvalidated_classes(df: DataFrame, classes: Sequence[str] = tuple(ALL_CLASSES), truth="truth") -> DataFrame:
    """Threat classes no row of the table carries as its truth."""
    dim = class_dimension(df.sparkSession, [c for c in classes if c != BENIGN]).select("class")
    return dim.join(df.select(F.col(truth).alias("class")).distinct(), "class", "left_anti")


def distinct_ratio(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of distinct rows among the given columns; below half suggests memorisation."""
    distinct = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
    return distinct.agg(
        F.count(F.lit(1)).alias("distinct_rows"), F.sum("n").alias("all_rows"),
        (F.count(F.lit(1)) / F.sum("n")).alias("ratio"))


def scenario_report(df: DataFrame, scenario: str = "scenario", predicted: str = "predicted") -> DataFrame:
    """Per scenario and predicted class: count, and the share predicted as the scenario's own label."""
    counts = df.groupBy(scenario, predicted).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(scenario).agg(
        F.sum("n").alias("flows"),
        F.sum(F.when(F.col(scenario) == F.col(predicted), F.col("n")).otherwise(0)).alias("expected"))
    return counts.join(totals, scenario).select(
        scenario, predicted, "n", (F.col("expected") / F.col("flows")).alias("expected_label_fraction"))


def partition_leaks(rows: DataFrame, partition: str = "partition") -> DataFrame:
    """Capture groups and source hashes that occur in more than one partition."""
    marks = rows.select(partition, F.explode(F.array(
        F.struct(F.lit("group").alias("kind"), F.col("group").alias("value")),
        F.struct(F.lit("source_sha256").alias("kind"), F.col("source_sha256").alias("value")))).alias("m")
    ).filter(F.coalesce("m.value", F.lit("")) != "")
    return marks.groupBy(F.col("m.kind").alias("kind"), F.col("m.value").alias("value")).agg(
        F.count_distinct(partition).alias("partitions")).filter("partitions > 1")


def check_partitions(rows: DataFrame, partition: str = "partition") -> None:
    leak = partition_leaks(rows, partition).limit(1).collect()
    if leak:
        raise ValueError(f"partitions share {leak[0]['kind']} {leak[0]['value']!r}")


def label_counts(rows: DataFrame, label: str = "label", partition: str | None = None) -> DataFrame:
    keys = [partition, label] if partition else [label]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def stratified_folds(rows: DataFrame, label: str, order: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Fold number by position within the label, so every fold holds each label's share."""
    return rank_rows(rows, [label], order, "_nth").withColumn(
        out, F.pmod(F.col("_nth") - 1, F.lit(k)).cast("int")).drop("_nth")


def fold_summary(scores: DataFrame, key: str = "class", value: str = "f1") -> DataFrame:
    """Mean, population deviation, lowest and highest value over folds."""
    return scores.groupBy(key).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
