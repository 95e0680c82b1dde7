"""Dataset label policies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.constants import LABEL_POLICY, SUBSTRING_POLICY, UNMATCHED


def label_policy_table(spark: SparkSession) -> DataFrame:
    """The exact policy as a table of (dataset, label_key, mapped)."""
    rows = [(d, k, v) for d, m in LABEL_POLICY.items() for k, v in m.items()]
    return spark.createDataFrame(rows, "dataset string, label_key string, mapped string")


def map_labels(df: DataFrame, label: str, dataset: str, out: str = "threat_class") -> DataFrame:
    """Exact label mapping by a join with the (fixed, tiny) policy table."""
    policy = F.broadcast(label_policy_table(df.sparkSession)).withColumnsRenamed(
        {"dataset": "_policy_dataset", "label_key": "_policy_key", "mapped": "_policy_class"})
    joined = df.join(
        policy,
        (F.lower(F.trim(F.col(label))) == F.col("_policy_key")) & (F.col(dataset) == F.col("_policy_dataset")),
        "left",
    )
    return joined.withColumn(out, F.coalesce("_policy_class", F.lit(UNMATCHED))).drop(
        "_policy_dataset", "_policy_key", "_policy_class")


def exact_label(label: Column, dataset: str) -> Column:
    """The exact policy for one dataset as a literal map lookup."""
    policy = LABEL_POLICY.get(dataset, {})
    pairs = [F.lit(x) for kv in policy.items() for x in kv]
    key = F.lower(F.trim(label))
    found = F.element_at(F.create_map(*pairs), key) if pairs else F.lit(None).cast("string")
    return F.coalesce(found, F.lit(UNMATCHED))


def substring_label(label: Column) -> Column:
    """First class whose fragments occur in the label; NULL when none does.

    "_" and "-" are turned into blanks first, so fragments holding them never match.
    """
    text = F.translate(F.lower(F.trim(label)), "_-", "  ")
    result = None
    for cls, fragments in SUBSTRING_POLICY:
        hit = reduce(lambda a, b: a | b, [text.contains(f) for f in fragments])
        result = F.when(hit, cls) if result is None else result.when(hit, cls)
    return result
