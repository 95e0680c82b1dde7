"""Latency and throughput figures of a timings table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.operators.ordered import running_sum, value_chunks
from flowsift.operators.staging import staged


def picked_percentiles(timings: DataFrame, value: str, fractions: Sequence[float], rounding: str = "nearest") -> DataFrame:
    """Value at index round(p*(n-1)) ("nearest") or int(p*(n-1)) ("floor"), per fraction p."""
    counted = staged(timings.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("upto")))
    n = counted.agg(F.sum("upto")).first()[0] or 0
    pick = round if rounding == "nearest" else int
    wanted = F.array(*[
        F.struct(F.lit(float(p)).alias("fraction"), F.lit(min(pick(p * (n - 1)), n - 1)).cast("bigint").alias("i"))
        for p in fractions])
    ranked = running_sum(counted.withColumn("n", F.col("upto")), [], "v", ["upto"], value_chunks(counted, "v"))
    return ranked.select("v", F.explode(F.filter(
        wanted, lambda w: (w["i"] >= F.col("upto") - F.col("n")) & (w["i"] < F.col("upto")))).alias("w")).select(
        F.col("w.fraction").alias("fraction"), F.col("v").alias("value"))


def throughput_report(passes: DataFrame, flows: str = "flows", seconds: str = "seconds", window_s: float = 0.12) -> DataFrame:
    """Mean and sample deviation of flows/s over passes, and flows per capture window."""
    rate = F.col(flows) / F.col(seconds)
    return passes.filter(F.col(seconds) > 0).agg(
        F.coalesce(F.avg(rate), F.lit(0.0)).alias("throughput"),
        F.coalesce(F.stddev_samp(rate), F.lit(0.0)).alias("throughput_std"),
        (F.coalesce(F.avg(rate), F.lit(0.0)) * window_s).alias("flows_per_window"))


def latency_report(timings: DataFrame, latency_ms: str, window_ms: float = 120.0) -> DataFrame:
    """One row: p50_ms, p95_ms, p99_ms, and the share of a window that p95 leaves free; all null without timings."""
    found = picked_percentiles(timings, latency_ms, [0.5, 0.95, 0.99])
    at = lambda p: F.max(F.when(F.col("fraction") == p, F.col("value")))
    return found.agg(at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"), at(0.99).alias("p99_ms")).withColumn(
        "headroom", F.when(F.col("p95_ms").isNotNull(), F.greatest(F.lit(0.0), 1 - F.col("p95_ms") / window_ms)))


def window_headroom(p95_ms: float, window_ms: float = 120.0) -> float:
    return max(0.0, 1.0 - p95_ms / window_ms)
