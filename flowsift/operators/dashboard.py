"""Aggregates an alert dashboard shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.constants import THREAT_CLASSES
from flowsift.operators.evaluate import class_dimension
from flowsift.operators.state import KEPT, LATE, OVER_CAP, UNTIMED
from flowsift.sources.flow_json import flow_violations


def class_shares(alerts: DataFrame) -> DataFrame:
    """Alerts per class with share, zero for absent classes, ranked by count (class order on ties)."""
    counts = alerts.groupBy("threat_class").agg(F.count(F.lit(1)).alias("n"))
    dim = class_dimension(alerts.sparkSession, THREAT_CLASSES).withColumnRenamed("class", "threat_class")
    filled = F.broadcast(dim).join(counts, "threat_class", "left").na.fill(0, ["n"])
    total = filled.agg(F.sum("n").alias("total"), F.lit(1).alias("_one"))
    return filled.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select(
        "threat_class", "class_no", "n",
        F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0).alias("share"),
    ).orderBy(F.col("n").desc(), "class_no")


def timeline(alerts: DataFrame, ts: Column | None = None, *, buckets: int) -> DataFrame:
    """Alerts per minute, the latest ``buckets`` minutes that have any."""
    ts = ts if ts is not None else F.col("timestamp")
    return alerts.groupBy(F.date_trunc("minute", ts).alias("minute")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.col("minute").desc()).limit(buckets)


def latest_alerts(alerts: DataFrame, keep: int, order: str = "timestamp", tie: str = "flow_id") -> DataFrame:
    """The newest ``keep`` alerts (a top-k: each task keeps only its own newest)."""
    return alerts.orderBy(F.col(order).desc(), F.col(tie).desc()).limit(keep)


def alert_rate(alerts: DataFrame, seconds: Column) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("n"), seconds.alias("seconds")).select(
        "n", F.coalesce(F.try_divide("n", "seconds"), F.lit(0.0)).alias("alerts_per_second"))


def run_counters(fused: DataFrame, window: str = "bucket") -> DataFrame:
    """Windows, flows scored, alerts emitted and suppressed: one row."""
    return fused.agg(
        F.count_distinct("capture_id", window).alias("windows_processed"),
        F.count(F.lit(1)).alias("flows_scored"),
        F.count_if("is_actionable").alias("alerts_emitted"),
        F.count_if(~F.col("is_actionable")).alias("alerts_suppressed"))


def packet_counters(arrived: DataFrame, *keys: str) -> DataFrame:
    """Packets by fate (see flows.arrivals): one row, or one for each value of ``keys``."""
    n = lambda fate: F.count_if(F.col("fate") == fate)
    return arrived.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"), n(KEPT).alias("kept"), n(LATE).alias("late_packets"),
        n(OVER_CAP).alias("packets_dropped"), n(UNTIMED).alias("untimed_packets"))


def flow_counters(flows: DataFrame, *keys: str, window: str = "bucket") -> DataFrame:
    """Windows, flows, and flows that break a rule of the record schema: one row, or one for each value of ``keys``."""
    return flows.withColumn("_broken", F.size(flow_violations(False)) > 0).groupBy(*keys).agg(
        F.count_distinct("capture_id", window).alias("windows"), F.count(F.lit(1)).alias("flows"),
        F.count_if("_broken").alias("invalid_flows"))
