"""Sinks for flows, observations, alerts and reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_json_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per row, written by all tasks in parallel."""
    rows.write.mode(mode).json(path)


def write_table(rows: DataFrame, path: str, partition_by=(), mode: str = "errorifexists") -> None:
    rows.write.mode(mode).partitionBy(*partition_by).parquet(path)


def append_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").json(path)


def stream_alerts(alerts: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """File sink of a stream; the checkpoint makes each alert appear exactly once."""
    return alerts.writeStream.format("json").option("path", path).option(
        "checkpointLocation", checkpoint).options(**options).outputMode("append").start()


def write_report(report: dict, spark, path: str) -> None:
    """A small evaluation report as one JSON line."""
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.text(path)
