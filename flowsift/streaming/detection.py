"""Live packets to flows, alerts and counters, with the batch functions per micro-batch."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowsift.constants import BEACON_LOOKBACK_US, HORIZON_US, WINDOW_US
from flowsift.functions.net import int_div
from flowsift.operators import flows as fl
from flowsift.operators.dashboard import run_counters
from flowsift.operators.fusion import gate
from flowsift.streaming.windows import stream_closed_windows

SIGHTING_DDL = (
    "capture_id string, bucket bigint, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, "
    "first_frame bigint, first_ts_us bigint, hello_ja4 string, slot bigint, batch bigint")
COUNTERS_DDL = (
    "windows_processed bigint, flows_scored bigint, alerts_emitted bigint, alerts_suppressed bigint, "
    "packets_read bigint, late_packets bigint, packets_dropped bigint, batch bigint")


def recent_history(spark, folder: str, batch_id: int, reach_us: int, earliest_us: int) -> DataFrame:
    """Sightings of earlier batches within reach; the time slot is a partition, so old files are skipped."""
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        rows = spark.createDataFrame([], SIGHTING_DDL)
    else:
        rows = spark.read.schema(SIGHTING_DDL).parquet(folder)
    since = earliest_us - reach_us
    return rows.filter((F.col("slot") >= since // reach_us) & (F.col("batch") < batch_id) & (F.col("first_ts_us") >= since)).drop(
        "slot", "batch")


def stream_flows(
    packets: DataFrame, folder: str, *,
    window_us: int = WINDOW_US, horizon_us: int = HORIZON_US, beacon_lookback_us: int = BEACON_LOOKBACK_US,
    protected=(), lateness: str = "0 seconds", clock: str = "stream",
    detect: Callable[[DataFrame], DataFrame] | None = None, **trigger,
) -> StreamingQuery:
    """Start the live job. Below ``folder``: flows, alerts, counters, sightings, state, checkpoint.

    A window is complete when its ``clock`` has passed it (see ``stream_closed_windows``); its packets then go
    through the same flow assembly as a batch. Each batch has a row of counters; flows and alerts are null
    without ``detect``. What the cross-window features remember is a table of sightings,
    partitioned by time, so a dominant source is scanned in parallel chunks as in batch. Each
    micro-batch overwrites its own partitions: a repeated batch leaves one copy.
    """
    reach = max(horizon_us, beacon_lookback_us)

    def process(closed: DataFrame, batch_id: int, packet_counts: dict[str, int]) -> None:
        spark = closed.sparkSession
        work = f"{folder}/work/{batch_id}"
        count = itertools.count()

        def hold(df: DataFrame) -> DataFrame:
            """Write once, read by all branches; in particular the window state is read only once."""
            path = f"{work}/{next(count)}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        scored = dict.fromkeys(("windows_processed", "flows_scored", "alerts_emitted", "alerts_suppressed"), None if detect is None else 0)
        try:
            batch = closed
            earliest = batch.agg(F.min("ts_us")).first()[0]
            if earliest is None:
                _write(spark.createDataFrame([scored | packet_counts | {"batch": batch_id}], COUNTERS_DDL), f"{folder}/counters", ["batch"])
                return
            flows = hold(fl.build_flows(
                batch, window_us=window_us, horizon_us=horizon_us, beacon_lookback_us=beacon_lookback_us,
                protected=protected, stage=hold,
                history=recent_history(spark, f"{folder}/sightings", batch_id, reach, earliest)))
            _write(flows.withColumn("batch", F.lit(batch_id)), f"{folder}/flows", ["batch"])
            totals = fl.packet_totals(fl.in_windows(batch, window_us))
            seen = fl.sightings(fl.with_reverse(totals))
            _write(seen.withColumns({"slot": int_div(F.col("first_ts_us"), reach), "batch": F.lit(batch_id)}),
                   f"{folder}/sightings", ["slot", "batch"])
            if detect is not None:
                fused = hold(detect(flows))
                alerts = gate(fused).select(
                    "capture_id", "ts_us", "flow_id", "threat_class", "confidence_score", "evidence")
                _write(alerts.withColumn("batch", F.lit(batch_id)), f"{folder}/alerts", ["batch"])
                scored = run_counters(fused).first().asDict()
            _write(spark.createDataFrame([scored | packet_counts | {"batch": batch_id}], COUNTERS_DDL), f"{folder}/counters", ["batch"])
        finally:
            path = spark._jvm.org.apache.hadoop.fs.Path(work)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    query = stream_closed_windows(packets, folder, process, window_us=window_us, lateness=lateness, clock=clock, **trigger)
    query.counters = f"{folder}/counters"
    return query


def _write(rows: DataFrame, path: str, partitions: list[str]) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def late_packets(query: StreamingQuery) -> int:
    """Packets dropped for being late, over all batches of a query of ``stream_flows``; all are in its counters table."""
    rows = SparkSession.active().read.schema(COUNTERS_DDL).parquet(query.counters)
    return rows.agg(F.coalesce(F.sum("late_packets"), F.lit(0))).first()[0]


def stream_scores(flows: DataFrame, detect: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Score a stream of ready-made flow records and keep the alerts: projections only, no state."""
    fused = detect(flows).observe(
        "counters", F.count(F.lit(1)).alias("flows_scored"), F.count_if("is_actionable").alias("alerts_emitted"))
    alerts = gate(fused).select("timestamp", "flow_id", "threat_class", "confidence_score", "evidence")
    return alerts.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(**(trigger or {"availableNow": True})).start()
