"""Flow-record source with validation and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowsift.constants import THREAT_CLASSES
from flowsift.schemas import FLOW_RECORD_DDL

REQUIRED = ["flow_id", "timestamp", "src_port", "dst_port", "protocol", "packet_size_stats",
            "inter_arrival_stats", "entropy", "byte_ratio", "ttl"]
NON_NEGATIVE = ["outbound_bytes", "inbound_bytes", "pkt_rate", "byte_rate", "syn_count", "syn_fraction",
                "target_pkt_rate", "target_syn_fraction", "src_ip_entropy", "dns_query_len"]
AT_MOST_ONE = ["syn_fraction", "target_syn_fraction"]
FINITE = ["pkt_rate", "byte_rate", "syn_fraction", "target_pkt_rate", "target_syn_fraction", "src_ip_entropy",
          "dns_query_len"]
DEFAULT_ZERO = {"pkt_rate": 0.0, "byte_rate": 0.0, "syn_count": 0, "syn_fraction": 0.0, "src_ip_entropy": 0.0}


def read_flow_lines(spark: SparkSession, path) -> DataFrame:
    """Flow records, one JSON object per line, with their violations; see split_valid."""
    return parse_flows(spark.read.text(path))


def stream_flow_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    return parse_flows(spark.readStream.options(**options).format("text").load(path))


def parse_flows(lines: DataFrame, text: str = "value") -> DataFrame:
    schema = T.StructType.fromDDL(FLOW_RECORD_DDL + ", _corrupt_record string")
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.filter(F.trim(F.col(text)) != "").select(F.col(text).alias("raw"), parsed.alias("f")).select(
        "raw", "f.*")
    return with_violations(rows).fillna(DEFAULT_ZERO)


def flow_violations(has_corrupt: bool = True) -> Column:
    """array<string> naming every rule a flow record breaks."""
    checks = [F.when(F.col("_corrupt_record").isNotNull(), F.lit("malformed"))] if has_corrupt else []
    checks += [F.when(F.col(c).isNull(), F.lit(f"{c}: required")) for c in REQUIRED]
    checks += [F.when(F.col(c) < 0, F.lit(f"{c}: below 0")) for c in NON_NEGATIVE]
    checks += [F.when(F.col(c) > 1, F.lit(f"{c}: above 1")) for c in AT_MOST_ONE]
    checks += [F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), F.lit(f"{c}: not finite")) for c in FINITE]
    return F.array_compact(F.array(*checks))


def with_violations(rows: DataFrame) -> DataFrame:
    return rows.withColumn("violations", flow_violations("_corrupt_record" in rows.columns))


def split_valid(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid flows, rejected rows with reasons). Nothing is lost and nothing fails the job."""
    extra = [c for c in ("violations", "_corrupt_record", "raw") if c in rows.columns]
    good = rows.filter(F.size("violations") == 0).drop(*extra)
    bad = rows.filter(F.size("violations") > 0)
    return good, bad.select(*[c for c in ("raw", "flow_id") if c in bad.columns], "violations")


QUARANTINE_COUNTS = "batch bigint, valid bigint, rejected bigint"


def quarantine_stream(rows: DataFrame, folder: str, **trigger) -> StreamingQuery:
    """Split a stream of parsed flow records into the tables flows and rejected, with their numbers in counters.

    Each micro-batch overwrites its own partition of the three tables, so one that runs again after a failure
    leaves one copy of its rows; the numbers are those of the rows written.
    """
    spark = rows.sparkSession

    def split(batch: DataFrame, batch_id: int) -> None:
        kinds = dict(zip(("flows", "rejected"), split_valid(batch)))
        counts = []
        for name, part in kinds.items():
            part.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")
            counts.append(spark.read.schema(part.schema).parquet(f"{folder}/{name}/batch={batch_id}").count())
        spark.createDataFrame([(batch_id, *counts)], QUARANTINE_COUNTS).drop("batch").coalesce(1).write.mode("overwrite").parquet(
            f"{folder}/counters/batch={batch_id}")

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", f"{folder}/_checkpoint").trigger(
        **(trigger or {"availableNow": True})).start()


def alert_violations() -> Column:
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c}: required")) for c in
              ("timestamp", "flow_id", "threat_class", "confidence_score", "evidence")]
    checks.append(F.when(~F.col("threat_class").isin(*THREAT_CLASSES), F.lit("threat_class: unknown")))
    return F.array_compact(F.array(*checks))


def labelled_violations() -> Column:
    """Labelled training rows need a capture group and a provenance."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c}: required")) for c in ("group", "provenance")]))


def read_labelled_lines(spark: SparkSession, path) -> DataFrame:
    """Labelled partition rows {label, flow, group, provenance, source_sha256}."""
    schema = f"label string, flow struct<{FLOW_RECORD_DDL}>, `group` string, provenance string, source_sha256 string"
    rows = spark.read.schema(T.StructType.fromDDL(schema)).json(path)
    return rows.withColumn("violations", labelled_violations()).select(
        "label", "flow.*", "group", "provenance", "source_sha256", "violations").fillna(DEFAULT_ZERO)
