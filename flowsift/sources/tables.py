"""Packets derived from the event table: each event is one packet, some with a reply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def epoch_us(ts) -> "F.Column":
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    origin = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return F.timestamp_diff("MICROSECOND", origin, ts)


def packets_from_events(events: DataFrame) -> DataFrame:
    c = F.col
    k = F.get_json_object("props", "$.k").cast("int")
    port = (
        F.when(c("event_type") == "click", 443).when(c("event_type") == "view", 80)
        .when(c("event_type") == "error", 53).when(c("event_type") == "signup", 8443).otherwise(4444))
    user = c("user_id")
    base = events.select("event_id", "user_id", "event_type", "value", k.alias("k"), epoch_us(c("ts")).alias("ts_us"))
    sent = base.select(
        F.pmod(F.pmod(user, F.lit(16)), F.lit(4)).cast("string").alias("capture_id"),
        c("event_id").alias("frame_no"), "ts_us",
        F.concat(F.lit("10.0.0."), (F.pmod(user, F.lit(16)) + 1).cast("string")).alias("src_ip"),
        (F.pmod(user, F.lit(32)) + 40000).cast("int").alias("src_port"),
        F.concat(F.lit("192.0.2."), (F.pmod(c("k"), F.lit(8)) + 1).cast("string")).alias("dst_ip"),
        port.alias("dst_port"),
        F.when(c("event_type") == "error", "UDP").otherwise("TCP").alias("protocol"),
        (F.floor(c("value") * 10) + 40).cast("int").alias("frame_len"),
        F.element_at(F.array(F.lit(64), F.lit(128), F.lit(255)), F.pmod(c("k"), F.lit(3)) + 1).alias("ttl"),
        F.concat(F.md5(c("event_id").cast("string")), F.md5(user.cast("string")), F.md5(c("k").cast("string")))
        .alias("payload_hex"),
        F.when(c("event_type") == "error", F.array(F.concat(
            F.when(c("k") >= 50, F.md5(c("event_id").cast("string"))).otherwise(F.concat(F.lit("www"), c("k").cast("string"))),
            F.lit(".example.test")))).otherwise(F.array().cast("array<string>")).alias("dns_names"),
        F.when(c("event_type") == "error", F.element_at(
            F.array(*[F.lit(t) for t in ("A", "AAAA", "TXT", "MX")]), F.pmod(c("k"), F.lit(4)) + 1)).alias("dns_type"),
        (c("event_type") == "signup").alias("is_syn"),
        F.when((c("event_type") == "click") & (F.pmod(c("k"), F.lit(3)) == 0), F.element_at(F.array(*[F.lit(t) for t in (
            "t13i050200_e133e205ac38_000000000000", "t13i1516h2_8daaf6152771_b186095e22b6",
            "t13d151600_8daaf6152771_b186095e22b6", "t13d1516h2_8daaf6152771_b186095e22b6")]),
            F.pmod(c("k"), F.lit(4)) + 1)).alias("ja4"),
        c("k"),
    )
    none = F.lit(None)
    # One pass over the table: each event gives its packet and, for k % 5 = 0, a reply.
    both = sent.withColumn("reply", F.explode(
        F.when(F.pmod("k", F.lit(5)) == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))

    def pick(reply, own):
        return F.when(c("reply"), reply).otherwise(own)

    return both.select(
        "capture_id",
        pick(c("frame_no") + 1_000_000_000, c("frame_no")).alias("frame_no"),
        pick(c("ts_us") + 10, c("ts_us")).alias("ts_us"),
        pick(c("dst_ip"), c("src_ip")).alias("src_ip"),
        pick(c("dst_port"), c("src_port")).alias("src_port"),
        pick(c("src_ip"), c("dst_ip")).alias("dst_ip"),
        pick(c("src_port"), c("dst_port")).alias("dst_port"),
        "protocol",
        pick(F.lit(60), c("frame_len")).alias("frame_len"),
        "ttl",
        pick(F.lit(""), c("payload_hex")).alias("payload_hex"),
        pick(F.array().cast("array<string>"), c("dns_names")).alias("dns_names"),
        pick(none.cast("string"), c("dns_type")).alias("dns_type"),
        pick(F.lit(False), c("is_syn")).alias("is_syn"),
        pick(none.cast("string"), c("ja4")).alias("ja4"),
    )
