"""Column layouts shared by the sources, operators and streams."""

from pyspark.sql import types as T

STATS4 = "struct<min:double,max:double,mean:double,std:double>"
STATS2 = "struct<mean:double,std:double>"

PACKET_DDL = (
    "capture_id string, frame_no bigint, ts_us bigint, src_ip string, src_port int, "
    "dst_ip string, dst_port int, protocol string, frame_len int, ttl int, payload_hex string, "
    "dns_names array<string>, dns_type string, is_syn boolean, ja4 string"
)

FLOW_RECORD_DDL = (
    "flow_id string, timestamp timestamp, src_port int, dst_port int, protocol string, "
    f"packet_size_stats {STATS4}, inter_arrival_stats {STATS2}, entropy double, byte_ratio double, "
    f"ttl int, ja4 string, beacon_interval_stats {STATS2}, dns_ngram_entropy double, "
    "fanout_count bigint, outbound_bytes bigint, inbound_bytes bigint, pkt_rate double, "
    "byte_rate double, syn_count bigint, syn_fraction double, target_pkt_rate double, "
    "target_syn_fraction double, src_ip_entropy double, dns_query_len double, dns_record_type string"
)

LAYER_SCORE_DDL = (
    "flow_id string, layer_name string, raw_score double, calibrated_probability double, "
    "threat_class_guess string, evidence array<string>"
)

ALERT_DDL = (
    "timestamp timestamp, flow_id string, threat_class string, confidence_score double, "
    "evidence array<string>"
)

CHAIN_DDL = (
    "chain_id string, position bigint, seq bigint, timestamp string, flow_id string, "
    "threat_class string, confidence_score string, evidence array<string>, prev_hash string, hash string"
)


def struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl) if not ddl.startswith("struct<") else T.StructType.fromDDL(ddl)
