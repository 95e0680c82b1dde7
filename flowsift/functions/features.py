"""Fixed-order model inputs of a flow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsift.functions.ja4 import is_malicious, lacks_alpn, lacks_sni

# Input names in vector order; the first 16 form version 1.
FEATURE_NAMES = [
    "inter_arrival_mean", "inter_arrival_std", "pkt_size_mean", "pkt_size_std", "pkt_size_min",
    "pkt_size_max", "entropy", "payload_frame_ratio", "ttl", "fanout_count", "dns_ngram_entropy",
    "has_beacon_interval", "has_ja4", "ja4_is_malicious", "ja4_no_sni", "ja4_no_alpn",
    "pkt_rate", "byte_rate", "syn_count", "syn_fraction", "src_ip_entropy", "outbound_observed",
    "outbound_bytes_log1p", "inbound_observed", "inbound_bytes_log1p", "dns_is_txt", "dns_query_len",
]
WIDTH = {1: 16, 2: 27}


def _flag(condition: Column) -> Column:
    return condition.cast("double")


def feature_columns(version: int = 1) -> list[Column]:
    c = F.col
    ja4 = c("ja4")
    or_zero = lambda column: F.coalesce(column.cast("double"), F.lit(0.0))
    values = [
        or_zero(c("inter_arrival_stats.mean")), or_zero(c("inter_arrival_stats.std")),
        or_zero(c("packet_size_stats.mean")), or_zero(c("packet_size_stats.std")),
        or_zero(c("packet_size_stats.min")), or_zero(c("packet_size_stats.max")),
        c("entropy"), c("byte_ratio"), c("ttl").cast("double"),
        or_zero(c("fanout_count")), or_zero(c("dns_ngram_entropy")),
        _flag(c("beacon_interval_stats").isNotNull()), _flag(ja4.isNotNull()),
        _flag(is_malicious(ja4)), _flag(lacks_sni(ja4)), _flag(lacks_alpn(ja4)),
    ]
    if version == 2:
        values += [
            c("pkt_rate"), c("byte_rate"), c("syn_count").cast("double"), c("syn_fraction"),
            c("src_ip_entropy"),
            _flag(c("outbound_bytes").isNotNull()), or_zero(F.log1p(c("outbound_bytes"))),
            _flag(c("inbound_bytes").isNotNull()), or_zero(F.log1p(c("inbound_bytes"))),
            _flag(F.coalesce(F.upper("dns_record_type"), F.lit("")) == "TXT"),
            F.coalesce(c("dns_query_len"), F.lit(-1.0)),
        ]
    return [v.alias(n) for v, n in zip(values, FEATURE_NAMES)]


def feature_vector(version: int = 1) -> Column:
    """array<double> of 16 (version 1) or 27 (version 2) inputs."""
    if version not in WIDTH:
        raise ValueError("feature version must be 1 or 2")
    return F.array(*feature_columns(version))
