"""Rule layer: weighted conditions on one flow, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.constants import DNS_PORTS, SAFE_PORTS, SUSPICIOUS_PORTS
from flowsift.functions.core import let
from flowsift.functions.ja4 import is_malicious, lacks_alpn, lacks_sni
from flowsift.functions.scores import squash


@dataclass(frozen=True)
class RuleLimits:
    """Fixed thresholds of the rule layer; pass others to fit another window length."""

    syn_flood_rate: float = 500.0
    syn_flood_share: float = 0.8
    distributed_rate: float = 5000.0
    distributed_entropy: float = 1.0
    fast_gap_s: float = 0.002
    scan_fanout: int = 15
    flood_size: float = 700.0
    beacon_min_s: float = 5.0
    beacon_max_s: float = 300.0
    beacon_jitter: float = 0.05
    dns_entropy: float = 7.0
    unusual_port: int = 8000
    probe_size: float = 200.0
    port_entropy: float = 7.5
    no_sni_entropy: float = 6.5
    no_alpn_entropy: float = 7.2
    high_entropy: float = 7.8
    exfil_share: float = 0.9
    exfil_bytes: int = 10_000
    suspicious_ports: tuple = field(default=tuple(SUSPICIOUS_PORTS))
    safe_ports: tuple = field(default=tuple(SAFE_PORTS))
    dns_ports: tuple = field(default=tuple(DNS_PORTS))


# Order in which a rule can first vote for a class; equal votes are listed in this order.
VOTE_ORDER = [
    "volumetric_ddos", "c2_beaconing", "dga_dns_tunneling", "recon_scanning", "encrypted_malware",
    "data_exfiltration",
]


def _rules(limits: RuleLimits) -> list[tuple[Column, float, str | None, float, Column]]:
    """(condition, score, class voted for, vote, evidence) in evaluation order."""
    c = F.col
    size, gap = c("packet_size_stats.mean"), c("inter_arrival_stats.mean")
    fanout = F.coalesce(c("fanout_count"), F.lit(0))
    rate = F.coalesce("target_pkt_rate", "pkt_rate")
    syn = F.coalesce("target_syn_fraction", "syn_fraction")
    beacon_mean, beacon_std = c("beacon_interval_stats.mean"), c("beacon_interval_stats.std")
    fast = gap < limits.fast_gap_s
    scan = fanout >= limits.scan_fanout
    port_hit = c("dst_port").isin(*limits.suspicious_ports)
    ioc, no_sni, no_alpn = is_malicious(c("ja4")), lacks_sni(c("ja4")), lacks_alpn(c("ja4"))
    sni_hit = ~ioc & no_sni & (c("entropy") > limits.no_sni_entropy)
    alpn_hit = ~ioc & ~(no_sni & (c("entropy") > limits.no_sni_entropy)) & no_alpn & (
        port_hit | (c("entropy") > limits.no_alpn_entropy))
    out, into = c("outbound_bytes"), c("inbound_bytes")
    head = F.substring("ja4", 1, 10)
    fmt = F.format_string
    say = F.lit
    return [
        ((rate >= limits.syn_flood_rate) & (syn >= limits.syn_flood_share),
         0.55, "volumetric_ddos", 0.55, fmt("syn_flood_rate=%.1f/s", "pkt_rate")),
        ((rate >= limits.distributed_rate) & (c("src_ip_entropy") >= limits.distributed_entropy),
         0.55, "volumetric_ddos", 0.55,
         fmt("distributed_target_rate=%.1f/s, source_entropy=%.2f", rate, "src_ip_entropy")),
        (fast, 0.20, None, 0.0, say("extremely_low_inter_arrival_time")),
        (fast & (fanout < limits.scan_fanout) & (size >= limits.flood_size),
         0.25, "volumetric_ddos", 0.45, say("sustained_high_volume_on_single_target")),
        ((beacon_mean > 0) & (F.try_divide(beacon_std, beacon_mean) <= limits.beacon_jitter)
         & beacon_mean.between(limits.beacon_min_s, limits.beacon_max_s),
         0.35, "c2_beaconing", 0.50, say("regular_beacon_interval")),
        ((c("dns_ngram_entropy") >= limits.dns_entropy) & c("dst_port").isin(*limits.dns_ports),
         0.45, "dga_dns_tunneling", 0.45, fmt("high_dns_ngram_entropy=%.2f", "dns_ngram_entropy")),
        ((c("dst_port") > limits.unusual_port) & ~c("dst_port").isin(*limits.safe_ports),
         0.15, None, 0.0, say("unusual_destination_port")),
        (scan, 0.45, "recon_scanning", 0.45, fmt("high_target_fanout=%d", fanout)),
        (scan & (size < limits.probe_size), 0.15, "recon_scanning", 0.15, say("low_volume_probe_traffic")),
        (port_hit, 0.20, None, 0.0, say("suspicious_destination_port")),
        (port_hit & (c("entropy") > limits.port_entropy),
         0.15, "encrypted_malware", 0.35, say("high_entropy_payload")),
        (ioc, 0.40, "encrypted_malware", 0.40, F.concat(say("malicious_ja4_fingerprint="), "ja4")),
        (sni_hit, 0.30, "encrypted_malware", 0.30, F.concat(say("ja4_missing_sni_encrypted="), head)),
        (alpn_hit, 0.20, "encrypted_malware", 0.20, F.concat(say("ja4_anomalous_no_alpn="), head)),
        (c("entropy") > limits.high_entropy, 0.10, None, 0.0, say("very_high_entropy_payload")),
        (out.isNotNull() & into.isNotNull()
         & (F.try_divide(out, F.greatest(out + into, F.lit(1))) > limits.exfil_share) & (out > limits.exfil_bytes),
         0.30, "data_exfiltration", 0.30, F.concat(say("directional_exfil_outbound="), out.cast("string"), say("B"))),
    ]


def rules_layer(flows: DataFrame, limits: RuleLimits = RuleLimits(), out: str = "rules") -> DataFrame:
    """Add the rule layer's score struct. Only narrow projections: no shuffle, no Python.

    Conditions, then sums, then the verdict are separate projections, so each is generated code
    that evaluates every condition once.
    """
    rules = _rules(limits)
    hit = [F.col(f"_h{i}") for i in range(len(rules))]
    marked = flows.withColumns({f"_h{i}": F.coalesce(r[0], F.lit(False)) for i, r in enumerate(rules)})

    score = F.lit(0.0)
    votes = {cls: F.lit(0.0) for cls in VOTE_ORDER}
    for h, (_, points, cls, vote, _) in zip(hit, rules):
        score = score + F.when(h, points).otherwise(0.0)
        if cls:
            votes[cls] = votes[cls] + F.when(h, vote).otherwise(0.0)
    summed = marked.withColumns({
        "_raw": F.least(score, F.lit(1.0)), **{f"_v_{c}": v for c, v in votes.items()},
        "_said": F.filter(F.array(*[F.when(h, r[4]) for h, r in zip(hit, rules)]), lambda e: e.isNotNull())})

    vote = {c: F.col(f"_v_{c}") for c in VOTE_ORDER}
    topped = summed.withColumns({
        "_top": F.greatest(*vote.values()),
        "_named": sum([(v > 0).cast("int") for v in vote.values()], F.lit(0))})
    guess = None
    for cls in sorted(VOTE_ORDER):
        wins = (F.col("_top") > 0) & (vote[cls] == F.col("_top"))
        guess = F.when(wins, cls) if guess is None else guess.when(wins, cls)
    ranked = F.array_sort(F.filter(F.array(*[
        F.struct((-v).alias("neg"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, (c, v) in enumerate(vote.items())]),
        lambda v: v["neg"] < 0))
    listing = F.array_join(F.transform(ranked, lambda v: F.format_string("%s=%.2f", v["c"], -v["neg"])), ", ")
    said = F.when(F.col("_named") > 1, F.array_append("_said", F.concat(
        F.lit("rule_candidates["), listing, F.lit("]")))).otherwise(F.col("_said"))
    return topped.withColumn(
        out, layer_score("rules", F.col("_raw"), squash(F.col("_raw")), guess, said),
    ).select(*flows.columns, out)


def layer_score(name: str, raw: Column, probability: Column, guess: Column | None, evidence: Column) -> Column:
    """The struct every layer yields."""
    return F.struct(
        F.lit(name).alias("layer_name"),
        raw.alias("raw_score"),
        probability.alias("calibrated_probability"),
        (guess if guess is not None else F.lit(None).cast("string")).alias("threat_class_guess"),
        let(evidence, lambda e: F.when(F.size(e) > 0, e)).alias("evidence"),
    )
