"""Rules, z-scores, fusion, gate, calibration, models."""

import math

import pytest
from pyspark.sql import functions as F

from flowsift.constants import LAYERS
from flowsift.operators.calibration import Calibration, apply_calibration, fit_calibration
from flowsift.operators.classifier import class_order, probability_layer
from flowsift.operators.fusion import benign_consensus, fuse, layers_from_long
from flowsift.operators.iforest import fit_forest, forest_layer, mean_path
from flowsift.operators.rules import rules_layer
from flowsift.operators.zscore import fit_baseline, zscore_layer
from flowsift.schemas import FLOW_RECORD_DDL

QUIET = dict(
    flow_id="f", timestamp=None, src_port=1, dst_port=443, protocol="TCP",
    packet_size_stats=dict(min=100.0, max=100.0, mean=100.0, std=0.0), inter_arrival_stats=dict(mean=0.1, std=0.0),
    entropy=4.0, byte_ratio=0.5, ttl=64, ja4=None, beacon_interval_stats=None, dns_ngram_entropy=None, fanout_count=1,
    outbound_bytes=None, inbound_bytes=None, pkt_rate=10.0, byte_rate=1000.0, syn_count=0, syn_fraction=0.0,
    target_pkt_rate=None, target_syn_fraction=None, src_ip_entropy=0.0, dns_query_len=None, dns_record_type=None)


def flows(spark, *changes):
    return spark.createDataFrame([{**QUIET, "flow_id": f"f{i}", **c} for i, c in enumerate(changes)], FLOW_RECORD_DDL)


def judged(spark, **change):
    return rules_layer(flows(spark, change)).select("rules.*").first()


def size(mean):
    return dict(min=mean, max=mean, mean=mean, std=0.0)


@pytest.mark.parametrize("change, score, guess", [
    ({}, 0.0, None),
    (dict(pkt_rate=500.0, syn_fraction=0.8), 0.55, "volumetric_ddos"),
    (dict(pkt_rate=499.9, syn_fraction=0.8), 0.0, None),
    (dict(target_pkt_rate=5000.0, src_ip_entropy=1.0), 0.55, "volumetric_ddos"),
    (dict(inter_arrival_stats=dict(mean=0.0, std=0.0)), 0.20, None),
    (dict(inter_arrival_stats=dict(mean=0.001, std=0.0), packet_size_stats=size(700.0)), 0.45, "volumetric_ddos"),
    (dict(beacon_interval_stats=dict(mean=10.0, std=0.5)), 0.35, "c2_beaconing"),
    (dict(beacon_interval_stats=dict(mean=10.0, std=0.51)), 0.0, None),
    (dict(beacon_interval_stats=dict(mean=301.0, std=0.0)), 0.0, None),
    (dict(dns_ngram_entropy=7.0, dst_port=53), 0.45, "dga_dns_tunneling"),
    (dict(dns_ngram_entropy=7.5, dst_port=443), 0.0, None),
    (dict(dst_port=8081), 0.15, None),
    (dict(dst_port=8080), 0.0, None),
    (dict(fanout_count=15), 0.60, "recon_scanning"),
    (dict(fanout_count=15, packet_size_stats=size(200.0)), 0.45, "recon_scanning"),
    (dict(dst_port=4444, entropy=7.6), 0.35, "encrypted_malware"),
    (dict(ja4="t13i050200_e133e205ac38_000000000000"), 0.40, "encrypted_malware"),
    (dict(ja4="t13i0502h2_aaaaaaaaaaaa_000000000000", entropy=6.6), 0.30, "encrypted_malware"),
    (dict(ja4="t13d050200_aaaaaaaaaaaa_000000000000", entropy=7.3), 0.20, "encrypted_malware"),
    (dict(entropy=7.9), 0.10, None),
    (dict(outbound_bytes=20000, inbound_bytes=100), 0.30, "data_exfiltration"),
    (dict(outbound_bytes=20000, inbound_bytes=None), 0.0, None),
])
def test_rules(spark, change, score, guess):
    got = judged(spark, **change)
    assert got["raw_score"] == pytest.approx(score)
    assert got["threat_class_guess"] == guess
    assert got["calibrated_probability"] == pytest.approx(1 / (1 + math.exp(-5 * (score - 0.25))))


def test_strongest_vote_wins_and_runners_up_stay_visible(spark):
    got = judged(spark, beacon_interval_stats=dict(mean=10.0, std=0.0), ja4="t13i050200_e133e205ac38_000000000000")
    assert got["threat_class_guess"] == "c2_beaconing"
    assert got["evidence"][-1] == "rule_candidates[c2_beaconing=0.50, encrypted_malware=0.40]"


def test_equal_votes_take_the_first_name(spark):
    got = judged(spark, dns_ngram_entropy=7.5, dst_port=53, inter_arrival_stats=dict(mean=0.001, std=0.0), packet_size_stats=size(800.0))
    assert got["threat_class_guess"] == "dga_dns_tunneling"


def test_zscore(spark):
    base = fit_baseline(flows(spark, {"ttl": 60}, {"ttl": 68}))
    assert base.stats["ttl"] == (64.0, 4.0) and base.stats["entropy"] == (4.0, 1.0)
    got = zscore_layer(flows(spark, {"ttl": 76}), base).select("stats.*").first()
    assert got["raw_score"] == pytest.approx((0.5 * 3 / 6 + 0.5 * 3) / 5)
    assert got["evidence"] == ["unusual_ttl (z=3.00)"]
    without = zscore_layer(flows(spark, {"ttl": 76, "fanout_count": 0}), base).select("stats.*").first()
    assert without["raw_score"] == pytest.approx((0.5 * 3 / 5 + 0.5 * 3) / 5)


def test_fanout_baseline_without_values(spark):
    assert fit_baseline(flows(spark, {"fanout_count": None})).stats["fanout_count"] == (1.0, 1.0)


def fused(spark, *layers):
    """layers: (probability, guess, evidence) per layer in order."""
    row = {n: (n, p, p, g, e) for n, (p, g, e) in zip(LAYERS, layers)}
    shape = "struct<layer_name:string,raw_score:double,calibrated_probability:double,threat_class_guess:string,evidence:array<string>>"
    df = spark.createDataFrame([tuple(row[n] for n in LAYERS)], ", ".join(f"{n} {shape}" for n in LAYERS))
    return fuse(df).first()


def test_two_layers_agree(spark):
    got = fused(spark, (0.9, "recon_scanning", ["a"]), (0.2, None, None), (0.3, None, None), (0.8, "recon_scanning", ["b"]))
    assert (got.threat_class, got.tier, got.corroborating_layers, got.is_actionable) == ("recon_scanning", "high", 2, True)
    assert got.confidence_score == pytest.approx(0.55)
    assert got.evidence == ["a", "b", "tier=high", "corroborating_layers=2"]


def test_single_layer_needs_the_higher_bar(spark):
    got = fused(spark, (0.9, "recon_scanning", None), (0.5, None, None), (0.5, None, None), (0.5, None, None))
    assert (got.tier, got.is_actionable) == ("advisory", False)


def test_unsupervised_corroboration(spark):
    got = fused(spark, (0.6, "c2_beaconing", None), (0.8, None, None), (0.5, None, None), (0.4, None, None))
    assert (got.tier, got.corroborating_layers, got.is_actionable) == ("high", 2, True)
    assert "stats_corroborates=0.800" in got.evidence


def test_two_candidates_get_no_corroboration(spark):
    got = fused(spark, (0.6, "c2_beaconing", None), (0.9, None, None), (0.9, None, None), (0.8, "recon_scanning", None))
    assert (got.threat_class, got.corroborating_layers) == ("recon_scanning", 1)


def test_named_order_breaks_full_ties(spark):
    got = fused(spark, (0.6, "recon_scanning", None), (0.1, None, None), (0.1, None, None), (0.6, "c2_beaconing", None))
    assert got.threat_class == "recon_scanning"


@pytest.mark.parametrize("said, route", [
    ("unusual_fanout", "recon_scanning"), ("unusual_byte_ratio", "data_exfiltration"), ("odd_entropy", "dga_dns_tunneling"),
    ("high pps", "volumetric_ddos"), ("nothing known", "recon_scanning"), ("byte fanout", "recon_scanning")])
def test_anomaly_route(spark, said, route):
    got = fused(spark, (0.2, None, None), (0.8, None, [said]), (0.9, None, None), (0.1, "benign", None))
    assert (got.threat_class, got.tier, got.corroborating_layers) == (route, "advisory", 2)
    assert "unclassified_anomaly=true" in got.evidence and "unsupervised_layers_alerted=2" in got.evidence


def test_nothing_named_is_suppressed(spark):
    got = fused(spark, (0.7, None, None), (0.7, None, None), (0.7, None, None), (0.99, "benign", None))
    assert (got.threat_class, got.tier, got.is_actionable) == ("volumetric_ddos", "uncorroborated", False)
    assert "no_layer_named_a_threat_class" in got.evidence


def test_unknown_class_is_no_vote(spark):
    got = fused(spark, (0.9, "worm", None), (0.1, None, None), (0.1, None, None), (0.1, None, None))
    assert got.tier == "uncorroborated"


def test_long_scores_zip(spark):
    rows = [("f", n, 0.5, 0.5, None, None) for n in reversed(LAYERS)]
    from flowsift.schemas import LAYER_SCORE_DDL
    got = layers_from_long(spark.createDataFrame(rows, LAYER_SCORE_DDL)).first()
    assert [s.layer_name for s in got.scores] == LAYERS


def test_probability_layer(spark):
    df = spark.createDataFrame([([0.2, 0.5, 0.3],), ([0.6, 0.1, 0.3],)], "p array<double>")
    a, b = probability_layer(df, F.col("p"), ["benign", "c2_beaconing", "recon_scanning"]).select("xgb.*").collect()
    assert (a.threat_class_guess, a.raw_score, a.evidence) == ("c2_beaconing", pytest.approx(0.8), ["c2_beaconing=0.500", "recon_scanning=0.300"])
    assert b.threat_class_guess is None
    with pytest.raises(ValueError):
        class_order({"benign"})


def test_calibration(spark):
    layer = "struct<raw_score:double>"
    def table(rows):
        return spark.createDataFrame([(p, (p,), (p,), (p,), (p,), ok, []) for p, ok in rows],
                                     f"confidence_score double, rules {layer}, stats {layer}, isoforest {layer}, xgb {layer}, ok boolean, evidence array<string>")
    with pytest.raises(ValueError):
        fit_calibration(table([(0.5, True)] * 30), F.col("ok"))
    made = fit_calibration(table([(0.1, False)] * 15 + [(0.9, True)] * 15), F.col("ok"))
    low, high = [r.confidence_score for r in apply_calibration(table([(0.1, True), (0.9, True)]), made).collect()]
    assert 0 < low < 0.3 < 0.7 < high < 1
    assert apply_calibration(table([(0.1, True)]), None).first().evidence == ["confidence=uncalibrated_heuristic"]


def test_benign_consensus(spark):
    layer = "struct<raw_score:double,threat_class_guess:string>"
    rows = [((0.1, None), (0.1, None), (0.2, None), (0.05, None)), ((0.1, None), (0.3, None), (0.2, None), (0.05, None)),
            ((0.1, None), (0.1, None), (0.2, None), (0.4, None))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {layer}" for n in LAYERS))
    assert benign_consensus(df).count() == 1


def test_forest_ranks_outliers_higher(spark):
    import random
    rng = random.Random(1)
    normal = [dict(ttl=60 + rng.randrange(9), entropy=rng.uniform(3, 5), inter_arrival_stats=dict(mean=rng.uniform(0.05, 0.2), std=0.0)) for _ in range(400)]
    forest = fit_forest(flows(spark, *normal), trees=60)
    assert forest.feature.shape[0] == 60 and forest.midpoint == pytest.approx(0.5, abs=0.05)
    odd = dict(ttl=255, entropy=8.0, inter_arrival_stats=dict(mean=9.0, std=3.0), fanout_count=300)
    scores = [r.s for r in forest_layer(flows(spark, normal[0], odd), forest).select(F.col("isoforest.raw_score").alias("s")).collect()]
    assert scores[1] > 0.6 > scores[0] + 0.05
    assert float(mean_path(2)) == 1.0 and float(mean_path(1)) == 0.0


def test_forest_on_mostly_identical_rows(spark):
    rows = [{}] * 300 + [dict(ttl=32 + i) for i in range(30)]
    forest = fit_forest(flows(spark, *rows), trees=20)
    assert len(forest.feature) == 20
