"""Exact values of flow features on hand-made packets."""

import math
import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowsift.operators import bytes as byte_counts, flows as fl, state
from flowsift.sources.tables import packets_from_events, table
from tests.helpers import by_flow, packet, packets


def built(spark, rows, **options):
    return by_flow(fl.build_flows(packets(spark, rows), **options))


def test_rate_uses_the_window_not_the_burst(spark):
    (flow,) = built(spark, [packet(1, 12.0), packet(2, 12.000001)])
    assert flow["pkt_rate"] == pytest.approx(2 / 0.12)
    assert flow["byte_rate"] == pytest.approx(200 / 0.12)
    assert flow["packet_size_stats"] == {"min": 100.0, "max": 100.0, "mean": 100.0, "std": 0.0}


def test_source_entropy_per_target(spark):
    rows = [packet(1, 12.0, "10.0.0.1", dst="192.0.2.1"), packet(2, 12.001, "10.0.0.2", dst="192.0.2.1"),
            packet(3, 12.002, "10.0.0.3", dst="192.0.2.2")]
    assert [f["src_ip_entropy"] for f in built(spark, rows)] == [1.0, 1.0, 0.0]


def test_reverse_direction(spark):
    out = packet(1, 12.0, size=100)
    back = packet(2, 12.01, "192.0.2.1", 443, "10.0.0.1", 40000, size=60)
    (alone,) = built(spark, [out], protected=["10.0.0.0/8"])
    assert (alone["outbound_bytes"], alone["inbound_bytes"]) == (100, None)
    both = built(spark, [out, back], protected=["10.0.0.0/8"])
    assert [(f["outbound_bytes"], f["inbound_bytes"]) for f in both] == [(100, 60), (100, 60)]
    assert [(f["outbound_bytes"], f["inbound_bytes"]) for f in built(spark, [out, back])] == [(None, None)] * 2


def test_fixed_windows(spark):
    flows = built(spark, [packet(1, 12.01), packet(2, 12.02), packet(3, 12.14)])
    assert len(flows) == 2 and len({f["flow_id"] for f in flows}) == 2
    assert flows[0]["inter_arrival_stats"]["mean"] == pytest.approx(0.01)
    assert flows[1]["inter_arrival_stats"] == {"mean": 0.0, "std": 0.0}


def test_empty_frames_count_for_targets_but_make_no_flow(spark):
    flows = built(spark, [packet(1, 12.0), packet(2, 12.001, "10.0.0.9", size=0)])
    assert len(flows) == 1
    assert flows[0]["target_pkt_rate"] == pytest.approx(2 / 0.12)
    assert flows[0]["src_ip_entropy"] == 1.0


def test_payload_and_dns(spark):
    rows = [packet(1, 12.0, dport=53, proto="UDP", payload="0001", names=["ab.cd"], kind="TXT", syn=False),
            packet(2, 12.001, dport=53, proto="UDP", payload="0203", names=["Ef.g"], kind="A"),
            packet(3, 12.002, dport=53, proto="UDP", names=[], kind="A")]
    (flow,) = built(spark, rows)
    assert flow["entropy"] == 2.0
    assert flow["byte_ratio"] == pytest.approx(4 / 300)
    assert flow["dns_record_type"] == "A"
    assert flow["dns_ngram_entropy"] == pytest.approx(math.log2(6))     # abcdefg: six distinct pairs
    assert flow["dns_query_len"] == pytest.approx((2 + 1.5) / 2)


def test_modal_type_tie_goes_to_first_seen(spark):
    rows = [packet(1, 12.0, kind="TXT"), packet(2, 12.001, kind="A")]
    assert built(spark, rows)[0]["dns_record_type"] == "TXT"


def test_bad_hex_gives_zero_entropy(spark):
    (flow,) = built(spark, [packet(1, 12.0, payload="00ff"), packet(2, 12.001, payload="zz")])
    assert flow["entropy"] == 0.0


def test_short_dns_text_has_no_entropy(spark):
    (flow,) = built(spark, [packet(1, 12.0, names=["a.b"])])
    assert flow["dns_ngram_entropy"] is None and flow["dns_query_len"] == 1.0


def test_beacon_needs_four_callbacks(spark):
    calls = [packet(i, 1000.0 + 30 * i) for i in range(6)]
    flows = built(spark, calls)
    assert flows[-1]["beacon_interval_stats"] == {"mean": 30.0, "std": 0.0}
    assert [f["beacon_interval_stats"] for f in flows[:3]] == [None] * 3
    assert built(spark, calls[-1:])[0]["beacon_interval_stats"] is None


def test_beacon_survives_new_source_ports(spark):
    flows = built(spark, [packet(i, 1000.0 + 300 * i, sport=40000 + i) for i in range(4)])
    assert flows[-1]["beacon_interval_stats"]["mean"] == 300.0


def test_captures_do_not_share_state(spark):
    rows = [packet(i, 1000.0 + 30 * i) for i in range(4)] + [packet(9, 1090.0, capture="other")]
    found = {(f["capture_id"], f["ts_us"]): f["beacon_interval_stats"] for f in built(spark, rows)}
    assert found[("c", 1_090_000_000)]["mean"] == 30.0
    assert found[("other", 1_090_000_000)] is None


def test_paced_scan_is_seen_over_the_horizon(spark):
    rows = [packet(10 * w + i, 100.0 + w, dst=f"192.0.2.{5 * w + i}") for w in range(10) for i in range(5)]
    assert max(f["fanout_count"] for f in built(spark, rows)) >= 15


def test_horizon_is_inclusive(spark):
    rows = [packet(1, 100.0, dst="192.0.2.1"), packet(2, 400.0, dst="192.0.2.2"), packet(3, 400.000001 + 300, dst="192.0.2.3")]
    assert [f["fanout_count"] for f in built(spark, rows)] == [1, 2, 1]


def test_fingerprint_carries_forward_then_ages_out(spark):
    rows = [packet(1, 100.0, ja4="x"), packet(2, 200.0), packet(3, 400.0), packet(4, 400.2),
            packet(5, 100.01, "192.0.2.1", 443, "10.0.0.1", 40000)]
    flows = {(f["src_ip"], f["ts_us"]): f["ja4"] for f in built(spark, rows)}
    assert flows[("10.0.0.1", 200_000_000)] == "x"
    assert flows[("10.0.0.1", 400_000_000)] == "x"
    assert flows[("10.0.0.1", 400_200_000)] is None
    assert flows[("192.0.2.1", 100_010_000)] == "x"


def rows_of(df):
    cols = sorted(df.columns)
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


def test_chunk_size_does_not_change_results(spark, sf):
    """Stitching across chunks equals one chunk, also when one flow holds most packets."""
    rows = packets_from_events(table(spark, sf, "events")).filter("frame_no < 1000000000")
    hot = F.pmod("frame_no", F.lit(3)) > 0
    skewed = fl.in_windows(rows.withColumns({
        "capture_id": F.when(hot, "c").otherwise(F.col("capture_id")), "src_ip": F.when(hot, "s").otherwise(F.col("src_ip")),
        "src_port": F.when(hot, 1).otherwise(F.col("src_port")), "dst_ip": F.when(hot, "d").otherwise(F.col("dst_ip")),
        "dst_port": F.when(hot, 53).otherwise(F.col("dst_port")), "protocol": F.when(hot, "UDP").otherwise(F.col("protocol")),
        "ts_us": F.col("ts_us") + F.pmod("frame_no", F.lit(5)) * 900_000_000}), 40 * 86_400_000_000)
    for part in (fl.inter_arrivals, fl.payload_entropy, fl.dns_features):
        def tidy(d):
            return rows_of(d.select(*fl.FLOW_KEYS, *[F.round(c, 6).alias(c) for c in d.columns if c not in fl.FLOW_KEYS]))
        assert tidy(part(skewed, 7)) == tidy(part(skewed))
    assert rows_of(state.mark_late(skewed.withColumn("bucket", F.floor(F.col("ts_us") / 3_600_000_000)), chunk_rows=11)) == rows_of(
        state.mark_late(skewed.withColumn("bucket", F.floor(F.col("ts_us") / 3_600_000_000))))
    assert rows_of(state.mark_over_cap(skewed, 50, chunk_rows=13)) == rows_of(state.mark_over_cap(skewed, 50))


def test_time_chunks_do_not_change_results(spark, sf):
    day = 86_400_000_000
    seen = fl.sightings(fl.with_reverse(fl.packet_totals(fl.in_windows(packets_from_events(table(spark, sf, "events")), 3_600_000_000)))).persist()
    assert rows_of(state.horizon_fanout(seen, horizon_us=2 * day, chunk_us=day // 3)) == rows_of(
        state.horizon_fanout(seen, horizon_us=2 * day, chunk_us=100 * day))
    assert rows_of(state.carried_ja4(seen, horizon_us=day, chunk_us=day)) == rows_of(
        state.carried_ja4(seen, horizon_us=day, chunk_us=100 * day))
    small, large = [state.beacon_intervals(seen, lookback_us=4 * day, keep=5, chunk_us=c * day) for c in (4, 100)]
    assert rows_of(small) == rows_of(large)
    brute = seen.alias("a").join(
        seen.alias("b"), F.expr("a.capture_id = b.capture_id AND a.src_ip = b.src_ip AND b.first_ts_us BETWEEN a.first_ts_us - 172800000000 AND a.first_ts_us")
    ).groupBy("a.capture_id", "a.src_ip", "a.first_ts_us").agg(F.count_distinct("b.dst_ip", "b.dst_port").alias("horizon_fanout"))
    assert rows_of(state.horizon_fanout(seen, horizon_us=2 * day)) == rows_of(brute)
    seen.unpersist()


def _byte_batches(rows, size):
    keys, values = zip(*rows)
    whole = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary())], names=["k", "v"])
    return iter([whole.slice(at, size) for at in range(0, len(rows), size)])


def test_bytes_are_counted_alike_in_spans_of_any_size(monkeypatch):
    rng = random.Random(4)
    rows = [(k, None if rng.random() < 0.1 else rng.randbytes(rng.choice((0, 1, 3, 8, 40)))) for k in sorted(rng.choices(range(30), k=200))]
    rows += [(None, b"ab"), (None, b""), (None, b"b")]
    expected = {}
    for k, v in rows:
        expected.setdefault(k, Counter()).update(v or b"")
    for span, block, size in ((1, 7, 50), (5, 4096, 203), (64, 3, 11), (1 << 18, 4096, 203)):
        monkeypatch.setattr(byte_counts, "SPAN", span, raising=False)
        monkeypatch.setattr(byte_counts, "BLOCK", block)
        got = [r for b in byte_counts.count_bytes(_byte_batches(rows, size), ["k"], "v") for r in b.to_pylist()]
        assert len(got) == len(expected)
        assert {r["k"]: {h["_token"]: h["_c"] for h in r["_hist"]} for r in got} == expected


def test_counting_long_values_needs_little_memory():
    batches = list(_byte_batches([(k, bytes(range(256)) * 4096) for k in range(16)], 16))
    tracemalloc.start()
    got = [r for b in byte_counts.count_bytes(iter(batches), ["k"], "v") for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [{h["_c"] for h in r["_hist"]} for r in got] == [{4096}] * 16
    assert peak < 16 << 20  # less than the 16 MB of values; eight bytes of index for each would be 128 MB


def test_entropy_of_values_in_pieces(spark):
    texts = [(1, "häuser" * 5), (1, "abc"), (2, "abcabcab"), (3, ""), (4, None), (None, "ab"), (None, "cd"), (5, "abcabc")]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    got = {r["doc_id"]: round(r["e"], 9) for r in fl.byte_entropy(rows, ["doc_id"], F.lit(0), "bytes", "e", piece=3).collect()}
    counts = {}
    for k, t in texts:
        counts.setdefault(k, Counter()).update((t or "").encode())
    assert got == {k: round(-sum(n / c.total() * math.log2(n / c.total()) for n in c.values()) + 0.0, 9) for k, c in counts.items()}
    cut = rows.filter("doc_id = 2").select(F.explode(fl._pieces(F.col("bytes"), 3)).alias("p"))
    assert [bytes(r["p"]) for r in cut.collect()] == [b"abc", b"abc", b"ab"]
