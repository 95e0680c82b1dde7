"""Packets that come late or beyond a window's limit, and streams of records with rejected rows."""

import json
import os

import pytest
from pyspark.sql import functions as F

from flowsift.operators import dashboard, flows as fl, state, timings
from flowsift.sources import flow_json
from tests.helpers import by_flow, packet, packets

WINDOW = 1_000_000


def sent(spark):
    """Windows 0, 0, 1, 0 (late), 1, 1 in one capture; another capture that stays behind loses nothing."""
    times = [0.1, 0.2, 1.1, 0.3, 1.2, 1.3]
    return packets(spark, [packet(i, t) for i, t in enumerate(times)] + [packet(i, t / 10, capture="slow") for i, t in enumerate(times)])


def test_late_packets_go_before_any_feature(spark):
    kept = by_flow(fl.build_flows(sent(spark), window_us=WINDOW, late="drop").filter("capture_id = 'c'"))
    assert [(r["bucket"], r["pkt_rate"]) for r in kept] == [(0, 2.0), (1, 3.0)]
    assert kept[0]["inter_arrival_stats"]["mean"] == pytest.approx(0.1)
    every = by_flow(fl.build_flows(sent(spark), window_us=WINDOW).filter("capture_id = 'c'"))
    assert [r["pkt_rate"] for r in every] == [3.0, 3.0]
    with pytest.raises(ValueError):
        fl.build_flows(sent(spark), late="perhaps")


@pytest.mark.parametrize("chunk_rows", [1, 2, 1 << 17])
def test_counters_of_captures(spark, chunk_rows):
    extra = packets(spark, [packet(9, 1.5)]).withColumn("ts_us", F.lit(None).cast("bigint"))
    arrived = fl.arrivals(sent(spark).union(extra), window_us=WINDOW, cap=2, chunk_rows=chunk_rows)
    got = {r["capture_id"]: r.asDict() for r in dashboard.packet_counters(arrived, "capture_id").collect()}
    assert got["c"] == {"capture_id": "c", "packets": 7, "kept": 4, "late_packets": 1, "packets_dropped": 1, "untimed_packets": 1}
    assert got["slow"]["late_packets"] == 0 and got["slow"]["packets_dropped"] == 4
    flows = fl.build_flows(arrived, window_us=WINDOW)
    assert dashboard.flow_counters(flows).first().asDict() == {"windows": 3, "flows": 3, "invalid_flows": 0}
    assert dashboard.flow_counters(flows.withColumn("ttl", F.lit(None).cast("int"))).first()["invalid_flows"] == 3


def test_late_packets_do_not_count_against_the_limit(spark):
    rows = packets(spark, [packet(i, t) for i, t in enumerate([1.1, 0.1, 0.2, 1.2, 1.3])])
    fates = state.mark_fate(fl.in_windows(rows, WINDOW), cap=2).orderBy("frame_no").select("fate").collect()
    assert [r["fate"] for r in fates] == ["kept", "late", "late", "kept", "dropped"]


def record(i, **changes):
    stats = {"min": 1.0, "max": 1.0, "mean": 1.0, "std": 0.0}
    return json.dumps({"flow_id": f"f{i}", "timestamp": "2024-01-01T00:00:00", "src_port": 1, "dst_port": 80, "protocol": "TCP", "packet_size_stats": stats,
                       "inter_arrival_stats": {"mean": 0.1, "std": 0.0}, "entropy": 3.0, "byte_ratio": 0.5, "ttl": 64} | changes)


def test_rejected_rows_of_a_stream_are_kept_once(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    os.makedirs(source)

    def put(name, lines):
        with open(f"{source}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")

    def run():
        flow_json.quarantine_stream(flow_json.stream_flow_lines(spark, source, maxFilesPerTrigger=1), out).awaitTermination()
        read = lambda name: spark.read.parquet(f"{out}/{name}")
        assert read("flows").count() == read("counters").agg(F.sum("valid")).first()[0]
        assert read("rejected").count() == read("counters").agg(F.sum("rejected")).first()[0]
        return sorted(r[0] for r in read("flows").select("flow_id").collect()), sorted(r[0][0] for r in read("rejected").select("violations").collect())

    put("a", [record(1), record(2, ttl=None), "{broken"])
    put("b", [record(3)])
    assert run() == (["f1", "f3"], ["malformed", "ttl: required"])
    # A batch whose end was not noted runs again and leaves one copy.
    commits = sorted(n for n in os.listdir(f"{out}/_checkpoint/commits") if n.isdigit())
    os.remove(f"{out}/_checkpoint/commits/{commits[-1]}")
    if os.path.exists(crc := f"{out}/_checkpoint/commits/.{commits[-1]}.crc"):
        os.remove(crc)
    put("c", [record(4, pkt_rate=-1.0), record(5)])
    assert run() == (["f1", "f3", "f5"], ["malformed", "pkt_rate: below 0", "ttl: required"])


def test_latency_report(spark):
    rows = spark.createDataFrame([(float(i),) for i in range(1, 101)], "ms double")
    got = timings.latency_report(rows, "ms", window_ms=120.0).first()
    assert (got["p50_ms"], got["p95_ms"], got["p99_ms"]) == (51.0, 95.0, 99.0)
    assert got["headroom"] == pytest.approx(1 - 95 / 120)
    assert timings.latency_report(rows, "ms", window_ms=90.0).first()["headroom"] == 0.0
    assert timings.latency_report(rows.limit(0), "ms").first()["headroom"] is None
