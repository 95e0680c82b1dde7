"""A stream gives the same rows as a batch over the same packets."""

import uuid

import pytest
from pyspark.sql import functions as F

from flowsift.operators import flows as fl, state
from flowsift.operators.fusion import fuse
from flowsift.plans.queries import DAY, LIMITS, given_scores
from flowsift.operators.rules import rules_layer
from flowsift.operators.zscore import fit_baseline, zscore_layer
from flowsift.sources.tables import packets_from_events, table
from flowsift.streaming import detection, state as live, windows
from flowsift.schemas import PACKET_DDL

HOUR = 3_600_000_000


@pytest.fixture(scope="module")
def packet_files(spark, sf, tmp_path_factory):
    """Packets in time-ordered files, and a last one far ahead that closes every window."""
    folder = str(tmp_path_factory.mktemp("packets"))
    rows = packets_from_events(table(spark, sf, "events")).withColumn("is_syn", F.coalesce("is_syn", F.lit(False)))
    start = rows.agg(F.min("ts_us")).first()[0]
    for part in range(3):
        piece = rows.filter(F.floor((F.col("ts_us") - start) / (11 * DAY)) == part)
        piece.coalesce(1).write.mode("append").parquet(folder)
    closer = rows.limit(1).withColumns({"ts_us": F.col("ts_us") + 100 * DAY, "frame_no": F.lit(10 ** 12), "capture_id": F.lit("end")})
    closer.coalesce(1).write.mode("append").parquet(folder)
    return folder, rows


def source(spark, folder):
    return spark.readStream.schema(PACKET_DDL).option("maxFilesPerTrigger", 1).parquet(folder)


def collected(spark, stream, tmp_path):
    name = "s" + uuid.uuid4().hex[:8]
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def same(a, b):
    cols = sorted(a.columns)
    left, right = [sorted(map(repr, (tuple(r) for r in d.select(*cols).collect()))) for d in (a, b)]
    assert left == right


def sightings(rows):
    return fl.sightings(fl.with_reverse(fl.packet_totals(fl.in_windows(rows, HOUR))))


def own_hello(rows, window_us=HOUR):
    totals = fl.packet_totals(fl.in_windows(rows, window_us))
    return totals.filter("n_sized > 0").withColumn("hello_ja4", F.col("own_ja4")).transform(fl.sightings)


def test_flows_and_alerts_equal_batch(spark, packet_files, tmp_path):
    folder, rows = packet_files
    options = dict(window_us=HOUR, horizon_us=3 * DAY, beacon_lookback_us=20 * DAY, protected=["10.0.0.0/8"])
    batch = fl.build_flows(rows, **options).persist()
    base = fit_baseline(batch.filter("dst_port = 80"))
    detect = lambda f: fuse(given_scores(zscore_layer(rules_layer(f, LIMITS), base)))
    out = str(tmp_path / "live")
    query = detection.stream_flows(source(spark, folder), out, lateness="0 seconds", detect=detect, **options)
    query.awaitTermination()
    live_flows = spark.read.parquet(f"{out}/flows")
    assert live_flows.select("batch").distinct().count() > 1
    flat = lambda d: d.select(
        "flow_id", "capture_id", "ts_us", "fanout_count", "ja4", F.round("beacon_interval_stats.mean", 5).alias("b"),
        F.round("entropy", 9).alias("e"), F.round("src_ip_entropy", 9).alias("se"), "outbound_bytes", "inbound_bytes", "dns_record_type",
        F.round("dns_ngram_entropy", 9).alias("d"), F.round("inter_arrival_stats.mean", 6).alias("g"))
    same(flat(live_flows), flat(batch))
    wanted = detect(batch).filter("is_actionable")
    same(spark.read.parquet(f"{out}/alerts").select("capture_id", "flow_id", "threat_class"),
         wanted.select("capture_id", "flow_id", "threat_class"))
    counters = spark.read.parquet(f"{out}/counters").agg(F.sum("flows_scored"), F.sum("alerts_emitted")).first()
    assert tuple(counters) == (batch.count(), wanted.count())
    assert detection.late_packets(query) == 0
    batch.unpersist()


def test_keyed_state_equals_batch(spark, packet_files, tmp_path):
    folder, rows = packet_files
    seen = own_hello(rows)
    stream = lambda: windows.stream_sightings(source(spark, folder), window_us=HOUR)

    got = collected(spark, live.fanout_stream(stream(), horizon_us=3 * DAY), tmp_path)
    same(got, state.horizon_fanout(seen, horizon_us=3 * DAY))

    got = collected(spark, live.beacon_stream(stream(), lookback_us=10 * DAY, keep=6), tmp_path).select(
        *state.PAIR, "bucket", F.round("beacon_mean", 4).alias("m"), F.round("beacon_std", 4).alias("s")).distinct()
    want = state.beacon_intervals(seen, lookback_us=10 * DAY, keep=6).select(
        *state.PAIR, "bucket", F.round("beacon_interval_stats.mean", 4).alias("m"), F.round("beacon_interval_stats.std", 4).alias("s"))
    same(got, want)

    got = collected(spark, live.fingerprint_stream(stream(), horizon_us=3 * DAY), tmp_path)
    same(got, state.carried_ja4(seen, horizon_us=3 * DAY))


def test_late_packets_are_dropped_and_counted(spark, packet_files, tmp_path):
    folder, rows = packet_files
    late_folder = str(tmp_path / "late")
    first = rows.orderBy(F.col("ts_us").desc()).limit(1)
    first.coalesce(1).write.mode("append").parquet(late_folder)
    later = first.withColumns({"ts_us": F.col("ts_us") + DAY, "frame_no": F.lit(7)})
    later.coalesce(1).write.mode("append").parquet(late_folder)
    rows.filter("frame_no = 0").coalesce(1).write.mode("append").parquet(late_folder)
    out = str(tmp_path / "out")
    query = detection.stream_flows(source(spark, late_folder), out, window_us=HOUR)
    query.awaitTermination()
    assert detection.late_packets(query) == 1


@pytest.fixture(scope="module")
def two_paces(spark, packet_files, tmp_path_factory):
    """104 files: capture a runs a thousand hours ahead of b, and five late packets of a come in file 1."""
    one = packet_files[1].drop("capture_id", "ts_us", "frame_no").limit(1)
    folder = str(tmp_path_factory.mktemp("paces"))

    def write(rows):
        spark.createDataFrame(rows, "capture_id string, ts_us bigint, frame_no bigint").crossJoin(one).coalesce(1).write.mode("append").parquet(folder)

    write([("a", 1010 * HOUR, 0), ("b", 1, 0)])
    write([("a", 1000 * HOUR + i, i) for i in range(5)] + [("b", 2, 1), (None, None, 9)])
    for k in range(2, 103):
        write([("a", 1010 * HOUR + k, k), ("b", k // 50 * HOUR + k, k)])
    write([("a", 1011 * HOUR, 999), ("b", 3 * HOUR, 999)])
    return folder


def test_captures_of_different_pace_over_many_batches(spark, two_paces, tmp_path):
    got, late, dropped = [], {}, {}

    def keep(packets, batch_id, counts):
        got.extend((r["capture_id"], r["ts_us"] // HOUR, batch_id) for r in packets.select("capture_id", "ts_us").collect())
        late[batch_id], dropped[batch_id] = counts["late_packets"], counts["packets_dropped"]

    windows.stream_closed_windows(source(spark, two_paces), str(tmp_path / "run"), keep, window_us=HOUR, clock="capture").awaitTermination()
    assert len(late) == 104 and sum(dropped.values()) == 1
    n = {key: sum(g[:2] == key for g in got) for key in {g[:2] for g in got}}
    assert sum(late.values()) == late[1] == 5
    assert n == {("a", 1010): 102, ("b", 0): 50, ("b", 1): 50, ("b", 2): 3}
    assert len(set(got)) == len(n)  # each window closes in one batch


def test_live_job_keeps_a_capture_that_lags(spark, packet_files, tmp_path):
    one = packet_files[1].filter("frame_len > 0").drop("capture_id", "ts_us", "frame_no").limit(1)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in ([("a", 99 * HOUR, 0)], [("b", 1, 0), ("b", 2, 1), ("a", HOUR, 1), ("a", HOUR, 2)], [("b", HOUR, 2), ("a", 100 * HOUR, 3)]):
        spark.createDataFrame(rows, "capture_id string, ts_us bigint, frame_no bigint").crossJoin(one).coalesce(1).write.mode("append").parquet(folder)
    query = detection.stream_flows(source(spark, folder), out, window_us=HOUR, clock="capture")
    query.awaitTermination()
    assert sorted((r["capture_id"], r["ts_us"]) for r in spark.read.parquet(f"{out}/flows").collect()) == [("a", 99 * HOUR), ("b", 1)]
    counters = spark.read.parquet(f"{out}/counters").orderBy("batch").select("packets_read", "late_packets", "packets_dropped")
    assert [tuple(r) for r in counters.collect()] == [(1, 0, 0), (4, 2, 0), (2, 0, 0)]
    assert detection.late_packets(query) == 2


def test_hot_key_state_equals_batch(spark, packet_files, tmp_path):
    folder, rows = packet_files
    own = own_hello(rows, DAY)
    stream = lambda: windows.stream_sightings(source(spark, folder), window_us=DAY)
    plain = lambda d: d.filter("capture_id <> 'end'")
    out = str(tmp_path / "fanout")
    with live.state_settings(spark, 3):
        live.stream_fanout(stream(), out, horizon_us=3 * DAY, window_us=DAY, parts=3).awaitTermination()
    got = spark.read.parquet(f"{out}/fanout")
    assert got.select("batch").distinct().count() > 2
    same(plain(got.drop("batch")), state.horizon_fanout(own, horizon_us=3 * DAY))


def test_bounded_targets_evict_the_least_recently_seen(spark, packet_files, tmp_path):
    folder, rows = packet_files
    got = plain_rows(collected(spark, live.bounded_fanout_stream(
        windows.stream_sightings(source(spark, folder), window_us=DAY), 2, horizon_us=5 * DAY, window_us=DAY), tmp_path).filter("capture_id <> 'end'"))
    held, want = {}, []
    for r in sorted(own_hello(rows, DAY).collect(), key=lambda r: (r["first_ts_us"], r["first_frame"])):
        own = held.setdefault((r["capture_id"], r["src_ip"]), {})
        own.pop((r["dst_ip"], r["dst_port"]), None)
        own[(r["dst_ip"], r["dst_port"])] = r["first_ts_us"]
        alive = [k for k, t in own.items() if t >= r["first_ts_us"] - 5 * DAY]
        gone = alive[0] if len(alive) > 2 else None
        held[(r["capture_id"], r["src_ip"])] = {k: own[k] for k in alive[-2:]}
        want.append((r["capture_id"], None if gone is None else f"{gone[0]}:{gone[1]}", r["first_frame"], r["first_ts_us"], min(2, len(alive)), r["src_ip"]))
    assert got == sorted(map(repr, want)) and any("192.0.2" in x.split(",")[1] for x in got)


def plain_rows(df):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect())
