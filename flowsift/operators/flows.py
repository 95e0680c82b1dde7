"""Packets to per-window flow rows.

Every aggregate is grouped by capture and window first. Ordered work (gaps, name text) runs in
(flow, frame chunk) groups of bounded size and is stitched afterwards, so one huge flow never
lands in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsift.constants import BEACON_ARRIVALS, BEACON_LOOKBACK_US, HORIZON_US, WINDOW_US
from flowsift.functions.net import direction, flow_id, in_networks, int_div, window_bucket
from flowsift.operators.bytes import PIECE, count_bytes
from flowsift.operators.ordered import CHUNK_ROWS, carry_first, rows_only, with_carry
from flowsift.operators.staging import staged
from flowsift.operators.state import KEPT, beacon_intervals, carried_ja4, horizon_fanout, mark_fate

TUPLE = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol"]
# The window number leads: it is the most selective key, and an integer, in every sort by flow.
FLOW_KEYS = ["bucket", "capture_id", *TUPLE]
TARGET_KEYS = ["capture_id", "bucket", "dst_ip", "dst_port", "protocol"]
SOURCE_KEYS = ["capture_id", "bucket", "src_ip"]


def in_windows(packets: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    return packets.withColumn("bucket", window_bucket(F.col("ts_us"), window_us))


def _positive(column: str) -> Column:
    return F.when(F.col(column) > 0, F.col(column))


def packet_totals(packets: DataFrame) -> DataFrame:
    """Order-free flow aggregates: sizes, counts, SYNs, payload bytes, first-packet attributes.

    Flows without any positive frame length stay in, with n_sized = 0: they still count towards
    the per-source and per-target aggregates. All buffers are fixed-width, so packets combine in
    hash maps before the shuffle; the few packets with a fingerprint are aggregated apart.
    """
    size = _positive("frame_len")
    totals = packets.groupBy(*FLOW_KEYS).agg(
        F.count(F.lit(1)).alias("n_packets"),
        F.count(size).alias("n_sized"),
        F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"),
        F.min(size).cast("double").alias("size_min"),
        F.max(size).cast("double").alias("size_max"),
        F.avg(size).alias("size_mean"),
        F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("size_std"),
        F.count_if(F.col("is_syn")).alias("syn_count"),
        F.sum(int_div(F.length(F.coalesce("payload_hex", F.lit(""))).cast("bigint"), 2)).alias("payload_bytes"),
        F.min("frame_no").alias("first_frame"),
        F.min_by("ts_us", "frame_no").alias("first_ts_us"),
        F.min_by("ttl", "frame_no").alias("ttl"),
    )
    hellos = packets.filter(F.col("ja4").isNotNull()).groupBy(*FLOW_KEYS).agg(F.max_by("ja4", "frame_no").alias("own_ja4"))
    return totals.join(hellos, FLOW_KEYS, "left")


def inter_arrivals(packets: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Mean and sample deviation (seconds) of the positive gaps in arrival order, per flow."""
    chunked = packets.select(*FLOW_KEYS, "frame_no", "ts_us").withColumn(
        "_chunk", int_div(F.col("frame_no"), chunk_rows))
    order = Window.partitionBy(*FLOW_KEYS, "_chunk").orderBy("frame_no")
    gap = F.col("ts_us") - F.lag("ts_us").over(order)
    local = chunked.withColumn("gap", gap).withColumn("gap", _positive("gap")).groupBy(*FLOW_KEYS, "_chunk").agg(
        F.count("gap").alias("n"),
        F.sum("gap").alias("s"),
        (F.var_pop("gap") * F.count("gap")).alias("m2"),
        F.min_by("ts_us", "frame_no").alias("first_ts"),
        F.max_by("ts_us", "frame_no").alias("last_ts"),
    )
    by_flow = Window.partitionBy(*FLOW_KEYS)
    seam = F.col("first_ts") - F.lag("last_ts").over(by_flow.orderBy("_chunk"))
    stitched = local.withColumn("seam", seam).withColumn("seam", _positive("seam"))
    n_all = F.sum(F.col("n") + F.when(F.col("seam").isNotNull(), 1).otherwise(0)).over(by_flow)
    s_all = F.sum(F.coalesce("s", F.lit(0)) + F.coalesce("seam", F.lit(0))).over(by_flow)
    centred = stitched.withColumns({"n_all": n_all, "mean_all": F.try_divide(s_all, n_all)})
    spread = (
        F.coalesce("m2", F.lit(0.0))
        + F.coalesce(F.col("n") * F.pow(F.try_divide("s", "n") - F.col("mean_all"), 2), F.lit(0.0))
        + F.coalesce(F.pow(F.col("seam") - F.col("mean_all"), 2), F.lit(0.0))
    )
    merged = centred.groupBy(*FLOW_KEYS).agg(
        F.max("n_all").alias("n"), F.max("mean_all").alias("mean"), F.sum(spread).alias("m2"))
    return merged.select(
        *FLOW_KEYS,
        F.coalesce(F.col("mean") / 1e6, F.lit(0.0)).alias("gap_mean"),
        F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)) / 1e6).otherwise(0.0).alias("gap_std"),
    )


def entropy_from_counts(total: Column, weighted: Column) -> Column:
    """Shannon entropy in bits from n and sum(c*log2(c)); the + 0.0 removes a negative zero."""
    return F.greatest(F.log2(total) - weighted / total, F.lit(0.0)) + F.lit(0.0)


def token_entropy(rows: DataFrame, keys: Sequence[str], tokens: Column, out: str) -> DataFrame:
    """Shannon entropy of all tokens of a group, by counts of (group, token).

    Counts combine before the shuffle, so a hot group sends at most its vocabulary per task.
    """
    return (
        rows.select(*keys, F.explode(tokens).alias("_token"))
        .groupBy(*keys, "_token").agg(F.count(F.lit(1)).alias("_c"))
        .groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log2("_c")).alias("_w"))
        .select(*keys, entropy_from_counts(F.col("_n"), F.col("_w")).alias(out))
    )


def _entropy_of_parts(counts: DataFrame, keys: Sequence[str], out: str) -> DataFrame:
    """Entropy from token counts per (keys, part).

    A group held by a single part is finished in place; only the counts of groups spread over
    several parts are shuffled again.
    """
    counted = counts.withColumn("_parts", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    total = F.aggregate("_hist", F.lit(0).cast("bigint"), lambda a, x: a + x["_c"])
    weighted = F.aggregate("_hist", F.lit(0.0), lambda a, x: a + x["_c"] * F.log2(x["_c"]))
    whole = counted.filter("_parts = 1").select(*keys, total.alias("_n"), weighted.alias("_w"))
    split = (
        counted.filter("_parts > 1").select(*keys, F.explode("_hist").alias("_h"))
        .groupBy(*keys, F.col("_h._token").alias("_token")).agg(F.sum("_h._c").alias("_c"))
        .groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log2("_c")).alias("_w"))
    )
    return whole.unionByName(split).select(*keys, entropy_from_counts(F.col("_n"), F.col("_w")).alias(out))


def _pieces(value: Column, size: int) -> Column:
    """The value's bytes in pieces of at most ``size``; one that is NULL or empty stays one piece."""
    n = F.octet_length(value)
    cut = F.transform(F.sequence(F.lit(0), int_div(n - 1, size).cast("int")), lambda i: F.substring(value, i * size + 1, F.lit(size)))
    return F.when(n > size, cut).otherwise(F.array(value))


def byte_entropy(rows: DataFrame, keys: Sequence[str], part: Column, value: str, out: str, piece: int = PIECE) -> DataFrame:
    """Shannon entropy of all bytes of a group's binary values.

    Rows are shuffled and sorted by (keys, part); each task then streams Arrow batches and counts
    their bytes in spans, which is over ten times faster than unpacking bytes to rows. Long values
    travel in pieces, so a task's memory depends on Spark's batch size and not on the values' length.
    """
    names = [*keys, "_part"]
    # The hash leads the sort: integers compare faster than addresses that share their beginnings.
    pieces = rows.select(*keys, part.cast("bigint").alias("_part"), F.explode(_pieces(F.col(value), piece)).alias(value))
    ordered = pieces.repartition(*[F.col(k) for k in names]).sortWithinPartitions(F.xxhash64(*names), *names)
    schema = ordered.select(*names).schema.add(
        "_hist", T.ArrayType(T.StructType().add("_token", T.IntegerType()).add("_c", T.LongType())))
    counts = ordered.mapInArrow(lambda batches: count_bytes(batches, names, value), schema)
    return _entropy_of_parts(counts, keys, out)


def whole_bytes(hex_text: Column) -> Column:
    """Bytes of a hex text; NULL when it is empty or not whole bytes."""
    return F.when(hex_text.rlike("^([0-9a-fA-F]{2})+$"), F.unhex(hex_text))


def payload_entropy(packets: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Byte entropy of the flow's payload. A packet whose hex is not whole bytes makes it 0."""
    filled = packets.filter(F.coalesce("payload_hex", F.lit("")) != "").select(
        *FLOW_KEYS, "frame_no", whole_bytes(F.col("payload_hex")).alias("bytes"))
    entropy = byte_entropy(
        filled.filter("bytes is not null"), FLOW_KEYS, int_div(F.col("frame_no"), chunk_rows), "bytes", "entropy")
    spoiled = filled.filter("bytes is null").select(*FLOW_KEYS).distinct().withColumn("_void", F.lit(True))
    return entropy.join(spoiled, FLOW_KEYS, "left").select(
        *FLOW_KEYS, F.when(F.col("_void"), 0.0).otherwise(F.col("entropy")).alias("entropy"))


def dns_name_text(names: Column) -> Column:
    """Lower-cased labels of all names, joined without dots."""
    return F.lower(F.replace(F.array_join(names, ""), F.lit("."), F.lit("")))


def bigrams(text: Column) -> Column:
    """All pairs of neighbouring characters: the pairs from even places and those from odd places."""
    return F.concat(
        F.regexp_extract_all(text, F.lit("(?s)(..)")),
        F.regexp_extract_all(F.substring(text, F.lit(2), F.length(text)), F.lit("(?s)(..)")))


def dns_features(packets: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Bigram entropy of the queried names, and mean label length, per flow with DNS names."""
    named = packets.filter(F.size("dns_names") > 0).select(*FLOW_KEYS, "frame_no", "dns_names").withColumn(
        "text", dns_name_text(F.col("dns_names")))
    chunk = int_div(F.col("frame_no"), chunk_rows)
    last = F.max(F.when(F.col("text") != "", F.struct("frame_no", F.substring("text", -1, 1).alias("tail"))))
    staged = with_carry(
        named.withColumn("tail", F.when(F.col("text") != "", F.substring("text", -1, 1))), FLOW_KEYS, chunk,
        {"tail": last.getField("tail")},
        {"tail": lambda w: F.last("tail", ignorenulls=True).over(w)},
    )
    before = carry_first(FLOW_KEYS, "frame_no").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows_only(staged.withColumn("before", F.last("tail", ignorenulls=True).over(before))).withColumn(
        "run", F.when(F.col("text") != "", F.concat(F.coalesce("before", F.lit("")), "text")).otherwise(""))
    grams = token_entropy(joined.filter(F.length("run") >= 2), FLOW_KEYS, bigrams(F.col("run")), "ngram")
    labels = F.transform("dns_names", lambda n: F.length(F.replace(n, F.lit("."), F.lit("")))
                         / (F.length(n) - F.length(F.replace(n, F.lit("."), F.lit(""))) + 1))
    lengths = named.groupBy(*FLOW_KEYS).agg(
        F.sum(F.length("text")).alias("chars"),
        (F.sum(F.aggregate(labels, F.lit(0.0), lambda a, x: a + x)) / F.sum(F.size("dns_names"))).alias("dns_query_len"))
    return lengths.join(grams, FLOW_KEYS, "left").select(
        *FLOW_KEYS, F.when(F.col("chars") >= 3, F.col("ngram")).alias("dns_ngram_entropy"), "dns_query_len")


def modal_dns_type(packets: DataFrame) -> DataFrame:
    """Most frequent query type per flow; of equally frequent ones the first seen."""
    counted = packets.filter(F.coalesce("dns_type", F.lit("")) != "").groupBy(*FLOW_KEYS, "dns_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("frame_no").alias("first_frame"))
    best = F.max_by("dns_type", F.struct(F.col("n"), -F.col("first_frame")))
    return counted.groupBy(*FLOW_KEYS).agg(best.alias("dns_record_type"))


def window_fanout(totals: DataFrame) -> DataFrame:
    """Distinct (address, port) targets of each source in the window."""
    return totals.groupBy(*SOURCE_KEYS).agg(F.count_distinct("dst_ip", "dst_port").alias("window_fanout"))


def target_profile(totals: DataFrame, window_us: int = WINDOW_US) -> DataFrame:
    """Packet rate, SYN share and source entropy of each (address, port, protocol) target."""
    per_source = totals.groupBy(*TARGET_KEYS, "src_ip").agg(
        F.sum("n_packets").alias("c"), F.sum("syn_count").alias("syns"))
    summed = per_source.groupBy(*TARGET_KEYS).agg(
        F.sum("c").alias("n"), F.sum("syns").alias("syns"), F.sum(F.col("c") * F.log2("c")).alias("w"))
    return summed.select(
        *TARGET_KEYS,
        (F.col("n") / (window_us / 1e6)).alias("target_pkt_rate"),
        (F.col("syns") / F.col("n")).alias("target_syn_fraction"),
        entropy_from_counts(F.col("n"), F.col("w")).alias("src_ip_entropy"),
    )


def reverse_flows(totals: DataFrame) -> DataFrame:
    """Byte total and fingerprint of the opposite direction, keyed by the forward 5-tuple."""
    return totals.select(
        "capture_id", "bucket",
        F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"),
        F.col("src_ip").alias("dst_ip"), F.col("src_port").alias("dst_port"), "protocol",
        F.col("total_bytes").alias("reverse_bytes"), F.col("own_ja4").alias("reverse_ja4"))


def with_reverse(totals: DataFrame) -> DataFrame:
    """Kept flows with what the opposite direction of the same window contributes."""
    return totals.filter("n_sized > 0").join(reverse_flows(totals), FLOW_KEYS, "left").withColumn(
        "hello_ja4", F.coalesce("own_ja4", "reverse_ja4"))


def directional_bytes(flows: DataFrame, protected: Sequence[str]) -> DataFrame:
    """Outbound and inbound bytes; NULL means not observed, 0 means observed as zero."""
    way = direction(in_networks(F.col("src_ip"), protected), in_networks(F.col("dst_ip"), protected))
    return flows.withColumn("direction", way).withColumns({
        "outbound_bytes": F.when(F.col("direction") == "outbound", F.col("total_bytes"))
        .when(F.col("direction") == "inbound", F.col("reverse_bytes")),
        "inbound_bytes": F.when(F.col("direction") == "inbound", F.col("total_bytes"))
        .when(F.col("direction") == "outbound", F.col("reverse_bytes")),
    })


def arrivals(
    packets: DataFrame, *, window_us: int = WINDOW_US, cap: int | None = None, order: str = "frame_no",
    chunk_rows: int = CHUNK_ROWS, stage: Callable[[DataFrame], DataFrame] = staged,
) -> DataFrame:
    """The packets with the fate a live capture would give them in arrival order (see mark_fate), written once.

    ``build_flows`` takes the table as its packets and uses those that are kept; ``dashboard.packet_counters``
    counts the others from the same table. All branches then read a columnar table, not the source.
    """
    return stage(mark_fate(in_windows(packets, window_us), cap=cap, order=order, chunk_rows=chunk_rows))


def build_flows(
    packets: DataFrame, *,
    window_us: int = WINDOW_US,
    horizon_us: int = HORIZON_US,
    beacon_lookback_us: int = BEACON_LOOKBACK_US,
    beacon_arrivals: int = BEACON_ARRIVALS,
    protected: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
    history: DataFrame | None = None,
    late: str = "keep",
    stage: Callable[[DataFrame], DataFrame] = staged,
) -> DataFrame:
    """One row per (capture, window, 5-tuple) with every flow feature.

    The flow totals feed six branches, so they are staged once; only packet-level branches read
    the packets again, each with its own few columns.

    ``history`` holds earlier sightings (see sightings()) that the cross-window features may look
    back on; the streaming job passes it, batch jobs do not need it.

    With ``late="drop"`` packets of a window below one already seen in their capture's arrival order go first, as
    in a live capture. Packets that ``arrivals`` marked, by the same window length, are taken by their fate.
    """
    if late not in ("keep", "drop"):
        raise ValueError(f"late is keep or drop, not {late}")
    if late == "drop" and "fate" not in packets.columns:
        packets = arrivals(packets, window_us=window_us, chunk_rows=chunk_rows, stage=stage)
    if "fate" in packets.columns:
        packets = packets.filter(F.col("fate") == KEPT).drop("fate")
    windowed = in_windows(packets, window_us)
    totals = stage(packet_totals(windowed))
    kept = with_reverse(totals)
    seen = stage(sightings(kept))
    past = seen if history is None else seen.unionByName(history)
    beacons = beacon_intervals(past, lookback_us=beacon_lookback_us, keep=beacon_arrivals)
    fanout = horizon_fanout(past, horizon_us=horizon_us)
    prints = carried_ja4(past, horizon_us=horizon_us)

    rich = (
        kept.join(inter_arrivals(windowed, chunk_rows), FLOW_KEYS, "left")
        .join(payload_entropy(windowed, chunk_rows), FLOW_KEYS, "left")
        .join(dns_features(windowed, chunk_rows), FLOW_KEYS, "left")
        .join(modal_dns_type(windowed), FLOW_KEYS, "left")
        .join(prints, FLOW_KEYS, "left")
        .join(target_profile(totals, window_us), TARGET_KEYS, "left")
        .join(window_fanout(totals), SOURCE_KEYS, "left")
        .join(fanout, ["capture_id", "src_ip", "first_ts_us"], "left")
        .join(beacons, ["capture_id", "src_ip", "dst_ip", "dst_port", "protocol", "bucket"], "left")
    )
    return flow_record(directional_bytes(rich, protected), window_us)


def sightings(kept: DataFrame) -> DataFrame:
    """What the cross-window features remember of a flow: its keys, first packet and fingerprint."""
    return kept.select(*FLOW_KEYS, "first_frame", "first_ts_us", "hello_ja4")


def flow_record(rich: DataFrame, window_us: int) -> DataFrame:
    c = F.col
    span = window_us / 1e6
    return rich.select(
        "capture_id", "bucket", "src_ip", "dst_ip", "first_frame", c("first_ts_us").alias("ts_us"),
        flow_id(c("src_ip"), c("src_port"), c("dst_ip"), c("dst_port"), c("protocol"), c("bucket")).alias("flow_id"),
        F.timestamp_micros("first_ts_us").alias("timestamp"),
        "src_port", "dst_port", "protocol",
        F.struct(c("size_min").alias("min"), c("size_max").alias("max"), c("size_mean").alias("mean"),
                 c("size_std").alias("std")).alias("packet_size_stats"),
        F.struct(c("gap_mean").alias("mean"), c("gap_std").alias("std")).alias("inter_arrival_stats"),
        F.coalesce("entropy", F.lit(0.0)).alias("entropy"),
        F.least(F.lit(1.0), F.try_divide("payload_bytes", "total_bytes")).alias("byte_ratio"),
        "ttl", "ja4", "beacon_interval_stats", "dns_ngram_entropy",
        F.greatest("horizon_fanout", "window_fanout", F.lit(1).cast("bigint")).alias("fanout_count"),
        "outbound_bytes", "inbound_bytes",
        (c("n_packets") / span).alias("pkt_rate"), (c("total_bytes") / span).alias("byte_rate"),
        "syn_count", (c("syn_count") / c("n_packets")).alias("syn_fraction"),
        "target_pkt_rate", "target_syn_fraction", "src_ip_entropy", "dns_query_len", "dns_record_type",
    )
