"""Features that look across windows, as ordered scans over flow sightings.

A sighting is one kept flow: capture_id, bucket, 5-tuple, first_frame, first_ts_us, hello_ja4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.constants import BEACON_LOOKBACK_US, HORIZON_US
from flowsift.functions.net import int_div
from flowsift.operators.ordered import (
    CHUNK, CHUNK_ROWS, CONTEXT, carry_first, rank_rows, rows_only, running_sum, with_carry, with_halo)

PAIR = ["capture_id", "src_ip", "dst_ip", "dst_port", "protocol"]
FLOW = ["capture_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol"]


def beacon_intervals(
    sightings: DataFrame, *, lookback_us: int = BEACON_LOOKBACK_US, keep: int | None = None,
    chunk_us: int | None = None,
) -> DataFrame:
    """Mean and deviation of callback gaps per (pair, window); NULL below four arrivals.

    One arrival per window; the arrivals no older than the look-back count, or the last ``keep`` of them if given. Because
    the look-back is bounded, a chunk of time only needs the arrivals just before it.
    """
    arrivals = sightings.groupBy(*PAIR, "bucket").agg(
        F.min_by("first_ts_us", "first_frame").alias("ts"))
    spread = with_halo(arrivals, "ts", chunk_us or 4 * lookback_us, lookback_us)
    recent_rows = Window.partitionBy(*PAIR, CHUNK).orderBy("ts", "bucket").rowsBetween(Window.unboundedPreceding if keep is None else -(keep - 1), 0)
    listed = spread.withColumn("times", F.collect_list("ts").over(recent_rows)).filter(~F.col(CONTEXT))
    recent = listed.withColumn("times", F.filter("times", lambda t: t >= F.col("ts") - F.lit(lookback_us)))
    n = F.size("times")
    gaps = F.when(n >= 4, F.zip_with(
        F.slice("times", 2, n - 1), F.slice("times", F.lit(1), n - 1), lambda b, a: (b - a) / 1e6))
    measured = recent.withColumn("gaps", F.filter(gaps, lambda g: g > 0))
    k = F.size("gaps")
    mean = F.aggregate("gaps", F.lit(0.0), lambda a, g: a + g) / k
    with_mean = measured.withColumn("mean", F.when(k >= 3, mean))
    std = F.sqrt(F.aggregate("gaps", F.lit(0.0), lambda a, g: a + F.pow(g - F.col("mean"), 2)) / (k - 1))
    return with_mean.select(
        *PAIR, "bucket",
        F.when(F.col("mean").isNotNull(), F.struct(F.col("mean"), std.alias("std"))).alias("beacon_interval_stats"))


def horizon_fanout(sightings: DataFrame, *, horizon_us: int = HORIZON_US, chunk_us: int | None = None) -> DataFrame:
    """Distinct targets of a source seen within the horizon, at each sighting time of the source.

    Sweep line. Sightings of a target are first folded into horizon-wide slots (at most one row
    per target and slot), slots at most a horizon apart join into one presence interval, and the
    intervals' ends are summed along the source's time axis in chunks.
    """
    target = ["capture_id", "src_ip", "dst_ip", "dst_port"]
    slots = sightings.groupBy(*target, int_div(F.col("first_ts_us"), horizon_us).alias("slot")).agg(
        F.min("first_ts_us").alias("start"), F.max("first_ts_us").alias("stop"))
    along = Window.partitionBy(*target).orderBy("slot")
    ends = slots.withColumns({
        "opens": F.coalesce(F.col("start") - F.lag("stop").over(along) > horizon_us, F.lit(True)),
        "closes": F.coalesce(F.lead("start").over(along) - F.col("stop") > horizon_us, F.lit(True)),
    }).select("capture_id", "src_ip", F.explode(F.array_compact(F.array(
        F.when(F.col("opens"), F.struct(F.col("start").alias("t"), F.lit(1).cast("bigint").alias("d"))),
        F.when(F.col("closes"), F.struct((F.col("stop") + horizon_us + 1).alias("t"), F.lit(-1).cast("bigint").alias("d"))),
    ))).alias("e")).select("capture_id", "src_ip", "e.t", "e.d", F.lit(False).alias("asked"))
    asked = sightings.select(
        "capture_id", "src_ip", F.col("first_ts_us").alias("t"), F.lit(0).cast("bigint").alias("d"),
        F.lit(True).alias("asked"))
    steps = ends.unionByName(asked).groupBy("capture_id", "src_ip", "t").agg(
        F.sum("d").alias("d"), F.max("asked").alias("asked"))
    swept = running_sum(steps, ["capture_id", "src_ip"], "t", ["d"], int_div(F.col("t"), chunk_us or horizon_us))
    return swept.filter("asked").select(
        "capture_id", "src_ip", F.col("t").alias("first_ts_us"), F.col("d").alias("horizon_fanout"))


def carried_ja4(sightings: DataFrame, *, horizon_us: int = HORIZON_US, chunk_us: int | None = None) -> DataFrame:
    """The flow's fingerprint, else the last one of the same 5-tuple if no older than the horizon."""
    spread = with_halo(
        sightings.select(*FLOW, "bucket", "first_ts_us", "hello_ja4"), "first_ts_us",
        chunk_us or 8 * horizon_us, horizon_us, context=F.col("hello_ja4").isNotNull())
    upto = Window.partitionBy(*FLOW, CHUNK).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    hello = F.when(F.col("hello_ja4").isNotNull(), F.struct("first_ts_us", "hello_ja4"))
    aged = spread.withColumn("_last", F.last(hello, ignorenulls=True).over(upto)).filter(~F.col(CONTEXT))
    age = F.col("first_ts_us") - F.col("_last.first_ts_us")
    return aged.select(
        *FLOW, "bucket", F.when((age >= 0) & (age <= horizon_us), F.col("_last.hello_ja4")).alias("ja4"))


def mark_late(packets: DataFrame, *, order: str = "frame_no", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add is_late: the packet's window lies below one already seen in arrival order."""
    staged = with_carry(
        packets, ["capture_id"], int_div(F.col(order), chunk_rows),
        {"_top": F.max("bucket")}, {"bucket": lambda w: F.max("_top").over(w)})
    earlier = carry_first(["capture_id"], order).rowsBetween(Window.unboundedPreceding, -1)
    late = F.coalesce(F.col("bucket") < F.max("bucket").over(earlier), F.lit(False))
    return rows_only(staged.withColumn("is_late", late))


def drop_late(packets: DataFrame, **options) -> DataFrame:
    return mark_late(packets, **options).filter("not is_late").drop("is_late")


def mark_over_cap(
    packets: DataFrame, cap: int, *, order: str = "frame_no", chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add over_cap: the packet is beyond the first ``cap`` of its window."""
    ranked = rank_rows(packets, ["capture_id", "bucket"], order, "_nth", chunk_rows=chunk_rows)
    return ranked.withColumn("over_cap", F.col("_nth") > cap).drop("_nth")


KEPT, LATE, OVER_CAP, UNTIMED = "kept", "late", "dropped", "untimed"


def mark_fate(
    packets: DataFrame, *, cap: int | None = None, order: str = "frame_no", chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add fate: late (mark_late), dropped (beyond the first ``cap`` of its window that are in time), untimed, or kept."""
    marked = mark_late(packets, order=order, chunk_rows=chunk_rows)
    beyond = F.lit(False)
    if cap is not None:
        marked = rank_rows(marked, ["capture_id", "bucket", "is_late"], order, "_nth", chunk_rows=chunk_rows)
        beyond = F.col("_nth") > cap
    return marked.withColumn(
        "fate", F.when(F.col("bucket").isNull(), UNTIMED).when(F.col("is_late"), LATE).when(beyond, OVER_CAP).otherwise(KEPT)
    ).drop("is_late", "_nth")
