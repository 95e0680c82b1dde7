"""Cross-window features as keyed streaming state.

The same results as the batch scans. ``beacon_stream``, ``fanout_stream`` and ``fingerprint_stream`` suit moderate
keys: all rows that a micro-batch has of a key meet in one frame. For hot keys there are ``arrival_stream`` before
``beacon_stream`` (one row a series and window), ``stream_fanout`` (a source's targets dealt to parts, their comings
and goings summed in chunks of time) and ``endpoint_fingerprint_stream`` (at most two rows a connection and window).

State ends by event time: an arrival, a target or a fingerprint is dropped when the watermark has passed its horizon.
``bounded_fanout_stream`` also bounds the targets of a source, and tells each one that it evicts.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from statistics import fmean, stdev

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructType

from flowsift.constants import BEACON_ARRIVALS, BEACON_LOOKBACK_US, HORIZON_US, WINDOW_US
from flowsift.functions.net import int_div
from flowsift.operators.ordered import running_sum

FLOW = ["src_port", "first_frame", "first_ts_us", "hello_ja4"]


def _closed_ms(us: int, window_us: int) -> int:
    """When the watermark has passed the window that ``us`` falls in, in whole milliseconds.

    State must last until then: a sighting within the horizon is handed over only when its own window closes.
    """
    return -(-(us // window_us + 1) * window_us // 1000)


def _ordered(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """All rows of a key in this micro-batch: only windows that just closed, in frame order."""
    return pd.concat(list(rows)).sort_values(["bucket", "first_frame"], kind="stable")


class BeaconState(StatefulProcessor):
    """Arrivals of one (source, target, protocol) series: at most ``keep`` timestamps."""

    def __init__(self, lookback_us: int, keep: int, window_us: int):
        self.lookback_us, self.keep, self.window_us = lookback_us, keep, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.arrivals = handle.getListState("arrivals", StructType().add("bucket", LongType()).add("ts", LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = [(int(b), int(t)) for b, t in self.arrivals.get()] if self.arrivals.exists() else []
        out = []
        for row in _ordered(rows).itertuples(index=False):
            if not seen or seen[-1][0] != row.bucket:
                seen = (seen + [(int(row.bucket), int(row.first_ts_us))])[-self.keep:]
            recent = [t for _, t in seen if t >= seen[-1][1] - self.lookback_us]
            gaps = [(b - a) / 1e6 for a, b in zip(recent, recent[1:]) if b > a]
            known = len(recent) >= 4 and len(gaps) >= 3
            out.append((*key, row.bucket, fmean(gaps) if known else None, stdev(gaps) if known else None))
        newest = seen[-1][1]
        kept = [s for s in seen if s[1] >= newest - self.lookback_us]
        self.arrivals.put(kept)
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(_closed_ms(newest + self.lookback_us, self.window_us))
        yield pd.DataFrame(out, columns=["capture_id", "src_ip", "dst_ip", "dst_port", "protocol", "bucket", "beacon_mean", "beacon_std"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends = _closed_ms(max(int(t) for _, t in self.arrivals.get()) + self.lookback_us, self.window_us)
        if ends <= timerValues.getCurrentWatermarkInMs():
            self.arrivals.clear()
        else:  # arrivals have come since the timer was set
            self.handle.registerTimer(ends)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class FanoutState(StatefulProcessor):
    """Last sighting of each target of one source."""

    def __init__(self, horizon_us: int, window_us: int):
        self.horizon_us, self.window_us = horizon_us, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        target = StructType().add("dst_ip", StringType()).add("dst_port", LongType())
        self.targets = handle.getMapState("targets", target, StructType().add("seen", LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows)).sort_values("first_ts_us", kind="stable")
        seen = {tuple(k): int(v[0]) for k, v in self.targets.iterator()}
        before = set(seen)
        out = []
        for ts, group in rows.groupby("first_ts_us", sort=True):
            for row in group.itertuples(index=False):
                seen[(row.dst_ip, int(row.dst_port))] = int(ts)
            seen = {k: v for k, v in seen.items() if v >= ts - self.horizon_us}
            out.append((*key, int(ts), len(seen)))
        for gone in before - set(seen):
            self.targets.removeKey(gone)
        for target, ts in seen.items():
            self.targets.updateValue(target, (ts,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(_closed_ms(out[-1][-2] + self.horizon_us, self.window_us))
        yield pd.DataFrame(out, columns=["capture_id", "src_ip", "first_ts_us", "horizon_fanout"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.targets.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class FingerprintState(StatefulProcessor):
    """Last fingerprint of one 5-tuple and when its hello was seen."""

    def __init__(self, horizon_us: int, window_us: int):
        self.horizon_us, self.window_us = horizon_us, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", StructType().add("ts", LongType()).add("ja4", StringType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.last.get() if self.last.exists() else None
        out = []
        for row in _ordered(rows).itertuples(index=False):
            if isinstance(row.hello_ja4, str):
                held = (int(row.first_ts_us), row.hello_ja4)
            fresh = held is not None and 0 <= row.first_ts_us - held[0] <= self.horizon_us
            out.append((*key, row.bucket, held[1] if fresh else None))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held is not None:
            self.last.update((int(held[0]), held[1]))
            self.handle.registerTimer(_closed_ms(int(held[0]) + self.horizon_us, self.window_us))
        yield pd.DataFrame(out, columns=["capture_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "bucket", "ja4"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def beacon_stream(
    sightings: DataFrame, *, lookback_us: int = BEACON_LOOKBACK_US, keep: int = BEACON_ARRIVALS, window_us: int = WINDOW_US,
) -> DataFrame:
    return sightings.groupBy("capture_id", "src_ip", "dst_ip", "dst_port", "protocol").transformWithStateInPandas(
        BeaconState(lookback_us, keep, window_us),
        "capture_id string, src_ip string, dst_ip string, dst_port int, protocol string, bucket bigint, "
        "beacon_mean double, beacon_std double", "Append", "EventTime")


def fanout_stream(sightings: DataFrame, *, horizon_us: int = HORIZON_US, window_us: int = WINDOW_US) -> DataFrame:
    return sightings.groupBy("capture_id", "src_ip").transformWithStateInPandas(
        FanoutState(horizon_us, window_us), "capture_id string, src_ip string, first_ts_us bigint, horizon_fanout bigint",
        "Append", "EventTime")


def fingerprint_stream(sightings: DataFrame, *, horizon_us: int = HORIZON_US, window_us: int = WINDOW_US) -> DataFrame:
    return sightings.groupBy("capture_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol").transformWithStateInPandas(
        FingerprintState(horizon_us, window_us),
        "capture_id string, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, bucket bigint, ja4 string",
        "Append", "EventTime")


# ---- hot keys ----

PAIR = ["capture_id", "src_ip", "dst_ip", "dst_port", "protocol"]
SOURCE = ["capture_id", "src_ip"]
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Inside, streams that start keep their state in RocksDB, which keyed state needs, in so many partitions.

    The number of partitions stays with a checkpoint, so it is worth choosing for the largest load.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKS}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def arrival_stream(sightings: DataFrame) -> DataFrame:
    """The first sighting of each series (source, target, protocol) in each window, combined before the shuffle."""
    first = F.min(F.struct("first_frame", "first_ts_us", "bucket"))
    return sightings.groupBy("window", *PAIR).agg(first.alias("f")).select("window", *PAIR, "f.bucket", "f.first_frame", "f.first_ts_us")


class PresenceState(StatefulProcessor):
    """Targets of one part of a source: when each was seen last.

    Gives +1 where a target comes into the horizon, -1 where it leaves it, and the times that are asked for. A leaving
    is told once the window it falls in has closed, like the sightings of that window.
    """

    COLUMNS = [*SOURCE, "t", "d", "asked"]

    def __init__(self, horizon_us: int, window_us: int):
        self.horizon_us, self.window_us = horizon_us, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        target = StructType().add("dst_ip", StringType()).add("dst_port", LongType())
        self.targets = handle.getMapState("targets", target, StructType().add("seen", LongType()))

    def _leaves(self, seen: int) -> int:
        return seen + self.horizon_us + 1

    def _told_ms(self, seen: int) -> int:
        return _closed_ms(self._leaves(seen), self.window_us)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out, held = [], {}
        for row in pd.concat(list(rows)).sort_values("first_ts_us", kind="stable").itertuples(index=False):
            target, ts = (row.dst_ip, int(row.dst_port)), int(row.first_ts_us)
            seen = held.get(target)
            if seen is None and self.targets.exists() and self.targets.containsKey(target):
                seen = int(self.targets.getValue(target)[0])
            if seen is None or self._leaves(seen) <= ts:
                if seen is not None:
                    out.append((*key[:2], self._leaves(seen), -1, False))
                out.append((*key[:2], ts, 1, False))
            out.append((*key[:2], ts, 0, True))
            held[target] = ts
        for target, ts in held.items():
            self.targets.updateValue(target, (ts,))
        if not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(self._told_ms(min(held.values())))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        out, next_ms = [], None
        for target, value in list(self.targets.iterator()):
            seen = int(value[0])
            if self._told_ms(seen) <= now:
                out.append((*key[:2], self._leaves(seen), -1, False))
                self.targets.removeKey(tuple(target))
            else:
                next_ms = min(next_ms or self._told_ms(seen), self._told_ms(seen))
        if next_ms is not None:
            self.handle.registerTimer(next_ms)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


def presence_stream(sightings: DataFrame, *, horizon_us: int = HORIZON_US, window_us: int = WINDOW_US, parts: int = 16) -> DataFrame:
    """Level one: changes of presence, by (source, part of its targets)."""
    part = F.pmod(F.xxhash64("dst_ip", "dst_port"), F.lit(parts)).cast("int")
    return sightings.withColumn("part", part).groupBy(*SOURCE, "part").transformWithStateInPandas(
        PresenceState(horizon_us, window_us), "capture_id string, src_ip string, t bigint, d bigint, asked boolean", "Append", "EventTime")


TOTALS_DDL = "capture_id string, src_ip string, d bigint"


def stream_fanout(
    sightings: DataFrame, folder: str, *, horizon_us: int = HORIZON_US, window_us: int = WINDOW_US, parts: int = 16, **trigger,
) -> StreamingQuery:
    """Distinct targets of a source within the horizon, at each sighting time: (capture_id, src_ip, first_ts_us, horizon_fanout).

    Level two sums the changes of all parts of a source along time, in chunks of a horizon, from the total that the
    micro-batch before left; sources without a present target have no total. Below ``folder``: fanout (a folder a
    batch), state (totals of the last two batches), checkpoint. A repeated batch overwrites its own.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = lambda n: f"{folder}/state/{n}"
        batch.groupBy(*SOURCE, "t").agg(F.sum("d").alias("d"), F.max("asked").alias("asked")).write.mode("overwrite").parquet(f"{state(batch_id)}/steps")
        steps = spark.read.schema("capture_id string, src_ip string, t bigint, d bigint, asked boolean").parquet(f"{state(batch_id)}/steps")
        held = spark.read.schema(TOTALS_DDL).parquet(f"{state(batch_id - 1)}/totals") if batch_id else spark.createDataFrame([], TOTALS_DDL)
        carried = held.select(*SOURCE, F.lit(-1).cast("bigint").alias("t"), "d", F.lit(False).alias("asked"))
        swept = running_sum(steps.unionByName(carried), SOURCE, "t", ["d"], int_div(F.col("t"), horizon_us))
        swept.filter("asked").select(*SOURCE, F.col("t").alias("first_ts_us"), F.col("d").alias("horizon_fanout")).write.mode(
            "overwrite").parquet(f"{folder}/fanout/batch={batch_id}")
        held.unionByName(steps.select(*SOURCE, "d")).groupBy(*SOURCE).agg(F.sum("d").alias("d")).filter("d <> 0").write.mode(
            "overwrite").parquet(f"{state(batch_id)}/totals")
        old = spark._jvm.org.apache.hadoop.fs.Path(state(batch_id - 2))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    changes = presence_stream(sightings, horizon_us=horizon_us, window_us=window_us, parts=parts)
    return changes.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        **(trigger or {"availableNow": True})).start()


class EndpointFingerprintState(StatefulProcessor):
    """Last fingerprint of each direction of one connection; a flow without one takes its window's other direction's."""

    def __init__(self, horizon_us: int, window_us: int):
        self.horizon_us, self.window_us = horizon_us, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getMapState("last", StructType().add("forth", LongType()), StructType().add("ts", LongType()).add("ja4", StringType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        capture, low_ip, low_port, high_ip, high_port, protocol = key
        held = {int(k[0]): (int(v[0]), v[1]) for k, v in self.last.iterator()} if self.last.exists() else {}
        out = []
        for bucket, both in _ordered(rows).groupby("bucket", sort=True):
            own = {int(r.forth): r.own_ja4 for r in both.itertuples(index=False) if isinstance(r.own_ja4, str)}
            for r in both.itertuples(index=False):
                forth = int(r.forth)
                hello = own.get(forth, own.get(1 - forth) if low_ip != high_ip or low_port != high_port else None)
                if not r.is_kept:
                    continue
                ts = int(r.first_ts_us)
                if hello is not None:
                    held[forth] = (ts, hello)
                known = held.get(forth)
                fresh = known is not None and 0 <= ts - known[0] <= self.horizon_us
                ends = (low_ip, low_port, high_ip, high_port) if forth else (high_ip, high_port, low_ip, low_port)
                out.append((capture, *ends, protocol, int(bucket), known[1] if fresh else None))
        for forth, (ts, ja4) in held.items():
            self.last.updateValue((forth,), (ts, ja4))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if held:
            self.handle.registerTimer(_closed_ms(max(ts for ts, _ in held.values()) + self.horizon_us, self.window_us))
        yield pd.DataFrame(out, columns=["capture_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "bucket", "ja4"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def endpoint_fingerprint_stream(flows: DataFrame, *, horizon_us: int = HORIZON_US, window_us: int = WINDOW_US) -> DataFrame:
    """``carried_ja4`` of a stream of ``stream_totals``: both directions of a connection are one key."""
    source, target = (F.struct(F.col(f"{side}_ip").alias("ip"), F.col(f"{side}_port").alias("port")) for side in ("src", "dst"))
    low, high = F.least(source, target), F.greatest(source, target)
    keyed = flows.withColumns({
        "low_ip": low["ip"], "low_port": low["port"], "high_ip": high["ip"], "high_port": high["port"],
        "forth": (source <= target).cast("bigint")})
    return keyed.groupBy("capture_id", "low_ip", "low_port", "high_ip", "high_port", "protocol").transformWithStateInPandas(
        EndpointFingerprintState(horizon_us, window_us),
        "capture_id string, src_ip string, src_port int, dst_ip string, dst_port int, protocol string, bucket bigint, ja4 string",
        "Append", "EventTime")


class BoundedTargetsState(StatefulProcessor):
    """At most ``most`` targets of a source, the most recently seen ones within the horizon.

    Each sighting gives the number held after it and the target evicted for it, if any: the one seen longest ago (of
    equal times the one that came first).
    """

    COLUMNS = [*SOURCE, "first_ts_us", "first_frame", "held", "evicted"]

    def __init__(self, horizon_us: int, most: int, window_us: int):
        self.horizon_us, self.most, self.window_us = horizon_us, most, window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        seen = StructType().add("dst_ip", StringType()).add("dst_port", LongType()).add("seen", LongType())
        self.targets = handle.getListState("targets", seen)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {(ip, int(port)): int(ts) for ip, port, ts in self.targets.get()} if self.targets.exists() else {}
        out = []
        for row in pd.concat(list(rows)).sort_values(["first_ts_us", "first_frame"], kind="stable").itertuples(index=False):
            ts = int(row.first_ts_us)
            held.pop((row.dst_ip, int(row.dst_port)), None)
            held[(row.dst_ip, int(row.dst_port))] = ts  # the order of the dictionary is the order of use
            while held[oldest := next(iter(held))] < ts - self.horizon_us:
                del held[oldest]
            gone = None
            if len(held) > self.most:
                gone = next(iter(held))
                del held[gone]
            out.append((*key, ts, int(row.first_frame), len(held), None if gone is None else f"{gone[0]}:{gone[1]}"))
        self.targets.put([(ip, port, ts) for (ip, port), ts in held.items()])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(_closed_ms(max(held.values()) + self.horizon_us, self.window_us))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.targets.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def bounded_fanout_stream(sightings: DataFrame, most: int, *, horizon_us: int = HORIZON_US, window_us: int = WINDOW_US) -> DataFrame:
    """(capture_id, src_ip, first_ts_us, first_frame, held, evicted) of each sighting, state bounded by ``most`` a source."""
    return sightings.groupBy(*SOURCE).transformWithStateInPandas(
        BoundedTargetsState(horizon_us, most, window_us),
        "capture_id string, src_ip string, first_ts_us bigint, first_frame bigint, held bigint, evicted string", "Append", "EventTime")
