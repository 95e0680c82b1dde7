"""Packets of closed capture windows, from a live packet stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import BooleanType, StructField, StructType

from flowsift.constants import WINDOW_US
from flowsift.functions.net import int_div

TUPLE = ["capture_id", "src_ip", "src_port", "dst_ip", "dst_port", "protocol"]
CLOCK_DDL = "clock string, reached bigint"
CLOCKS = ("stream", "capture")


def _store(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def stream_closed_windows(
    packets: DataFrame, folder: str, closed: Callable[[DataFrame, int, dict[str, int]], None], *,
    window_us: int = WINDOW_US, lateness: str = "0 seconds", clock: str = "stream", **trigger,
) -> StreamingQuery:
    """Hand the packets of each window to ``closed(packets, batch_id, counts)`` once, when its clock has passed it.

    ``clock`` says whose packets close a window and judge lateness: those of its own capture ("capture"), or those
    of any capture ("stream"). A packet is late if the clock had passed its window, less ``lateness``, by the end of
    an earlier micro-batch. ``counts`` are the batch's packets_read, late_packets and packets_dropped (packets
    without a time belong to no window); packets that are neither late nor dropped are kept until their window
    closes. ``closed`` is called for each batch, also without closed windows.

    Below ``folder``: state (open packets and clocks of the last two batches) and checkpoint. A repeated batch
    reads the state of the batch before it and overwrites its own.
    """
    if clock not in CLOCKS:
        raise ValueError(f"clock must be one of {CLOCKS}")
    schema = StructType(list(packets.schema.fields) + [StructField("closed", BooleanType())])
    slack = packets.sparkSession.range(1).select(
        F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL '{lateness}')")).first()[0]
    name = F.col("capture_id") if clock == "capture" else F.lit("")
    bucket = int_div(F.col("ts_us"), window_us)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        state = lambda n: f"{folder}/state/{n}"
        before, now = state(batch_id - 1), state(batch_id)
        if batch_id:
            path, store = _store(spark, f"{before}/clocks")
            if not store.exists(path):
                raise RuntimeError(f"{before} is missing: the checkpoint is not of this job")
            clocks = spark.read.schema(CLOCK_DDL).parquet(f"{before}/clocks")
            waiting = spark.read.schema(schema).parquet(f"{before}/packets").filter("not closed").drop("closed")
        else:
            clocks = spark.createDataFrame([], CLOCK_DDL)
            waiting = spark.createDataFrame([], packets.schema)
        batch.write.mode("overwrite").parquet(f"{now}/read")
        read = spark.read.schema(packets.schema).parquet(f"{now}/read")
        judged = _by_clock(read, clocks, name).withColumn("_late", F.coalesce(bucket < F.col("reached"), F.lit(False)))
        counts = judged.agg(
            F.count(F.lit(1)).alias("packets_read"), F.count_if("_late").alias("late_packets"),
            F.count_if(F.col("ts_us").isNull()).alias("packets_dropped")).first().asDict()
        seen = read.groupBy(name.cast("string").alias("clock")).agg(F.max(int_div(F.col("ts_us") - slack, window_us)).alias("reached"))
        clocks.unionByName(seen).groupBy("clock").agg(F.max("reached").alias("reached")).write.mode("overwrite").parquet(f"{now}/clocks")
        on_time = judged.filter(~F.col("_late") & F.col("ts_us").isNotNull()).select(*packets.columns)
        _by_clock(waiting.unionByName(on_time), spark.read.schema(CLOCK_DDL).parquet(f"{now}/clocks"), name).withColumn(
            "closed", F.coalesce(bucket < F.col("reached"), F.lit(False))).select(*packets.columns, "closed").write.mode(
            "overwrite").partitionBy("closed").parquet(f"{now}/packets")
        closed(spark.read.schema(schema).parquet(f"{now}/packets").filter("closed").drop("closed"), batch_id, counts)
        for done in (f"{now}/read", state(batch_id - 2)):
            path, store = _store(spark, done)
            store.delete(path, True)

    return packets.writeStream.foreachBatch(process).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        **(trigger or {"availableNow": True})).start()


def _by_clock(packets: DataFrame, clocks: DataFrame, name: Column) -> DataFrame:
    """Packets with the last window their clock has reached, null before its first."""
    known = clocks.withColumnsRenamed({"clock": "_clock"})
    return packets.join(known, name.cast("string").eqNullSafe(F.col("_clock")), "left")


def stream_totals(packets: DataFrame, *, window_us: int = WINDOW_US, lateness: str = "0 seconds") -> DataFrame:
    """Stream of flows (first packet, own fingerprint, whether it is kept) as windows close.

    Spark's watermark is one clock for all captures.
    """
    timed = packets.withColumn("ts", F.timestamp_micros("ts_us")).withWatermark("ts", lateness)
    hello = F.max(F.when(F.col("ja4").isNotNull(), F.struct("frame_no", "ja4"))).getField("ja4")
    first = F.min(F.struct("frame_no", "ts_us"))
    return timed.groupBy(F.window("ts", f"{window_us} microseconds"), *TUPLE).agg(
        first.alias("f"), F.max("frame_len").alias("largest"), hello.alias("own_ja4"),
    ).select(
        "window", *TUPLE, F.expr(f"unix_micros(window.start) div {window_us}").alias("bucket"),
        F.col("f.frame_no").alias("first_frame"), F.col("f.ts_us").alias("first_ts_us"), "own_ja4",
        F.coalesce(F.col("largest") > 0, F.lit(False)).alias("is_kept"))


def stream_sightings(packets: DataFrame, *, window_us: int = WINDOW_US, lateness: str = "0 seconds") -> DataFrame:
    """Stream of flow sightings (kept flows, first packet, own fingerprint) as windows close."""
    totals = stream_totals(packets, window_us=window_us, lateness=lateness)
    return totals.filter("is_kept").drop("is_kept").withColumnRenamed("own_ja4", "hello_ja4")
