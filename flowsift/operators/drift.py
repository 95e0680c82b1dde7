"""Distribution shift between a fixed reference and current scores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.constants import DRIFT_PSI, RETRAIN_MIN_ROWS, RETRAIN_PSI
from flowsift.functions.net import int_div
from flowsift.operators.ordered import CHUNK, CHUNK_ROWS, CONTEXT, rank_rows, running_sum, value_chunks, with_halo
from flowsift.operators.staging import staged


def _range(reference: DataFrame, value: str):
    row = reference.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    return (None, None, 0) if not row["n"] else (float(row["lo"]), float(row["hi"]), row["n"])


def bin_number(value, lo: float, hi: float, bins: int):
    """Equal-width bin of the reference range; values outside fall into the edge bins."""
    raw = F.floor((value - lo) / ((hi - lo) / bins))
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), raw)).cast("int")


def psi(reference: DataFrame, current: DataFrame, value: str = "score", bins: int = 10) -> DataFrame:
    """Population stability index: one row (psi). Both tables reduce to bin counts map-side."""
    spark = reference.sparkSession
    lo, hi, n_ref = _range(reference, value)
    if not n_ref or bins < 1:
        return spark.createDataFrame([(0.0,)], "psi double")
    if hi <= lo:
        near = F.abs(F.col(value) - lo) <= 1e-9 * F.greatest(F.abs(F.col(value)), F.lit(abs(lo)))
        return current.agg(F.when(F.coalesce(F.bool_and(near), F.lit(True)), 0.0).otherwise(math.inf).alias("psi"))

    def counts(df, name):
        return df.filter(F.col(value).isNotNull()).groupBy(
            bin_number(F.col(value).cast("double"), lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias(name))

    both = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(
        counts(reference, "b"), "bin", "left").join(counts(current, "c"), "bin", "left").na.fill(0, ["b", "c"])
    folded = both.agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"), F.collect_list(F.struct("b", "c")).alias("h"))
    return folded.select(F.when(F.col("nc") == 0, 0.0).otherwise(_psi_of(
        F.col("h"), F.col("nb"), F.col("nc"), bins)).alias("psi"))


def _psi_of(hist, nb, nc, bins: int):
    def term(acc, x):
        base = (x["b"] + 0.5) / (nb + 0.5 * bins)
        cur = (x["c"] + 0.5) / (nc + 0.5 * bins)
        return acc + (cur - base) * F.log(cur / base)
    return F.aggregate(hist, F.lit(0.0), term)


def ks(reference: DataFrame, current: DataFrame, value: str = "score") -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic: one row (ks).

    Values are counted per side, then both cumulative counts run along quantile-cut chunks of the
    value axis; equal values move together.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sides = reference.select(F.col(value).cast("double").alias("v"), one.alias("b"), zero.alias("c")).unionByName(
        current.select(F.col(value).cast("double").alias("v"), zero.alias("b"), one.alias("c"))).filter("v is not null")
    counted = staged(sides.groupBy("v").agg(F.sum("b").alias("b"), F.sum("c").alias("c")))
    n = counted.agg(F.sum("b").alias("b"), F.sum("c").alias("c")).first()
    if not n["b"] or not n["c"]:
        return reference.sparkSession.createDataFrame([(0.0,)], "ks double")
    steps = running_sum(counted, [], "v", ["b", "c"], value_chunks(counted, "v"))
    return steps.agg(F.max(F.abs(F.col("b") / n["b"] - F.col("c") / n["c"])).alias("ks"))


def rolling_drift(
    scores: DataFrame, reference: DataFrame, *, key: str = "stream", order: str = "seq", batch: str = "batch",
    value: str = "score", window: int, bins: int = 10, alarm: float = DRIFT_PSI,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """PSI of the last ``window`` scores at the end of each batch, per key.

    Rows are numbered per key first; the bounded window then only needs the rows just before a
    chunk, so a key is spread over many tasks.
    """
    lo, hi, n_ref = _range(reference, value)
    if not n_ref or hi <= lo:
        raise ValueError("the reference needs a spread of scores")
    binned = rank_rows(
        scores.select(key, order, batch, bin_number(F.col(value).cast("double"), lo, hi, bins).alias("bin")),
        [key], order, "nth", chunk_rows=chunk_rows)
    last = F.row_number().over(Window.partitionBy(key, CHUNK, batch).orderBy(F.col("nth").desc())) == 1
    halo = with_halo(binned, "nth", max(chunk_rows, window), window)
    recent = Window.partitionBy(key, CHUNK).orderBy("nth").rowsBetween(-(window - 1), 0)
    counted = halo.withColumns({
        f"c{i}": F.sum((F.col("bin") == i).cast("int")).over(recent) for i in range(bins)})
    ends = counted.filter(~F.col(CONTEXT)).groupBy(key, batch).agg(
        F.max_by(F.struct(*[f"c{i}" for i in range(bins)]), "nth").alias("c"))
    ref = reference.filter(F.col(value).isNotNull()).groupBy(
        bin_number(F.col(value).cast("double"), lo, hi, bins).alias("bin")).count().collect()
    base = {r["bin"]: r["count"] for r in ref}
    now = [F.col(f"c.c{i}") for i in range(bins)]
    total = sum(now[1:], now[0])
    hist = F.array(*[F.struct(F.lit(base.get(i, 0)).alias("b"), now[i].alias("c")) for i in range(bins)])
    rated = ends.select(key, batch, total.alias("n"), _psi_of(hist, F.lit(n_ref), total, bins).alias("psi"))
    return rated.withColumn("drifted", F.col("psi") > alarm)


def rolling_ks(
    scores: DataFrame, reference: DataFrame, *, key: str = "stream", order: str = "seq", batch: str = "batch",
    value: str = "score", window: int, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """KS statistic of the last ``window`` scores against the reference at the end of each batch, per key.

    Each distinct score gets its two ranks in the reference (below it, and up to it) from one sweep along the value
    axis in chunks. A batch's end meets the rows of its window by their row number div window, so at most two ranges of
    a key, and compares ranks inside at most ``window`` rows.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    sides = reference.select(F.col(value).cast("double").alias("v"), one.alias("b")).unionByName(
        scores.select(F.col(value).cast("double").alias("v"), zero.alias("b"))).filter("v is not null")
    counted = staged(sides.groupBy("v").agg(F.sum("b").alias("b")))
    n_ref = counted.agg(F.sum("b")).first()[0]
    if not n_ref:
        raise ValueError("the reference needs scores")
    swept = running_sum(counted.withColumn("upto", F.col("b")), [], "v", ["upto"], value_chunks(counted, "v"))
    ranks = swept.select("v", F.col("upto"), (F.col("upto") - F.col("b")).alias("below"))
    numbered = staged(rank_rows(
        scores.filter(F.col(value).isNotNull()).select(key, order, batch, F.col(value).cast("double").alias("v")), [key], order, "nth", chunk_rows=chunk_rows))
    ends = numbered.groupBy(F.col(key).alias("_key"), batch).agg(F.max("nth").alias("end")).withColumn(
        "range", F.explode(F.array_distinct(F.array(int_div(F.col("end") - window + 1, window), int_div(F.col("end"), window)))))
    rated = numbered.drop(batch).join(ranks, "v").withColumn("_range", int_div(F.col("nth"), window))
    inside = ends.join(rated, F.col("_key").eqNullSafe(F.col(key)) & (F.col("range") == F.col("_range")) & (
        F.col("nth") <= F.col("end")) & (F.col("nth") > F.col("end") - window))
    held = inside.groupBy(key, batch).agg(F.array_sort(F.collect_list(F.struct("v", "below", "upto"))).alias("h"))
    n = F.size("h")

    def distance(x, i):
        """Of the first row of equal scores just before it, of the last one at it; ties move together."""
        other = lambda at, there: F.when(there, F.get("h", at)["v"] == x["v"]).otherwise(False)
        before = F.when(~other(i - 1, i > 0), F.abs(x["below"] / F.lit(n_ref) - i / n))
        after = F.when(~other(i + 1, i < n - 1), F.abs(x["upto"] / F.lit(n_ref) - (i + 1) / n))
        return F.greatest(F.coalesce(before, F.lit(0.0)), F.coalesce(after, F.lit(0.0)))

    return held.select(key, batch, F.array_max(F.transform("h", distance)).alias("ks"))


def write_reference_once(scores: DataFrame, path: str) -> bool:
    """Store the reference distribution unless one exists: it is never replaced."""
    spark = scores.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return False
    scores.write.mode("errorifexists").parquet(path)
    return True


def newest(rows: DataFrame, order: str, keep: int, keys=()) -> DataFrame:
    """The newest ``keep`` rows (per key): what a bounded pool retains."""
    backwards = rows.withColumn("_back", -F.col(order))
    return rank_rows(backwards, list(keys), "_back", "_nth").filter(F.col("_nth") <= keep).drop("_back", "_nth")


def bounded_retrain(
    candidates: DataFrame, reference: DataFrame, reference_scores: DataFrame, *, version: int = 1,
    limit: float = RETRAIN_PSI, min_rows: int = RETRAIN_MIN_ROWS, max_rows: int | None = None, **fit_options,
):
    """Fit a candidate forest and accept it only if the reference scores barely move.

    All candidates are used. A caller who wants a bounded pool gives ``max_rows``: the rows whose flow_id has the
    smallest SHA-256, the same ones in every pass and run. Returns (result, model): result holds accepted, psi and reason; model is None on refusal.
    """
    from flowsift.operators.iforest import fit_forest, forest_layer

    pool = candidates
    if max_rows is not None:
        pool = staged(candidates.orderBy(F.sha2("flow_id", 256), *candidates.columns[:1]).limit(max_rows))
    have = pool.count()
    if have < min_rows:
        return {"accepted": False, "psi": None, "reason": "insufficient trusted samples"}, None
    if reference.isEmpty() or reference_scores.isEmpty():
        return {"accepted": False, "psi": None, "reason": "trusted fixed reference is missing"}, None
    model = fit_forest(pool, version=version, **fit_options)
    rescored = forest_layer(reference, model, version=version).select(F.col("isoforest.raw_score").alias("score"))
    shift = psi(reference_scores, rescored).first()["psi"]
    if not math.isfinite(shift) or shift > limit:
        return {"accepted": False, "psi": shift, "reason": "reference distribution moved too far"}, None
    return {"accepted": True, "psi": shift, "reason": "accepted"}, model
