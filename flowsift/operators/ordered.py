"""Ordered scans that stay parallel when one key holds most of the rows.

A plain window over (key) puts a whole key into one task. The helpers here split each key's
order into chunks, run the window inside (key, chunk), and bring across what a chunk needs from
before it: either one carried summary row (running totals, previous values), or the neighbouring
rows within a bounded look-back.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from flowsift.functions.net import int_div
from flowsift.operators.staging import staged

CHUNK = "_chunk"
CARRY = "_carry"
CONTEXT = "_context"
CHUNK_ROWS = 1 << 17


def with_carry(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    summary: Mapping[str, Column],
    carry: Mapping[str, Callable[[WindowSpec], Column]],
) -> DataFrame:
    """Rows of df plus, per (keys, chunk), one carry row that stands for all earlier chunks.

    ``summary`` aggregates a chunk (with map-side combine); ``carry`` turns the summaries of the
    earlier chunks into the carried columns, which share their names with columns of df. A running
    window over (keys, chunk) ordered by ``carry_first(...)`` then starts from the right state.
    """
    rows = df.withColumn(CHUNK, chunk)
    parts = rows.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in summary.items()])
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(
        *keys, CHUNK, *[f(before).alias(n) for n, f in carry.items()], F.lit(True).alias(CARRY))
    return rows.withColumn(CARRY, F.lit(False)).unionByName(carried, allowMissingColumns=True)


def carry_first(keys: Sequence[str], *order: Column | str) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(F.col(CARRY).desc(), *order)


def rows_only(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(CARRY)).drop(CARRY, CHUNK)


def rank_rows(
    df: DataFrame, keys: Sequence[str], order: str, out: str = "row_no", *,
    chunk: Column | None = None, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """1-based row number per key (no keys: over the whole table) by an integer order column."""
    chunk = chunk if chunk is not None else int_div(F.col(order), chunk_rows)
    staged = with_carry(
        df.withColumn(out, F.lit(1).cast("bigint")), keys, chunk,
        {out: F.sum(F.lit(1).cast("bigint"))},
        {out: lambda w: F.coalesce(F.sum(out).over(w), F.lit(0).cast("bigint"))},
    )
    running = carry_first(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows_only(staged.withColumn(out, F.sum(out).over(running)))


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str], chunk: Column,
) -> DataFrame:
    """Replace each value column by its inclusive running sum in key order."""
    staged = with_carry(
        df, keys, chunk,
        {v: F.sum(v) for v in values},
        {v: (lambda w, v=v: F.coalesce(F.sum(v).over(w), F.lit(0))) for v in values},
    )
    running = carry_first(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return rows_only(staged.withColumns({v: F.sum(v).over(running) for v in values}))


def value_chunks(df: DataFrame, value: str, parts: int | None = None) -> Column:
    """Chunk number of a numeric column, cut at approximate quantiles (one small aggregate).

    Without ``parts``, as many chunks as keep a chunk of df near CHUNK_ROWS rows, at least 64.
    """
    parts = parts or max(64, -(-df.count() // CHUNK_ROWS))
    shares = [i / parts for i in range(1, parts)]
    cuts = df.agg(F.percentile_approx(value, shares, max(10_000, 10 * parts)).alias("cuts")).first()["cuts"] or []
    bounds = sorted({float(c) for c in cuts if c is not None})
    if not bounds:
        return F.lit(0).cast("bigint")
    literal = F.array(*[F.lit(b) for b in bounds])
    return F.size(F.filter(literal, lambda b: b <= F.col(value))).cast("bigint")


def with_halo(df: DataFrame, order: str, width: int, reach: int, context: Column | None = None) -> DataFrame:
    """Give each row to its own chunk and, as context, to the next chunk when within reach of it.

    Needs width >= reach, so a look-back never passes the previous chunk. ``context`` limits which
    rows may serve as context.
    """
    if width < reach:
        raise ValueError("chunk width must not be below the look-back reach")
    own = int_div(F.col(order), width)
    near = (own + 1) * F.lit(width).cast("bigint") - F.col(order) <= F.lit(reach).cast("bigint")
    if context is not None:
        near = near & context
    spread = df.withColumn("_own", own).withColumn(
        CHUNK, F.explode(F.when(near, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array("_own"))))
    return spread.withColumn(CONTEXT, F.col(CHUNK) != F.col("_own")).drop("_own")


def exact_quantiles(df: DataFrame, value: str, fractions: Sequence[float]) -> list[float]:
    """Exact linear-interpolation quantiles of a column, without gathering it in one task.

    Values are counted first, ranked in quantile-cut chunks, and only the rows that hold a wanted
    rank come back.
    """
    counted = staged(df.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("upto")))
    total = counted.agg(F.sum("upto")).first()[0]
    if not total:
        raise ValueError("no values")
    ranked = running_sum(
        counted.withColumn("n", F.col("upto")), [], "v", ["upto"], value_chunks(counted, "v"))
    spots = [f * (total - 1) for f in fractions]
    wanted = sorted({r for s in spots for r in (int(s), min(int(s) + 1, total - 1))})
    hits = ranked.withColumn("from", F.col("upto") - F.col("n")).withColumn(
        "hit", F.filter(F.array(*[F.lit(r).cast("bigint") for r in wanted]),
                        lambda r: (r >= F.col("from")) & (r < F.col("upto"))))
    at = {r: row["v"] for row in hits.filter(F.size("hit") > 0).select("v", "hit").collect() for r in row["hit"]}
    out = []
    for s in spots:
        low = int(s)
        high = min(low + 1, total - 1)
        out.append(at[low] + (at[high] - at[low]) * (s - low))
    return out
