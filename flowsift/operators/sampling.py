"""Row sampling and replication with reproducible results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.operators.ordered import rank_rows


def stride_sample(rows: DataFrame, order: str, target: int) -> DataFrame:
    """Rows at positions int(i * n / target), i = 0 .. target-1, along an integer order column.

    Position r is drawn iff some i falls into [r*target/n, (r+1)*target/n); with target < n that
    is a test on the row itself, so no list of positions is joined.
    """
    n = rows.count()
    if n == 0 or target <= 0:
        return rows.limit(0)
    if n <= target:
        return rows
    ranked = rank_rows(rows, [], order, "_nth")
    position = F.col("_nth") - 1
    step = n / float(target)
    # The candidate i for position r is ceil(r / step), give or take rounding; int(i*step) = r decides.
    guess = F.ceil(position / F.lit(step))
    drawn = F.exists(
        F.array(guess - 1, guess, guess + 1),
        lambda i: (i >= 0) & (i < target) & (F.floor(i * F.lit(step)) == position))
    return ranked.filter(drawn).drop("_nth")


def unit_uniform(key: Column, seed: int, stream: int) -> Column:
    """Uniform number in (0, 1) that depends only on the row's key and the seed: 52 bits of an md5."""
    named = F.concat_ws(":", key.cast("string"), F.lit(str(seed)), F.lit(str(stream)))
    bits = F.conv(F.substring(F.md5(F.encode(named, "UTF-8")), 1, 13), 16, 10).cast("bigint")
    return (bits + 0.5) / float(1 << 52)


def unit_normal(key: Column, seed: int) -> Column:
    """Standard normal number that depends only on the row's key and the seed (Box-Muller)."""
    return F.sqrt(F.log(unit_uniform(key, seed, 1)) * -2) * F.cos(unit_uniform(key, seed, 2) * 6.283185307179586)


def jitter_copies(flows: DataFrame, multiplier: int, seed: int = 0, spread: float = 0.05) -> DataFrame:
    """Each flow and multiplier-1 noisy copies; one N(1, spread) scale per copy.

    The noise comes from the flow id and copy number, so a recomputed task repeats it.
    """
    copies = flows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(multiplier - 1))))
    noisy = F.col("_copy") > 0
    scale = F.when(noisy, unit_normal(F.concat_ws(":", "flow_id", "_copy"), seed) * spread + 1).otherwise(1.0)
    scaled = copies.withColumn("_scale", scale)

    def stats(name, fields, low):
        return F.struct(*[F.greatest(F.lit(low), F.col(f"{name}.{f}") * F.col("_scale")).alias(f) for f in fields])

    size = stats("packet_size_stats", ("min", "max", "mean", "std"), 0.0)
    gaps = stats("inter_arrival_stats", ("mean", "std"), 1e-6)
    return scaled.withColumns({
        "flow_id": F.when(noisy, F.concat("flow_id", F.lit("_j"), (F.col("_copy") - 1).cast("string"))).otherwise(F.col("flow_id")),
        "packet_size_stats": F.when(noisy, size).otherwise(F.col("packet_size_stats")),
        "inter_arrival_stats": F.when(noisy, gaps).otherwise(F.col("inter_arrival_stats")),
        "entropy": F.when(noisy, F.least(F.lit(8.0), F.greatest(F.lit(0.0), F.col("entropy") * F.col("_scale")))).otherwise(F.col("entropy")),
        "byte_ratio": F.when(noisy, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("byte_ratio") * F.col("_scale")))).otherwise(F.col("byte_ratio")),
    }).withColumn("copy", F.col("_copy")).drop("_copy", "_scale")


def replicate(rows: DataFrame, order: str, target: int, id_column: str = "flow_id") -> DataFrame:
    """Repeat the rows in turn until ``target`` rows exist; ids get the suffix _bench<i>."""
    n = rows.count()
    if n == 0:
        raise ValueError("no rows to repeat")
    ranked = rank_rows(rows, [], order, "_nth")
    rounds = F.sequence(F.lit(0).cast("bigint"), F.lit((target - 1) // n).cast("bigint"))
    spread = ranked.withColumn("_i", F.explode(rounds)).withColumn("_i", F.col("_i") * n + F.col("_nth") - 1)
    return spread.filter(F.col("_i") < target).withColumn(
        id_column, F.concat(F.col(id_column).cast("string"), F.lit("_bench"), F.col("_i").cast("string")),
    ).drop("_nth", "_i")


def halves(rows: DataFrame, order: str, out: str = "part") -> DataFrame:
    """First half by order is "train", the rest "test"."""
    mid = rows.count() // 2
    return rank_rows(rows, [], order, "_nth").withColumn(
        out, F.when(F.col("_nth") <= mid, "train").otherwise("test")).drop("_nth")


def train_test_table(benign: DataFrame, train_threats: DataFrame, test_threats: DataFrame, order: str) -> DataFrame:
    """Benign rows split in halves; threat rows train on one source and are tested on another."""
    split = halves(benign, order).withColumn("label", F.lit("benign"))
    return (
        split.unionByName(train_threats.withColumn("part", F.lit("train")), allowMissingColumns=True)
        .unionByName(test_threats.withColumn("part", F.lit("test")), allowMissingColumns=True)
    )
