"""Z-score layer: benign baseline of six features and the deviation from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.scores import squash
from flowsift.operators.rules import layer_score

# Feature, its column, and how evidence names it.
FEATURES = [
    ("inter_arrival_mean", "inter_arrival_stats.mean", "unusual_inter_arrival_time"),
    ("packet_size_mean", "packet_size_stats.mean", "unusual_packet_size"),
    ("entropy", "entropy", "unusual_entropy"),
    ("byte_ratio", "byte_ratio", "unusual_byte_ratio"),
    ("ttl", "ttl", "unusual_ttl"),
    ("fanout_count", "fanout_count", "unusual_fanout"),
]


@dataclass(frozen=True)
class Baseline:
    """Mean and population deviation by feature name."""

    stats: dict[str, tuple[float, float]]


def baseline_table(benign: DataFrame) -> DataFrame:
    """One row: mean and population deviation per feature; fan-out over its non-zero values."""
    measures = []
    for name, column, _ in FEATURES:
        value = F.col(column).cast("double")
        if name == "fanout_count":
            value = F.when(value != 0, value)
        missing = 1.0 if name == "fanout_count" else 0.0
        spread = F.stddev_pop(value)
        measures += [
            F.coalesce(F.avg(value), F.lit(missing)).alias(f"{name}_mean"),
            F.when(spread > 0, spread).otherwise(1.0).alias(f"{name}_std"),
        ]
    return benign.agg(F.count(F.lit(1)).alias("n"), *measures)


def fit_baseline(benign: DataFrame) -> Baseline:
    row = baseline_table(benign).first()
    if not row["n"]:
        raise ValueError("the baseline needs at least one benign flow")
    return Baseline({n: (row[f"{n}_mean"], row[f"{n}_std"]) for n, _, _ in FEATURES})


def zscore_layer(flows: DataFrame, baseline: Baseline, out: str = "stats") -> DataFrame:
    """Add the z-score layer's score struct; the twelve baseline numbers are plan literals."""
    zs = {}
    for i, (name, column, _) in enumerate(FEATURES):
        mean, std = baseline.stats[name]
        z = F.abs((F.col(column).cast("double") - mean) / std)
        zs[f"_z{i}"] = F.when(F.coalesce(F.col(column), F.lit(0)) != 0, z) if name == "fanout_count" else z
    rated = flows.withColumns(zs)
    z = [F.col(c) for c in zs]
    total, count = F.lit(0.0), F.lit(0)
    for c in z:
        total = total + F.coalesce(c, F.lit(0.0))
        count = count + c.isNotNull().cast("int")
    raw = F.least((total / count * 0.5 + F.greatest(*z) * 0.5) / 5.0, F.lit(1.0))
    said = F.filter(F.array(*[
        F.when(c > 2, F.format_string(f"{label} (z=%.2f)", c)) for c, (_, _, label) in zip(z, FEATURES)]),
        lambda e: e.isNotNull())
    scored = rated.withColumns({"_raw": raw, "_said": said})
    return scored.withColumn(out, layer_score(
        "stats", F.col("_raw"), squash(F.col("_raw")), None, F.col("_said"))).select(*flows.columns, out)
