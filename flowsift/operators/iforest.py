"""Isolation forest: trees grown in parallel from small row samples, scored in Arrow batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.functions.core import let
from flowsift.functions.features import FEATURE_NAMES, WIDTH, feature_columns
from flowsift.functions.scores import squash
from flowsift.operators.ordered import exact_quantiles
from flowsift.operators.rules import layer_score
from flowsift.operators.sampling import unit_uniform
from flowsift.operators.staging import staged


def mean_path(n):
    """Average search depth among n rows; the usual isolation-forest normaliser."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


@dataclass(frozen=True)
class Forest:
    """Trees as complete binary layouts: child of slot i is 2i+1 (<= threshold) or 2i+2."""

    feature: np.ndarray     # trees x inner slots
    threshold: np.ndarray   # trees x inner slots
    depth: np.ndarray       # trees x bottom slots: path length reached there
    center: np.ndarray
    scale: np.ndarray
    norm: float
    offset: float = 0.0
    spread: float = 1.0
    midpoint: float = 0.5

    def normality(self, x: np.ndarray) -> np.ndarray:
        """Negative isolation score of each row of x: lower is more isolated."""
        z = np.ascontiguousarray((x - self.center) / self.scale)
        flat, base = z.ravel(), np.arange(len(z)) * z.shape[1]
        inner = self.feature.shape[1]
        levels = int(math.log2(inner + 1))
        total = np.zeros(len(z))
        for t in range(len(self.feature)):
            feature, threshold = self.feature[t], self.threshold[t]
            slot = np.zeros(len(z), dtype=np.int64)
            for _ in range(levels):
                slot = 2 * slot + 1 + (flat[base + feature[slot]] > threshold[slot])
            total += self.depth[t][slot - inner]
        return -np.power(2.0, -(total / len(self.feature)) / self.norm)


def _grow(rows: np.ndarray, levels: int, rng: np.random.Generator):
    """One tree over at most a few hundred rows, in complete-binary layout."""
    inner = 2 ** levels - 1
    feature = np.zeros(inner, dtype=np.int32)
    threshold = np.full(inner, np.inf)
    depth = np.zeros(inner + 1)
    todo = [(0, rows, 0)]
    while todo:
        slot, part, level = todo.pop()
        spans = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(rows.shape[1])
        open_ = np.flatnonzero(spans > 0)
        if level == levels or len(part) <= 1 or not len(open_):
            # Fill every bottom slot under this leaf with its path length.
            first, count = slot, 1
            for _ in range(levels - level):
                first, count = 2 * first + 1, 2 * count
            depth[first - inner:first - inner + count] = level + float(mean_path(len(part)))
            continue
        f = int(rng.choice(open_))
        low, high = part[:, f].min(), part[:, f].max()
        cut = rng.uniform(low, high)
        cut = cut if cut < high else low
        feature[slot], threshold[slot] = f, cut
        below = part[:, f] <= cut
        todo += [(2 * slot + 1, part[below], level + 1), (2 * slot + 2, part[~below], level + 1)]
    return feature, threshold, depth


ROW_KEY = "_row_key"


def _tree_samples(rows: DataFrame, n: int, names: list[str], trees: int, size: int, seed: int) -> DataFrame:
    """(tree, features, draw) rows: about 4 * size candidates per tree, whatever the table size.

    Each row is offered to a few distinct trees and kept with a fixed chance. The draws come
    from the row's key, so they do not depend on how rows are placed, and a mass of like flows is thinned.
    """
    repeats = max(1, min(trees, math.ceil(4 * trees * size / n)))
    share = min(1.0, 4.0 * trees * size / (n * repeats))
    first = F.floor(unit_uniform(F.col(ROW_KEY), seed, 0) * trees).cast("int")
    offered = rows.select(*names, ROW_KEY, first.alias("_first")).withColumn(
        "_j", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    placed = offered.withColumn("tree", F.pmod(F.col("_first") + F.col("_j"), F.lit(trees))).select(
        *names, "tree", unit_uniform(F.xxhash64(ROW_KEY, "tree"), seed, 1).alias("_draw"))
    return placed.filter(F.col("_draw") < share)


def fit_forest(
    benign: DataFrame, *, version: int = 1, trees: int = 200, sample: int = 256, contamination: float = 0.05,
    midpoint_share: float = 0.95, seed: int = 42,
) -> Forest:
    """Fit on benign flows. Passes over the data: moments, tree samples, training scores."""
    names = FEATURE_NAMES[:WIDTH[version]]
    keys = [c for c in ("capture_id", "flow_id", "first_frame") if c in benign.columns] or benign.columns
    inputs = benign.select(*feature_columns(version), F.xxhash64(*keys).alias(ROW_KEY))
    moments = inputs.agg(F.count(F.lit(1)), *[f(n) for n in names for f in (F.avg, F.stddev_pop)]).first()
    n = moments[0]
    if not n:
        raise ValueError("the forest needs at least one benign flow")
    center = np.array(moments[1::2], dtype=float)
    scale = np.array(moments[2::2], dtype=float)
    scale[scale == 0] = 1.0
    size = min(sample, n)
    levels = max(1, math.ceil(math.log2(max(size, 2))))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.nsmallest(size, "_draw")[names].to_numpy(float)
        rng = np.random.default_rng([seed, int(key[0])])
        feature, threshold, depth = _grow((rows - center) / scale, levels, rng)
        return pd.DataFrame({"tree": [int(key[0])], "feature": [feature], "threshold": [threshold], "depth": [depth]})

    samples = _tree_samples(inputs, n, names, trees, size, seed)
    rows = samples.groupBy("tree").applyInPandas(
        grow, "tree int, feature array<int>, threshold array<double>, depth array<double>").orderBy("tree").collect()
    forest = Forest(
        np.array([r["feature"] for r in rows], dtype=np.int64), np.array([r["threshold"] for r in rows], dtype=float),
        np.array([r["depth"] for r in rows], dtype=float), center, scale, float(max(mean_path(size), 1e-12)))

    scores = staged(inputs.select(_normality(forest)(*names).alias("v")))
    low, mid = exact_quantiles(scores, "v", [contamination, 1.0 - midpoint_share])
    ends = scores.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    spread = max(abs(ends["lo"] - low), abs(ends["hi"] - low), 1e-6)
    midpoint = float(np.clip((-(mid - low) / spread + 1.0) / 2.0, 0.0, 1.0))
    return Forest(forest.feature, forest.threshold, forest.depth, center, scale, forest.norm, low, spread, midpoint)


def _normality(forest: Forest):
    @F.pandas_udf("double")
    def run(*columns: pd.Series) -> pd.Series:
        return pd.Series(forest.normality(np.column_stack([c.to_numpy(float) for c in columns])))
    return run


def anomaly_score(forest: Forest, version: int = 1):
    """Raw score column in [0, 1]; 1 is most anomalous."""
    value = _normality(forest)(*feature_columns(version))
    decision = value - F.lit(forest.offset)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (-decision / F.lit(forest.spread) + 1.0) / 2.0))


def forest_layer(flows: DataFrame, forest: Forest, *, version: int = 1, out: str = "isoforest") -> DataFrame:
    """Add the isolation-forest layer's score struct."""
    scored = flows.withColumn("_raw", anomaly_score(forest, version))
    said = lambda raw: F.array_compact(F.array(
        F.when(raw > 0.6, F.format_string("isoforest_anomaly_score=%.3f", raw)),
        F.when(raw > 0.8, F.lit("high_anomaly_confidence"))))
    return scored.withColumn(out, let(F.col("_raw"), lambda raw: layer_score(
        "isoforest", raw, squash(raw, forest.midpoint), None, said(raw)))).drop("_raw")
