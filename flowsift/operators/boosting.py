"""Gradient-boosted multi-class trees with a softmax loss, grown from histograms.

All classes' trees of a round grow together, a level at a time. Each task sums gradients and hessians of its rows
into one histogram a (class, node, feature); those rows are summed and searched for the best cut by Spark, and one
row a node comes back. Sums are kept in whole multiples of 2**-20, so they do not depend on the order of the rows.
Margins are written once a round, so a lost executor costs no earlier round.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.constants import BENIGN
from flowsift.functions.features import feature_vector
from flowsift.operators.classifier import class_order, probability_layer
from flowsift.operators.staging import recorded, remove, staged

UNIT = float(1 << 20)


@dataclass(frozen=True)
class Settings:
    """rounds of one tree a class; rows and columns drawn for each tree (the share); ``bins`` cuts a feature at most."""

    rounds: int = 200
    depth: int = 6
    rate: float = 0.1
    rows: float = 0.8
    columns: float = 0.8
    bins: int = 64
    shrink: float = 1.0
    least_weight: float = 1.0
    seed: int = 42


@dataclass
class Tree:
    """Node i has children 2i + 1 and 2i + 2; feature -1 marks a leaf. A row goes left if its bin is at most ``cut``."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> "Tree":
        n = (1 << depth + 1) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int32), np.zeros(n))

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The node each row has come to."""
        at = np.zeros(len(bins), np.int64)
        while True:
            on = np.flatnonzero(self.feature[at] >= 0)
            if not len(on):
                return at
            node = at[on]
            at[on] = 2 * node + 1 + (bins[on, self.feature[node]] > self.cut[node])


@dataclass
class Boosted:
    classes: list[str]
    cuts: list[np.ndarray]
    rounds: list[list[Tree]] = field(default_factory=list)
    version: int = 1

    def binned(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(values.shape, np.uint8)
        for f, cuts in enumerate(self.cuts):
            out[:, f] = np.searchsorted(cuts, values[:, f], "left")
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.zeros((len(bins), len(self.classes)))
        for trees in self.rounds:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.leaves(bins)]
        return out

    def probabilities(self, values: np.ndarray) -> np.ndarray:
        return softmax(self.margins(self.binned(values)))


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def slopes(margins: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and hessians of the weighted loss, in units."""
    p = softmax(margins)
    g = p.copy()
    g[np.arange(len(y)), y] -= 1
    return np.rint(g * w[:, None] * UNIT), np.rint(2 * p * (1 - p) * w[:, None] * UNIT)


def feature_cuts(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """At most ``bins`` ascending values a feature: all values if they are few, else approximate quantiles."""
    shares = [i / (4 * bins) for i in range(4 * bins + 1)]
    found = rows.agg(*[F.percentile_approx(F.get("features", F.lit(f)), shares, 10_000).alias(f"f{f}") for f in range(width)]).first()
    out = []
    for f in range(width):
        values = np.unique(np.asarray(found[f"f{f}"] or [0.0], float))
        out.append(values if len(values) <= bins else np.unique(values[np.linspace(0, len(values) - 1, bins).astype(int)]))
    return out


def best_cut(g: np.ndarray, h: np.ndarray, settings: Settings) -> tuple[int, float, float, float]:
    """(cut, gain, gradient and hessian left) of one feature's histogram; gain 0 if no cut helps."""
    left_g, left_h = np.cumsum(g) / UNIT, np.cumsum(h) / UNIT
    all_g, all_h = left_g[-1], left_h[-1]
    right_g, right_h = all_g - left_g, all_h - left_h
    score = lambda a, b: a * a / (b + settings.shrink)
    gain = score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)
    gain = np.where((left_h >= settings.least_weight) & (right_h >= settings.least_weight), gain, 0.0)
    at = int(np.argmax(gain))
    return at, float(max(gain[at], 0.0)), float(left_g[at]), float(left_h[at])


def _columns(settings: Settings, turn: int, k: int, width: int) -> np.ndarray:
    draw = np.random.default_rng([settings.seed, turn, k])
    return np.sort(draw.choice(width, max(1, round(settings.columns * width)), replace=False))


def _held(batch: pa.RecordBatch, width: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return bins, np.frombuffer(b"".join(batch.column("margins").to_pylist()), "<f8").reshape(-1, classes)


def _histograms(trees: list[Tree], level: int, columns: list[np.ndarray], width: int, bins: int):
    first, nodes = (1 << level) - 1, 1 << level

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((2, nodes, len(c), bins), np.int64) for c in columns]
        for batch in batches:
            binned, margins = _held(batch, width, len(trees))
            g, h = slopes(margins, np.asarray(batch.column("y")), np.asarray(batch.column("w")))
            for k, (tree, own) in enumerate(zip(trees, columns)):
                node = tree.leaves(binned) - first
                on = node >= 0  # rows of earlier leaves are done
                for i, f in enumerate(own):
                    cell = node[on] * bins + binned[on, f]
                    for s, slope in enumerate((g, h)):
                        sums[k][s, :, i] += np.bincount(cell, slope[on, k], nodes * bins).astype(np.int64).reshape(nodes, bins)
        out = [(k, first + n, int(f), sums[k][0, n, i].tobytes(), sums[k][1, n, i].tobytes())
               for k, own in enumerate(columns) for n in range(nodes) for i, f in enumerate(own) if sums[k][1, n, i].any()]
        if out:
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["k", "node", "feature", "g", "h"])

    return rows


def _searched(settings: Settings):
    def best(key: tuple, table: pa.Table) -> pa.Table:
        g, h = (sum(np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()) for c in ("g", "h"))
        cut, gain, left_g, left_h = best_cut(g, h, settings)
        row = (*[x.as_py() for x in key], cut, gain, left_g, left_h, float(g.sum()) / UNIT, float(h.sum()) / UNIT)
        return pa.Table.from_pydict(dict(zip(("k", "node", "feature", "cut", "gain", "left_g", "left_h", "g", "h"), ([x] for x in row)))).cast(SPLITS)

    return best


SPLITS = pa.schema([("k", pa.int32()), ("node", pa.int32()), ("feature", pa.int32()), ("cut", pa.int32()), *[
    (c, pa.float64()) for c in ("gain", "left_g", "left_h", "g", "h")]])


def fit_boosted(rows: DataFrame, classes: list[str], settings: Settings = Settings(), *, version: int = 1) -> Boosted:
    """rows: features array<double> without nulls, label; row_key (any value that tells rows apart) draws the rows of a round.

    Weights are n / (classes * n_class). Only cuts, one row a tree node and class counts come to the driver.
    """
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    width = rows.select(F.size("features").alias("n")).first()["n"]
    model = Boosted(classes, feature_cuts(rows, width, settings.bins), version=version)
    number = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    weight = F.create_map(*[F.lit(x) for c in classes for x in (c, total / (len(classes) * counts[c]))])
    tagged = rows.select(
        F.xxhash64("row_key").alias("draw"), "features", F.element_at(number, F.col("label")).alias("y"), F.element_at(weight, F.col("label")).alias("w"))
    held = "draw long, bins binary, y int, w double, margins binary"

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.asarray(batch.column("features").flatten(), float).reshape(-1, width)
            packed = [r.tobytes() for r in model.binned(values)]
            start = [bytes(8 * len(classes))] * batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column("draw"), pa.array(packed, pa.binary()), batch.column("y"), batch.column("w"), pa.array(start, pa.binary())],
                names=["draw", "bins", "y", "w", "margins"])

    written: list[str] = []
    with recorded(written):
        data = staged(tagged.mapInArrow(bin_rows, held))
    for turn in range(settings.rounds):
        drawn = data.filter(F.pmod(F.xxhash64("draw", F.lit(turn)), F.lit(1000)) < round(1000 * settings.rows)) if settings.rows < 1 else data
        trees = [Tree.empty(settings.depth) for _ in classes]
        columns = [_columns(settings, turn, k, width) for k in range(len(classes))]
        for level in range(settings.depth):
            made = drawn.mapInArrow(_histograms(trees, level, columns, width, settings.bins + 1), "k int, node int, feature int, g binary, h binary")
            searched = made.groupBy("k", "node", "feature").applyInArrow(
                _searched(settings), "k int, node int, feature int, cut int, gain double, left_g double, left_h double, g double, h double")
            order = F.struct("gain", (-F.col("feature")).alias("first"))
            best = searched.groupBy("k", "node").agg(F.max_by(F.struct("*"), order).alias("s")).select("s.*").collect()  # a row a node
            for r in best:
                tree, node = trees[r["k"]], r["node"]
                leaf = lambda g, h: -settings.rate * g / (h + settings.shrink)
                tree.value[node] = leaf(r["g"], r["h"])
                if r["gain"] > 1e-9:
                    tree.feature[node], tree.cut[node] = r["feature"], r["cut"]
                    tree.value[2 * node + 1] = leaf(r["left_g"], r["left_h"])
                    tree.value[2 * node + 2] = leaf(r["g"] - r["left_g"], r["h"] - r["left_h"])
            if not any(r["gain"] > 1e-9 for r in best):
                break
        model.rounds.append(trees)
        if turn < settings.rounds - 1:
            with recorded(written):
                data = staged(data.mapInArrow(_moved(trees, width), held))
            remove(rows.sparkSession, written[:-1])
            del written[:-1]
    remove(rows.sparkSession, written)
    return model


def _moved(trees: list[Tree], width: int):
    """Rows with a round's trees added to their margins."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            binned, margins = _held(batch, width, len(trees))
            after = margins + np.stack([t.value[t.leaves(binned)] for t in trees], axis=1)
            yield batch.set_column(4, "margins", pa.array([r.tobytes() for r in after], pa.binary()))

    return add


def fit_boosted_flows(flows: DataFrame, label: str = "label", settings: Settings = Settings(), *, version: int = 1) -> Boosted:
    classes = class_order({r[label] for r in flows.select(label).distinct().collect()})
    rows = flows.select(feature_vector(version).alias("features"), F.col(label).alias("label"), F.struct("flow_id", "capture_id").alias("row_key"))
    return fit_boosted(rows, classes, settings, version=version)


def boosted_probabilities(model: Boosted):
    """features array<double> -> class probabilities, in Arrow batches."""
    @F.pandas_udf("array<double>")
    def predict(features: pd.Series) -> pd.Series:
        return pd.Series(list(model.probabilities(np.stack(features.to_numpy()).astype(float)))) if len(features) else pd.Series([], dtype=object)

    return predict


def boosted_layer(flows: DataFrame, model: Boosted, out: str = "boosted") -> DataFrame:
    """Add the boosted layer's score struct: 1 - P(benign), best threat class when P(benign) < 0.5."""
    if model.classes[0] != BENIGN:
        raise ValueError("the first class must be benign")
    ready = flows.withColumn("_p", boosted_probabilities(model)(feature_vector(model.version)))
    return probability_layer(ready, F.col("_p"), model.classes, out).drop("_p")
