"""Quality of documents by co-training on two views.

The text view is a logistic model of hashed words and word endings; the metadata view is a logistic model of the
page's metadata: source, language, length and the layout counts (lines, symbols, capitals, repeated words). Both
start from the labelled documents. In each round a view labels the unlabelled documents it is most sure of for
the other view. The two views' scores are calibrated on labelled documents kept out of the rounds, and their
calibrated log-odds are added, less the prior they share, to score every document on its whole text.

Training starts from at most ``labelled_rows`` labelled documents, the first by a hash of doc_id. Pseudo-labels come
from all unlabelled documents: each document's features (bounded by the number of cells, however long the text) are
written once, every round scores them all, counts the confidences in steps, and ranks only the documents at or above
the step in which a view's most confident ``most_a_round`` end. So only these rows and the counts reach the driver.

Defined results: a null text is the empty text; null metadata is a value of its own; a null label is no label;
repeated rows are scored alike; rows that share a doc_id train as one, the one whose features hash lowest; documents of equal
confidence follow the hash of their doc_id; without labelled documents of both classes every score is the 0.5 of no
knowledge; an empty table gives no row. Documents of the held-out fold (CRC of doc_id modulo 5) train nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import freeing, text_or_empty
from flowsift.operators import staging

CELLS = 1 << 11
NAMES = 64
SHAPE = 9
AGAIN = 0


@dataclass(frozen=True)
class Settings:
    labelled_rows: int = 4000
    rounds: int = 4
    sure: float = 0.97
    most_a_round: int = 400
    calibration_part: float = 0.25
    ridge: float = 1e-4
    threshold: float = 0.5


class _Cells(dict):
    """The two cells of a word: its own hash and that of its last two letters."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        found = 1 + zlib.crc32(word) % (CELLS - 1), 1 + zlib.crc32(b"$" + word[-2:]) % (CELLS - 1)
        if len(self) < 300_000:
            self[word] = found
        return found


def word_cells(text: str, cells: _Cells) -> np.ndarray:
    """Cells of the words and endings, and one for each word that repeats the word before it."""
    words = text.encode("utf-8", "replace").split()
    at = np.fromiter((c for w in words for c in cells[w]), np.int64, 2 * len(words))
    return np.r_[at, np.full(2 * int((at[2::2] == at[:-2:2]).sum()), AGAIN)]


def shape(text: str, source: str | None, lang: str | None) -> np.ndarray:
    """The metadata view: layout figures and one cell each for source and language."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = max(len(raw), 1)
    codes = np.frombuffer(raw, np.uint8)
    symbols = int(((codes > 32) & (codes < 128) & ~(((codes | 32) >= 97) & ((codes | 32) <= 122)) & ~((codes >= 48) & (codes <= 57))).sum())
    capitals = int(((codes >= 65) & (codes <= 90)).sum())
    letters = max(int((((codes | 32) >= 97) & ((codes | 32) <= 122)).sum()), 1)
    again = sum(a == b for a, b in zip(words, words[1:])) / max(len(words) - 1, 1)
    out = np.zeros(SHAPE + 2 * NAMES)
    out[:SHAPE] = (
        1.0, math.log1p(len(raw)) / 10, math.log1p(raw.count(b"\n")) / 5, min(symbols / n * 5, 2.0), min(capitals / letters * 3, 3.0),
        again * 5, len(set(words)) / max(len(words), 1), raw.count(b"|") / max(len(words), 1) * 5, min(len(raw) / max(len(words), 1), 20) / 10)
    for k, name in enumerate((source, lang)):
        out[SHAPE + k * NAMES + (0 if name is None else 1 + zlib.crc32(name.encode("utf-8", "replace")) % (NAMES - 1))] = 1.0
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 200) -> np.ndarray:
    """Weights of a ridge logistic model by accelerated gradient steps; both classes weigh the same."""
    weight = np.where(y > 0.5, 0.5 / max((y > 0.5).sum(), 1), 0.5 / max((y <= 0.5).sum(), 1)).astype(np.float32)
    w = np.zeros(x.shape[1], np.float32)
    z, t = w, 1.0
    rate = 4.0 / max(float((weight * (x * x).sum(axis=1)).sum()), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        new = z - rate * (x.T @ (weight * (p - y)) + ridge * z)
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        z = new + np.float32((t - 1) / t2) * (new - w)
        w, t = new, t2
    return w


def fit_calibration(score: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a score + b))), by Newton steps on targets drawn in from 0 and 1."""
    up, down = (y > 0.5).sum(), (y <= 0.5).sum()
    goal = np.where(y > 0.5, (up + 1) / (up + 2), 1 / (down + 2))
    middle, scale = float(score.mean()), float(score.std()) or 1.0
    x = np.c_[(score - middle) / scale, np.ones(len(score))]
    loss = lambda w: float((np.logaddexp(0, x @ w) - goal * (x @ w)).sum() + 5e-4 * w @ w)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (goal - p) - 1e-3 * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
    return float(w[0] / scale), float(w[1] - w[0] * middle / scale)


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_calibration: tuple[float, float]
    meta_calibration: tuple[float, float]
    prior: float


#: (pupil view, label): the rows chosen for it, as their text and metadata features.
Chosen = dict[tuple[int, float], tuple[np.ndarray, np.ndarray]]


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, settings: Settings, surest: Callable[..., Chosen]) -> Model | None:
    """Features and labels of the labelled rows in a fixed order, the calibration part first.

    ``surest(weights, calibrations, wanted)`` gives the unlabelled rows each view is most sure of, at most ``wanted`` for
    each (pupil, label), and none twice for one pupil.
    """
    held = int(len(y) * settings.calibration_part)
    if len(np.unique(y[held:])) < 2 or len(np.unique(y[:held])) < 2:
        return None
    views = (text, meta)
    rows = [[v[held:]] for v in views]
    labels = [[y[held:]], [y[held:]]]
    share = float(y[held:].mean())
    wanted = {(pupil, label): max(1, int(settings.most_a_round * part)) for pupil in (1, 0) for label, part in ((1.0, share), (0.0, 1 - share))}
    for turn in range(settings.rounds + 1):
        fitted = [fit_logistic(np.concatenate(r), np.concatenate(t).astype(np.float32), settings.ridge) for r, t in zip(rows, labels)]
        calibrations = [fit_calibration(v[:held] @ w, y[:held]) for v, w in zip(views, fitted)]
        if turn == settings.rounds:
            break
        for (pupil, label), found in surest(fitted, calibrations, wanted).items():
            rows[pupil].append(found[pupil])
            labels[pupil].append(np.full(len(found[pupil]), label))
    prior = float(np.clip(y.mean(), 0.01, 0.99))
    return Model(fitted[0], fitted[1], calibrations[0], calibrations[1], math.log(prior / (1 - prior)))


def view_features(docs: DataFrame) -> DataFrame:
    """doc_id, cells, counts, shape and a hash of the three as ``mark``, of every row."""
    source = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Cells()
        for batch in batches:
            cells, counts, shapes = [], [], []
            for text, name, lang in zip(*(batch.column(c) for c in ("text", "source", "lang"))):
                text = text.as_py()
                at, n = np.unique(word_cells(text, known), return_counts=True)
                cells.append(at.astype(np.int16))
                counts.append(n.astype(np.float32))
                shapes.append(shape(text, name.as_py(), lang.as_py()).astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(cells, pa.list_(pa.int16())), pa.array(counts, pa.list_(pa.float32())), pa.array(shapes, pa.list_(pa.float32()))],
                names=["doc_id", "cells", "counts", "shape"])

    found = source.mapInArrow(freeing(rows), f"doc_id {dict(source.dtypes)['doc_id']}, cells array<smallint>, counts array<float>, shape array<float>")
    return found.withColumn("mark", F.xxhash64("cells", "counts", "shape"))


def dense(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The two views of a bounded number of feature rows."""
    text = np.zeros((rows.num_rows, CELLS), np.float32)
    for k, (at, n) in enumerate(zip(rows.column("cells"), rows.column("counts"))):
        if len(at):
            n = n.values.to_numpy()
            text[k, at.values.to_numpy()] = n / n.sum() * 20
    meta = np.asarray(rows.column("shape").to_pylist(), np.float32).reshape(rows.num_rows, SHAPE + 2 * NAMES)
    return text, meta


def view_odds(batch: pa.RecordBatch, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The uncalibrated scores of the two views for each row of a batch."""
    n = batch.num_rows
    cells, counts = batch.column("cells"), batch.column("counts")
    row = np.repeat(np.arange(n), np.diff(cells.offsets.to_numpy()))
    at, times = cells.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.float64)
    total = np.bincount(row, weights=times, minlength=n)
    sums = np.bincount(row, weights=text.astype(np.float64)[at] * times, minlength=n)
    shapes = batch.column("shape").flatten().to_numpy().astype(np.float64).reshape(n, -1)
    return sums / np.maximum(total, 1) * 20, (shapes * meta.astype(np.float64)).sum(axis=1)


def _train_fold(doc_id: Column) -> Column:
    return doc_id.isNotNull() & (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 != 0)


def _one_row(rows: DataFrame, *more: str) -> pa.Table:
    """One row for each doc_id of a bounded selection."""
    first = F.min(F.struct("mark", "cells", "counts", "shape", *more)).alias("first")
    return rows.groupBy("doc_id").agg(first).select("doc_id", "first.*").toArrow()


class Pool:
    """All unlabelled documents outside the held-out fold; each pupil is given a document once."""

    #: Steps of a confidence (log-odds) in which documents are counted, and the last step.
    STEPS, LAST = 16, 60 * 16

    def __init__(self, features: DataFrame, known: DataFrame, settings: Settings):
        self.features, self.known = features, known.select("doc_id")
        self.least = math.log(settings.sure / (1 - settings.sure))
        self.given: tuple[set, set] = set(), set()

    def scores(self, weights: list[np.ndarray]) -> DataFrame:
        """doc_id, mark, text_odds, meta_odds; one row for each unlabelled doc_id."""
        text, meta = weights

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("mark"), *map(pa.array, view_odds(batch, text, meta))],
                    names=["doc_id", "mark", "text_odds", "meta_odds"])

        kind = dict(self.features.dtypes)["doc_id"]
        scored = self.features.filter(_train_fold(F.col("doc_id"))).mapInArrow(
            freeing(rows), f"doc_id {kind}, mark bigint, text_odds double, meta_odds double")
        first = scored.groupBy("doc_id").agg(F.min(F.struct("mark", "text_odds", "meta_odds")).alias("first"))
        return first.select("doc_id", "first.*").join(self.known, "doc_id", "left_anti")

    def __call__(self, weights: list[np.ndarray], calibrations: list[tuple[float, float]], wanted: dict[tuple[int, float], int]) -> Chosen:
        tables: list[str] = []
        with staging.recorded(tables):
            scores = staging.staged(self.scores(weights))
        lists = list(wanted)
        keys = []
        for pupil, label in lists:
            a, b = calibrations[1 - pupil]
            sure = (F.col("meta_odds" if pupil == 0 else "text_odds") * a + b) * (1 if label else -1)
            free = ~F.col("doc_id").isin(list(self.given[pupil])) if self.given[pupil] else F.lit(True)
            keys.append(F.when(free & (sure >= self.least), sure))
        each = scores.select("doc_id", "mark", F.posexplode(F.array(*keys)).alias("list", "sure")).filter("sure IS NOT NULL").withColumn(
            "step", F.floor(F.least(F.col("sure") * self.STEPS, F.lit(float(self.LAST)))))
        counts = {(r["list"], r["step"]): r["count"] for r in each.groupBy("list", "step").count().collect()}
        chosen = None
        for k, target in enumerate(lists):
            lowest, seen = self.LAST, 0
            for step in sorted((s for i, s in counts if i == k), reverse=True):
                lowest, seen = step, seen + counts[k, step]
                if seen >= wanted[target]:
                    break
            top = each.filter((F.col("list") == k) & (F.col("step") >= lowest)).orderBy(
                F.desc("sure"), F.xxhash64("doc_id"), "doc_id").limit(wanted[target])
            chosen = top if chosen is None else chosen.unionByName(top)
        picked = chosen.select("list", "doc_id", "mark").collect()
        out: Chosen = {}
        if picked:
            # At most the wanted rows of each list.
            ids = self.features.sparkSession.createDataFrame(sorted({(r["doc_id"], r["mark"]) for r in picked}), chosen.select("doc_id", "mark").schema)
            found = _one_row(self.features.join(F.broadcast(ids), ["doc_id", "mark"]))
            at = {d: i for i, d in enumerate(found.column("doc_id").to_pylist())}
            views = dense(found)
            for k, target in enumerate(lists):
                own = [r["doc_id"] for r in picked if r["list"] == k]
                self.given[target[0]].update(own)
                out[target] = tuple(v[[at[d] for d in own]] for v in views)
        staging.remove(self.features.sparkSession, tables)
        return out


def fit_features(features: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Models of the two views; ``features`` is read several times, so it should be a written table."""
    known = labels.filter(F.col("quality").isNotNull() & _train_fold(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max("quality").cast("double").alias("y"))
    # At most labelled_rows rows.
    marked = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.labelled_rows))
    rows = _one_row(features.join(marked, "doc_id"), "y")
    if not rows.num_rows:
        return None
    mixed = sorted(range(rows.num_rows), key=lambda i: (zlib.crc32(str(rows["doc_id"][i].as_py()).encode()), str(rows["doc_id"][i])))
    rows = rows.take(mixed)
    return co_train(*dense(rows), rows["y"].to_numpy(), settings, Pool(features, known, settings))


def score_features(features: DataFrame, model: Model | None, settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, kept, text_score, meta_score of every row."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = lambda x: 1 / (1 + np.exp(-x))
        for batch in batches:
            odds, prior = np.zeros((2, batch.num_rows)), 0.0
            if model is not None:
                prior = model.prior
                for k, score in enumerate(view_odds(batch, model.text, model.meta)):
                    a, b = (model.text_calibration, model.meta_calibration)[k]
                    odds[k] = np.clip(a * score + b, -30, 30)
            both = chance(odds[0] + odds[1] - prior)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(both), pa.array(both >= settings.threshold), pa.array(chance(odds[0])), pa.array(chance(odds[1]))],
                names=["doc_id", "score", "kept", "text_score", "meta_score"])

    return features.mapInArrow(
        rows, f"doc_id {dict(features.dtypes)['doc_id']}, score double, kept boolean, text_score double, meta_score double")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    return fit_features(staging.staged(view_features(docs)), labels, settings)


def score_documents(docs: DataFrame, model: Model | None, settings: Settings = Settings()) -> DataFrame:
    return score_features(view_features(docs), model, settings)


def co_trained_scores(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Models fitted on docs and labels, and their scores of every document, from one table of features."""
    features = staging.staged(view_features(docs))
    return score_features(features, fit_features(features, labels, settings), settings)
