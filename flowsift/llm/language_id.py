"""Language identification by segmentation-marginalised unigrams.

A language is a probability of each piece of a fixed public vocabulary. A word's probability is the sum over all
ways to cut it into pieces, by the forward algorithm; a text's is the product over its words. Piece probabilities
are trained by expectation maximisation (forward-backward) on word counts of labelled documents.

Words are runs of letters, lower-cased, with the vocabulary's word mark before them. A run longer than 30 letters
is cut every 30 letters, and all parts count. The forward algorithm runs over all different words of a batch at
once and knows the words it has seen before.

Defined results: a text that is null or has no letter gets `und` with score 0; so does every text when nothing
was learned. Ties go to the language that sorts first. A null doc_id counts as the empty text in the fold. An
empty table gives no row. Repeated rows are predicted alike. lang is read for training alone.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowsift.llm.common import freeing, text_or_empty
from flowsift.llm.terms import slices
from flowsift.operators.staging import staged

WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
LONGEST_WORD = 30
LONGEST_PIECE = 10
UNKNOWN = 1e-7
#: A factor per letter that keeps products of probabilities inside the range of doubles.
SCALE = 20.0
UNDETERMINED = "und"
FOLDS = 5


@dataclass(frozen=True)
class Settings:
    """train_documents bounds the labelled rows that are learned from (drawn by hash); rounds of maximisation."""

    train_documents: int = 20_000
    rounds: int = 3
    smooth: float = 0.05
    known_words: int = 200_000


def stretches(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A text in stretches of about ``size`` characters, cut at white space, so that its words are never all held."""
    at = 0
    while at < len(text):
        space = re.compile(r"\s").search(text, at + size)
        stop = space.start() if space else len(text)
        yield text[at:stop]
        at = stop


def words_of(text: str) -> list[str]:
    found = WORD.findall(text.lower())
    if any(len(w) > LONGEST_WORD for w in found):
        found = [w[i:i + LONGEST_WORD] for w in found for i in range(0, len(w), LONGEST_WORD)]
    return found


def vocabulary(path: str) -> list[str]:
    """Pieces of a sentencepiece file that text can hold, at most LONGEST_PIECE characters."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and len(model.id_to_piece(i)) <= LONGEST_PIECE]


_PRIME = np.uint64(1_099_511_628_211)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), length).astype(np.uint64)


@dataclass
class Pieces:
    """Finds pieces in words: per length, the sorted hashes and numbers of the pieces of that length."""

    pieces: list[str]
    tables: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def __post_init__(self):
        for length in range(1, LONGEST_PIECE + 1):
            own = [i for i, p in enumerate(self.pieces) if len(p) == length]
            codes = _codes([self.pieces[i] for i in own], length) if own else np.empty((0, length), np.uint64)
            hashes = self._hash(codes, length)[:, 0] if own else np.empty(0, np.uint64)
            order = np.argsort(hashes)
            self.tables.append((hashes[order], np.asarray(own, np.int64)[order]))

    @staticmethod
    def _hash(codes: np.ndarray, length: int) -> np.ndarray:
        n = codes.shape[1] - length + 1
        out = np.full((codes.shape[0], n), np.uint64(14_695_981_039_346_656_037))
        for k in range(length):
            out = (out ^ codes[:, k:k + n]) * _PRIME
        return out ^ (out >> np.uint64(29))

    def found(self, codes: np.ndarray) -> list[np.ndarray]:
        """Per piece length: the piece number at each place of each word, or -1."""
        out = []
        for length in range(1, min(LONGEST_PIECE, codes.shape[1]) + 1):
            keys, numbers = self.tables[length - 1]
            hashes = self._hash(codes, length)
            if not len(keys):
                out.append(np.full(hashes.shape, -1, np.int64))
                continue
            at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            out.append(np.where(keys[at] == hashes, numbers[at], -1))
        return out


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of the words of each length, marked, a few thousand at a time."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(lengths):
        places = np.flatnonzero(lengths == length)
        for i in range(0, len(places), 4096):
            part = places[i:i + 4096]
            yield part, _codes([MARK + words[k] for k in part], int(length) + 1)


def forward(ids: list[np.ndarray], table: np.ndarray, n: int) -> np.ndarray:
    """alpha[word, place, language], scaled by SCALE per letter. table[-1] is the row of what is no piece: 0."""
    alpha = np.zeros((ids[0].shape[0], n + 1, table.shape[1]))
    alpha[:, 0] = 1.0
    for end in range(1, n + 1):
        for length in range(1, min(end, len(ids)) + 1):
            piece = ids[length - 1][:, end - length]
            p = table[piece]
            if length == 1:
                p = np.where(piece[:, None] < 0, UNKNOWN, p)
            alpha[:, end] += alpha[:, end - length] * (p * SCALE**length)
    return alpha


def log_probabilities(pieces: Pieces, table: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language), a row per word."""
    out = np.empty((len(words), table.shape[1]))
    for places, codes in _by_length(words):
        n = codes.shape[1]
        out[places] = np.log(forward(pieces.found(codes), table, n)[:, n]) - n * np.log(SCALE)
    return out


def expected_counts(pieces: Pieces, column: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is used over all segmentations of the words, under one language's probabilities."""
    total = np.zeros(len(pieces.pieces) + 1)
    table = column[:, None]
    for places, codes in _by_length(words):
        n = codes.shape[1]
        ids = pieces.found(codes)
        alpha = forward(ids, table, n)[:, :, 0]
        beta = np.zeros_like(alpha)
        beta[:, n] = 1.0
        for start in range(n - 1, -1, -1):
            for length in range(1, min(n - start, len(ids)) + 1):
                piece = ids[length - 1][:, start]
                p = column[piece]
                if length == 1:
                    p = np.where(piece < 0, UNKNOWN, p)
                use = p * SCALE**length * beta[:, start + length]
                beta[:, start] += use
                total += np.bincount(
                    np.where(piece < 0, len(pieces.pieces), piece), alpha[:, start] * use / alpha[:, n] * counts[places],
                    minlength=len(total))
    return total[:-1]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    table: np.ndarray


def fit(docs: DataFrame, vocabulary_path: str, settings: Settings = Settings()) -> Model:
    """Learn from text and lang of the labelled documents outside the held-out fold.

    At most about ``train_documents`` rows are drawn, by the hash of the doc_id: each language has the same bound,
    and all rows of a language within it are drawn. Rows without doc_id are in the held-out fold. Word counts are a table; each
    round maps its parts to expected counts, which are summed before at most pieces x languages of them come back.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    sizes = staged(labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count(F.lit(1)).alias("_n")))
    most = max(1, settings.train_documents // max(1, sizes.count()))
    share = F.greatest(F.lit(1).cast("bigint"), F.ceil(F.col("_n") / most))
    picked = labelled.join(sizes, F.col("lang") == F.col("_lang")).filter(F.pmod(F.xxhash64(F.col("doc_id")), share) == 0)

    def count_words(batches):
        for batch in batches:
            held: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                for part in stretches(text.as_py()):
                    held.setdefault(lang, Counter()).update(words_of(part))
            rows = [(lang, w, n) for lang, c in held.items() for w, n in c.items()]
            lang, word, n = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    counted = picked.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(
        freeing(count_words), "lang string, word string, n long")
    table = staged(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")))
    languages = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    names = vocabulary(vocabulary_path)
    finder = Pieces(names)
    # Start: longer pieces are rarer.
    lengths = np.asarray([len(p) for p in names])
    start = 0.1 ** lengths / (0.1 ** lengths).sum()
    probabilities = np.repeat(np.r_[start, 0.0][:, None], len(languages), axis=1)
    for _ in range(settings.rounds if languages else 0):
        known = dict(zip(languages, range(len(languages))))
        current = probabilities

        def expect(batches, known=known, current=current):
            sums = {}
            for batch in batches:
                langs = np.asarray([known[x] for x in batch.column("lang").to_pylist()], np.int64)
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for g in np.unique(langs):
                    at = np.flatnonzero(langs == g)
                    got = expected_counts(finder, current[:, g], [words[i] for i in at], n[at])
                    sums[g] = sums[g] + got if g in sums else got
            for g, got in sums.items():
                used = np.flatnonzero(got > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), g, np.int64)), pa.array(used, pa.int64()), pa.array(got[used], pa.float64())], names=["g", "piece", "n"])

        sums = table.mapInArrow(freeing(expect), "g long, piece long, n double").groupBy("g", "piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.full((len(names), len(languages)), settings.smooth)
        counts[sums.column("piece").to_numpy(), sums.column("g").to_numpy()] += sums.column("n").to_numpy()
        probabilities = np.r_[counts / counts.sum(axis=0), np.zeros((1, len(languages)))]
    return Model(languages, names, probabilities)


class Judge:
    """Languages of texts under a model; remembers the words it has scored, about ``known_words`` of them."""

    def __init__(self, model: Model, known_words: int):
        self.model, self.known_words = model, known_words
        self.finder = Pieces(model.pieces)
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[str, int] = {}
        self.scored = 0
        self.table = np.empty((1 << 12, len(self.model.languages)))

    def _learn(self) -> None:
        known = len(self.numbers)
        new = list(itertools.islice(reversed(self.numbers), known - self.scored))[::-1]
        if known > len(self.table):
            more = np.empty((max(known, 2 * len(self.table)), self.table.shape[1]))
            more[:self.scored] = self.table[:self.scored]
            self.table = more
        if new:
            self.table[self.scored:known] = log_probabilities(self.finder, self.model.table, new)
        self.scored = known

    def _score(self, texts: list[np.ndarray]) -> list[tuple[str, float]]:
        self._learn()
        out = []
        for at in texts:
            if not len(at) or not self.model.languages:
                out.append((UNDETERMINED, 0.0))
                continue
            total = self.table[at].sum(axis=0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1.0 / np.exp(total - total[best]).sum())))
        return out

    def answers(self, texts: pa.Array) -> list[tuple[str, float]]:
        """Language and score of each whole text."""
        out: list[tuple[str, float]] = []
        waiting: list[np.ndarray] = []
        number = self.numbers.setdefault
        for text in texts:
            parts = [np.empty(0, np.int32)]
            for part in stretches(text.as_py()):
                found = words_of(part)
                parts.append(np.fromiter((number(w, len(self.numbers)) for w in found), np.int32, len(found)))
            waiting.append(np.concatenate(parts))
            if len(self.numbers) > self.known_words:  # bounded memory: forget and start again
                out += self._score(waiting)
                waiting = []
                self._forget()
                number = self.numbers.setdefault
        return out + self._score(waiting)


def predict(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    source = docs.select(F.col("doc_id"), (fold(F.col("doc_id")) == 0).alias("held_out"), text_or_empty().alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model, settings.known_words)
        for batch in batches:
            for part in slices(batch, "text"):
                names, scores = zip(*judge.answers(part.column("text")))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(source.dtypes)["doc_id"]
    return source.mapInArrow(freeing(rows), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model, least_score: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs whose language is determined with at least ``least_score``, all columns."""
    # The row travels as one struct, so that its column names meet no others.
    tagged = docs.select(F.struct("*").alias("row"), text_or_empty().alias("text"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(model, settings.known_words)
        for batch in batches:
            for part in slices(batch, "text"):
                good = [p != UNDETERMINED and s >= least_score for p, s in judge.answers(part.column("text"))]
                yield part.select(["row"]).filter(pa.array(good, pa.bool_()))

    return tagged.mapInArrow(freeing(keep), StructType([tagged.schema["row"]])).select("row.*")
