"""Benchmark passages in documents, by Wu-Manber multi-pattern search over words.

The test strings are the windows of an item: ten consecutive words, or all words of a shorter item. Words are
numbered by the windows' vocabulary; a text becomes a row of numbers, 0 for words no window has. Windows of one
length share three tables: for each block of ``BLOCK`` words the shift that is safe when the block ends at the
current position; for blocks that end a window (shift 0) the bucket of those windows by the hash of that suffix;
and the hash of each window's first block. A search looks at the block that ends at its position and jumps by the
shift; only at shift 0 the bucket's windows with the same first block are compared word by word. Many positions of
a batch, one in each of some thousand equal lengths of text, move at once.

Documents are not shuffled. The windows travel to the tasks; items are taken in parts of at most ``MOST_WORDS``
words, each part its own pass, whose finds are united by document, so the tables' size is bounded whatever the
benchmark's size.

Defined results: a null text has no words; an item without words has no window; items are told apart by their id
as text (a null id as the empty text), so rows that share an id are one item; repeated documents are judged each
for itself; empty tables give no row, or no hit. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.llm.terms import raw_texts, slices, word_numbers, words_of
from flowsift.operators.staging import staged

WINDOW_WORDS = 10
BLOCK = 3
MOST_WORDS = 1 << 20
LANES = 4096
PAIRS_AT_ONCE = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    h = columns[0].astype(np.uint64)
    for c in columns[1:]:
        h = (h * _FACTOR) ^ (h >> np.uint64(29)) ^ c.astype(np.uint64)
    return h * _FACTOR


@dataclass
class Shifts:
    """Tables of the windows of one length; patterns has a row of word numbers for each."""

    patterns: np.ndarray
    first_number: int

    def __post_init__(self):
        count, self.length = self.patterns.shape
        self.block = min(BLOCK, self.length)
        self.bits = max(12, (4 * count * self.length).bit_length())
        most = self.length - self.block + 1
        self.shift = np.full(1 << self.bits, most, np.int32)
        for end in range(self.block, self.length + 1):
            np.minimum.at(self.shift, self._at([self.patterns[:, k] for k in range(end - self.block, end)]), self.length - end)
        suffix = self._at([self.patterns[:, k] for k in range(self.length - self.block, self.length)])
        self.order = np.argsort(suffix, kind="stable")
        self.bucket = np.searchsorted(suffix[self.order], np.arange((1 << self.bits) + 1))
        self.prefix = _hash([self.patterns[:, k] for k in range(self.block)])

    def _at(self, columns: list[np.ndarray]) -> np.ndarray:
        return (_hash(columns) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _block_ending(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._at([text[at - k] for k in range(self.block - 1, -1, -1)])

    def candidates(self, text: np.ndarray) -> np.ndarray:
        """Positions of last words where the shift is 0."""
        first = self.length - 1
        if len(text) <= first:
            return np.empty(0, np.int64)
        starts = np.linspace(first, len(text), min(LANES, len(text) - first) + 1).astype(np.int64)
        at, stop = starts[:-1].copy(), starts[1:]
        found = []
        while len(at):
            step = self.shift[self._block_ending(text, at)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.sort(np.concatenate(found))

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window number) of every occurrence."""
        ends = self.candidates(text)
        bucket = self._block_ending(text, ends) if len(ends) else ends
        sizes = self.bucket[bucket + 1] - self.bucket[bucket]
        begins, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        upto, i = np.cumsum(sizes), 0
        while i < len(ends):  # so many (position, window) pairs at once, or one position's
            j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PAIRS_AT_ONCE, "right")))
            n = sizes[i:j]
            begin = np.repeat(ends[i:j] - self.length + 1, n)
            inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            which = self.order[np.repeat(self.bucket[bucket[i:j]], n) + inside]
            same = _hash([text[begin + k] for k in range(self.block)]) == self.prefix[which]
            begin, which = begin[same], which[same]
            for k in range(self.length):
                same = text[begin + k] == self.patterns[which, k]
                begin, which = begin[same], which[same]
            begins.append(begin)
            numbers.append(which + self.first_number)
            i = j
        return np.concatenate(begins), np.concatenate(numbers)


@dataclass
class Windows:
    """The windows of some items: vocabulary, tables by length, and the items of each window."""

    vocabulary: dict[bytes, int]
    tables: list[Shifts]
    items: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[str, list[str]]], words: int = WINDOW_WORDS) -> "Windows":
        vocabulary: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, parts in items:
            row = [vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in parts]
            length = min(words, len(row))
            for i in range(len(row) - length + 1 if row else 0):
                by_length[length][tuple(row[i:i + length])].add(item)
        tables, owners = [], []
        for length in sorted(by_length):
            tables.append(Shifts(np.asarray(list(by_length[length]), np.int32), len(owners)))
            owners += [sorted(s) for s in by_length[length].values()]
        return cls(vocabulary, tables, owners)

    def find(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text its number of words, the disjoint spans of words that are hit, and the items."""
        numbers = [word_numbers(t, self.vocabulary) for t in texts]
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        starts = np.cumsum(sizes + 1) - sizes - 1
        stream = np.zeros(int((sizes + 1).sum()), np.int32)  # a 0 after each text: no window reaches across
        for s, row in zip(starts, numbers):
            stream[s:s + len(row)] = row
        edges = np.zeros(len(stream) + 1, np.int32)
        owned: dict[int, set[str]] = defaultdict(set)
        for table in self.tables:
            begin, which = table.occurrences(stream)
            np.add.at(edges, begin, 1)
            np.add.at(edges, begin + table.length, -1)
            text_of = np.searchsorted(starts, begin, "right") - 1
            for t, w in np.unique(np.stack([text_of, which], axis=1), axis=0).tolist():
                owned[t].update(self.items[w])
        turn = np.diff(np.concatenate([[0], np.cumsum(edges) > 0]).astype(np.int8))
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for b, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            t = int(np.searchsorted(starts, b, "right")) - 1
            spans[t].append((b - int(starts[t]), e - int(starts[t])))
        return [(int(n), spans.get(t, []), sorted(owned.get(t, ()))) for t, n in enumerate(sizes)]


FOUND = "row_no long, doc_id long, n_words long, spans array<struct<begin:long,stop:long>>, items array<string>"


def _finder(windows: Windows):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = windows.find(raw_texts(part, "text"))
                span = pa.struct([("begin", pa.int64()), ("stop", pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_no"), part.column("doc_id"), pa.array([f[0] for f in found], pa.int64()),
                     pa.array([[{"begin": b, "stop": e} for b, e in f[1]] for f in found], pa.list_(span)),
                     pa.array([f[2] for f in found], pa.list_(pa.string()))],
                    names=["row_no", "doc_id", "n_words", "spans", "items"])

    return rows


def _united(spans: Column) -> Column:
    """Words inside any of the spans, in order of their begin; spans of two passes may overlap."""
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))
    return F.aggregate(F.array_sort(spans), start, lambda a, s: F.struct(
        (a["n"] + F.greatest(F.lit(0).cast("bigint"), s["stop"] - F.greatest(s["begin"], a["upto"]))).alias("n"),
        F.greatest(s["stop"], a["upto"]).alias("upto")), lambda a: a["n"])


def occurrences(docs: DataFrame, benchmark: DataFrame, words: int = WINDOW_WORDS, most_words: int = MOST_WORDS) -> DataFrame:
    """row_no, doc_id, n_words, spans (disjoint, in words), items (ids as text) of every row of docs."""
    items = staged(benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text").cast("string")).alias("words")))
    parts = max(1, -(-(items.agg(F.sum(F.size("words"))).first()[0] or 0) // most_words))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = staged(rows) if parts > 1 else rows
    found = None
    for part in range(parts):
        own = items.filter(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part).collect()  # about most_words words
        windows = Windows.of([(r["item"], r["words"]) for r in own], words)
        one = rows.mapInArrow(_finder(windows), FOUND)
        found = one if found is None else found.union(one)
    if parts == 1:
        return found
    return found.groupBy("row_no").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = WINDOW_WORDS, most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs."""
    found = occurrences(docs, benchmark, words, most_words)
    hit = _united(F.col("spans"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))
