"""Ranked lexical search over documents by hybrid term-at-a-time and document-at-a-time evaluation.

The index is partitioned by documents. One pass reads the texts and keeps, of each document, its length and the
counts of the query terms; sums over it give the number of documents, all terms, and the documents that hold each
term. A second pass forms shards of ``SHARD_DOCS`` documents in the order of doc_id, inverts them into one posting
list a term with the final addend of each posting, and answers every query in every shard:

* the short lists are summed term at a time into accumulators. Accumulators are partial scores, so the k-th largest
  is a first threshold;
* the accumulators are then one more list, its bound the largest accumulator, among the long lists with their own
  largest addends. Lists are ordered by bound; those whose bounds together cannot pass the threshold are not
  essential. A stretch of documents takes its candidates from the essential lists only, and looks the others up by
  skipping, largest bound first, while a candidate can still pass the threshold.

Shards give at most k documents a query, so the last step ranks k rows a shard and query, cut before its shuffle.
A threshold found in a shard serves the later shards of the task, but there a tie may still win by its doc_id, so
it is lowered by one.

Nothing is shuffled but those rows. Queries travel to the tasks in parts of at most ``MOST_TERMS`` terms, each part
its own passes, so what travels is bounded whatever the number of queries.

Defined results: a null or empty text has no term; an item without terms, or whose terms no document has, gives no
row; repeated documents and repeated items are ranked each for itself; equal scores go by doc_id, null last; empty
tables give no row. Only doc_id and text, item_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.terms import raw_texts, slices, word_numbers, words_of
from flowsift.operators.staging import staged

MOST_TERMS = 1 << 20
SHARD_DOCS = 8192


@dataclass(frozen=True)
class Settings:
    """k results an item; documents of a shard; lists of at most a ``short``-th of a shard are short; documents
    looked at together."""

    k: int = 10
    shard_docs: int = SHARD_DOCS
    short: int = 16
    stretch: int = 1024


# ---- one shard ----

class Shard:
    """Posting lists of one shard: of term t, docs[starts[t]:starts[t + 1]] ascending and their addends."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, addends: np.ndarray, terms_in_all: int, size: int):
        order = np.argsort(terms, kind="stable")  # documents stay in order inside a term
        self.docs, self.addends, self.size = docs[order], addends[order], size
        self.starts = np.searchsorted(terms[order], np.arange(terms_in_all + 2))
        self.sums = np.zeros(size, np.int64)

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.docs[a:b], self.addends[a:b]

    def accumulators(self, terms: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Term at a time: (documents ascending, summed addends) of these lists."""
        touched = []
        for t in terms:
            docs, addends = self.list_of(t)
            self.sums[docs] += addends
            touched.append(docs)
        docs = np.unique(np.concatenate(touched)) if touched else np.empty(0, np.int64)
        sums = self.sums[docs]
        self.sums[docs] = 0
        return docs[sums > 0], sums[sums > 0]

    def best(self, terms: np.ndarray, settings: Settings, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of the k best with a score above ``floor``, best first, ties to the earlier document."""
        sizes = self.starts[terms + 1] - self.starts[terms]
        limit = self.size // settings.short
        short = terms[(sizes > 0) & (sizes <= limit)].tolist()
        lists = [self.list_of(t) for t in terms[sizes > limit].tolist()]
        summed = self.accumulators(short)
        if len(summed[0]) >= settings.k:
            floor = max(floor, int(np.partition(summed[1], -settings.k)[-settings.k]) - 1)
        lists = [x for x in [*lists, summed] if len(x[0]) and x[1].max() > 0]
        bounds = [int(x[1].max()) for x in lists]
        by_bound = np.argsort(bounds, kind="stable").tolist()
        lists, reach = [lists[i] for i in by_bound], np.cumsum([bounds[i] for i in by_bound]).tolist()
        docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
        for first in range(0, self.size, settings.stretch):
            essential = next((i for i, r in enumerate(reach) if r > floor), len(lists))
            if essential == len(lists):
                break  # no document left can pass
            part = np.zeros(settings.stretch, np.int64)
            for own, addends in lists[essential:]:
                a, b = np.searchsorted(own, (first, first + settings.stretch))
                part[own[a:b] - first] += addends[a:b]
            found = np.flatnonzero(part)
            for i in range(essential - 1, -1, -1):
                found = found[part[found] + reach[i] > floor]
                if not len(found):
                    break
                own, addends = lists[i]
                at = np.searchsorted(own, found + first)
                met = at < len(own)
                met[met] = own[at[met]] == found[met] + first
                part[found[met]] += addends[at[met]]
            found = found[part[found] > floor]
            if len(found):
                docs, scores = np.concatenate([docs, found + first]), np.concatenate([scores, part[found]])
                top = np.lexsort((docs, -scores))[:settings.k]
                docs, scores = docs[top], scores[top]
                if len(docs) == settings.k:
                    floor = max(floor, int(scores[-1]))
        return docs, scores


# ---- the passes ----

def _counter(vocabulary: dict[bytes, int]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(len(vocabulary) + 1)
        for batch in batches:
            for part in slices(batch, "text"):
                numbers = [word_numbers(t, vocabulary) for t in raw_texts(part, "text")]
                sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
                row = np.repeat(np.arange(len(numbers)), sizes)
                flat = np.concatenate(numbers)
                known = flat > 0
                key, tf = np.unique(row[known] * wide + flat[known], return_counts=True)
                cut = np.searchsorted(key, np.arange(len(numbers) + 1) * wide)
                terms, tf = (key % wide).astype("<i4"), tf.astype("<i4")
                pack = lambda x: pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes), pack(terms), pack(tf)], names=["doc_id", "n", "terms", "tf"])

    return rows


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, documents that hold it) of each batch."""
    for batch in batches:
        terms = np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4")
        term, df = np.unique(terms, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(df, pa.int64())], names=["term", "df"])


def _searcher(queries: list[tuple[int, np.ndarray]], weights: np.ndarray, documents: int, all_terms: int, settings: Settings):
    def shard_rows(table: pa.Table, floors: np.ndarray) -> pa.RecordBatch:
        ids = table.column("doc_id").combine_chunks()
        none = np.asarray(ids.is_null())
        order = np.lexsort((np.asarray(ids.fill_null(0)), none))
        table = table.take(pa.array(order))
        terms, tf = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<i4").astype(np.int64) for c in ("terms", "tf"))
        held = np.asarray([len(t) // 4 for t in table.column("terms").to_pylist()], np.int64)
        docs = np.repeat(np.arange(len(held)), held)
        m = 10 + 90 * np.asarray(table.column("n")) * documents // all_terms
        addends = weights[terms] * (1_000_000_000 * tf // (1000 * tf + 8 * m[docs]))
        shard = Shard(terms, docs, addends, len(weights) - 1, len(held))
        items, found, scores = [], [], []
        for q, (item, wanted) in enumerate(queries):
            d, s = shard.best(wanted, settings, int(floors[q]))
            items.append(np.full(len(d), item))
            found.append(d)
            scores.append(s)
            if len(d) == settings.k:
                floors[q] = max(floors[q], int(s[-1]) - 1)
        at = np.concatenate(found).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(items).astype(np.int64)), table.column("doc_id").combine_chunks().take(pa.array(at)),
             pa.array(np.concatenate(scores).astype(np.int64))], names=["item_no", "doc_id", "score"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors = np.zeros(len(queries), np.int64)
        held, size = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, settings.shard_docs - size)
                batch = batch.slice(part.num_rows)
                held.append(part)
                size += part.num_rows
                if size == settings.shard_docs:
                    yield shard_rows(pa.Table.from_batches(held), floors)
                    held, size = [], 0
        if size:
            yield shard_rows(pa.Table.from_batches(held), floors)

    return rows


def _part_hits(docs: DataFrame, own: list, settings: Settings) -> DataFrame | None:
    """(item_no, doc_id, score): the k best of each shard for the items ``own`` (item_no, words)."""
    vocabulary: dict[bytes, int] = {}
    queries = []
    for r in own:
        terms = {vocabulary.setdefault(w.encode(), len(vocabulary) + 1) for w in r["words"]}
        queries.append((r["item_no"], np.asarray(sorted(terms), np.int64)))
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = staged(source.mapInArrow(_counter(vocabulary), "doc_id long, n long, terms binary, tf binary").filter("n > 0"))
    documents, all_terms = counted.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not documents:
        return None
    weight = F.floor(1000 * F.log((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("bigint")
    by_term = counted.select("terms").mapInArrow(_holders, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = np.zeros(len(vocabulary) + 1, np.int64)
    for r in by_term.select("term", weight.alias("w")).collect():  # at most MOST_TERMS rows
        weights[r["term"]] = r["w"]
    return counted.mapInArrow(
        _searcher(queries, weights, documents, all_terms, settings), "item_no long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, settings: Settings = Settings(), most_terms: int = MOST_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of each item with the highest score above 0."""
    asked = staged(items.select(
        F.monotonically_increasing_id().alias("item_no"), "item_id", F.array_distinct(words_of(F.col("text").cast("string"))).alias("words")))
    parts = max(1, -(-(asked.agg(F.sum(F.size("words"))).first()[0] or 0) // most_terms))
    hits = None
    for part in range(parts):
        own = asked.filter(F.size("words") > 0).filter(F.pmod(F.xxhash64("item_no"), F.lit(parts)) == part).select("item_no", "words").collect()
        one = _part_hits(docs, own, settings) if own else None
        if one is not None:
            hits = one if hits is None else hits.union(one)
    if hits is None:
        return asked.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    order = Window.partitionBy("item_no").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.k)
    return ranked.join(asked.select("item_no", "item_id"), "item_no").select("item_id", "rank", "doc_id", "score")
