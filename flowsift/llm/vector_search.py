"""Nearest vectors by largest inner product, with multiprobe p-stable hashing.

Vectors are brought to one length by an added component, so that the largest inner product is the smallest
distance. Each of a few tables hashes a vector by several functions floor((a.v + b) / w) with Gaussian a. A query
visits buckets in the order of the estimated chance that they hold a near vector, by perturbation sets, until the
chances it has visited add up to what the wanted recall needs. Candidates of all tables are merged and ranked by
their exact inner products in double precision.

A neighbour's projection is taken as normal around s times the query's, with variance 1 - s^2, where s is the
query's own normalised inner product with its k-th nearest in a bounded sample (smaller in a sample than in all
rows, so the estimate is careful); a query with too few known rows takes the sample's mean. Every row is indexed. A table of at most 2048 vectors is one bucket and so exact.

A query's k-th best score among an eighth of the rows, at most the sample, is a floor under its results: what lies
below it cannot be among the k best, so tasks return only candidates that can.

Buckets are cut into chunks of about ``chunk_rows`` vectors, which a query of the bucket all visits, so a hot
bucket is spread. Queries with too few results are run again with more probes.

Defined results: rows whose vec_id is null, and vectors that are null, of another length than the sample's, zero,
or hold null or non-finite components take no part. Ties go to the smaller vec_id. Repeated rows count once. An
empty table gives no row. Only vec_id and embedding are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.operators.staging import staged


@dataclass(frozen=True)
class Settings:
    """k results a query; tables; bucket width in standard deviations; estimated chance to find a neighbour."""

    k: int = 20
    tables: int = 2
    width: float = 3.0
    success: float = 0.93
    sample_rows: int = 4096
    sample_queries: int = 128
    one_bucket: int = 2048
    chunk_rows: int = 1024
    seed: int = 5


@dataclass
class Index:
    """Hash functions and what was fitted."""

    directions: np.ndarray  # tables x functions x (dimensions + 1)
    shifts: np.ndarray
    width: float
    longest: float
    similarity: float
    known_ids: np.ndarray  # the rows of the sample that set floors, each vec_id once
    known: np.ndarray

    def floors(self, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
        """Scores that at least k other rows reach, per query; minus infinity where fewer are known."""
        out = np.full(len(x), -np.inf)
        if len(self.known_ids) <= k:
            return out
        for i in range(0, len(x), 256):
            scores = np.einsum("qd,nd->qn", x[i:i + 256], self.known)
            scores[ids[i:i + 256, None] == self.known_ids[None, :]] = -np.inf
            out[i:i + 256] = np.partition(scores, -k, axis=1)[:, -k]
        return out

    def cells(self, unit: np.ndarray) -> np.ndarray:
        """tables x rows x functions: the cell of each projection."""
        at = np.einsum("tfd,nd->tnf", self.directions, unit) + self.shifts[:, None, :]
        return np.floor(at / self.width).astype(np.int32)


def _bucket(table: int, cell: np.ndarray) -> int:
    """The bucket's name as a signed 64-bit number."""
    return xxhash.xxh3_64_intdigest(cell.astype("<i4").tobytes(), seed=table) - (1 << 63)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles) of the rows that take part."""
    kept = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    # Null and non-finite components have no finite square sum; zero vectors have none above zero.
    total = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    kept = kept.withColumn("square", total)
    fine = F.col("square").isNotNull() & ~F.isnan("square") & (F.col("square") > 0) & (F.col("square") < float("inf"))
    return kept.filter(fine).withColumn("length", F.size("v"))


def fit(vectors: DataFrame, settings: Settings) -> tuple[Index, int] | None:
    """An index over ``usable`` rows, and their dimension, from a sample bounded by ``sample_rows``."""
    facts = vectors.agg(F.count(F.lit(1)).alias("n"), F.max("square").alias("m")).first()
    if not facts["n"]:
        return None
    sample = vectors.select("vec_id", "v", "length", F.xxhash64("vec_id").alias("h")).orderBy("h", "vec_id").limit(settings.sample_rows).toArrow()
    lengths = np.asarray(sample.column("length").to_pylist())
    dimension = int(np.bincount(lengths).argmax())
    rows = np.asarray([v for v, n in zip(sample.column("v").to_pylist(), lengths) if n == dimension])
    longest = math.sqrt(facts["m"])
    near = rows[:settings.sample_queries]
    scores = (near / np.linalg.norm(near, axis=1)[:, None]) @ (rows / longest).T
    scores[np.arange(len(near)), np.arange(len(near))] = -np.inf
    at = min(settings.k, len(rows) - 1)
    kth = np.sort(scores, axis=1)[:, -at] if at else np.zeros(1)
    similarity = float(np.clip(kth.mean(), 0.05, 0.98))
    functions = 0 if facts["n"] <= settings.one_bucket else round(math.log2(facts["n"]) / 2)
    draw = np.random.Generator(np.random.PCG64(settings.seed))
    tables = settings.tables if functions else 1
    directions = draw.standard_normal((tables, functions, dimension + 1))
    shifts = draw.uniform(0, settings.width, (tables, functions))
    part = min(len(rows), facts["n"] // 8)
    sample_ids = sample.column("vec_id").to_numpy()[lengths == dimension]
    known_ids, first = np.unique(sample_ids[:part], return_index=True)
    return Index(directions, shifts, settings.width, longest, similarity, known_ids, rows[first]), dimension


def _rows(column, dimension: int) -> np.ndarray:
    """The vectors of an Arrow list column as a matrix."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)


def _posted(index: Index, dimension: int):
    """(bucket, vec_id, v): each vector under its bucket of each table."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("v"), dimension)
            rest = np.sqrt(np.maximum(index.longest**2 - (x * x).sum(axis=1), 0.0))
            cells = index.cells(np.c_[x, rest] / index.longest)
            for t in range(len(cells)):
                names = [_bucket(t, c) for c in cells[t]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), batch.column("vec_id"), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())],
                    names=["bucket", "vec_id", "v"])

    return rows


def probe_order(logs: list[list[tuple[float, int]]], wanted: float) -> Iterator[tuple[float, list[int]]]:
    """(chance, cells) of buckets by falling chance, until the chances reach ``wanted``.

    logs[f]: (log chance, cell) of function f, best first. The best cell of every function is the start; each
    other cell is a perturbation with a cost. Sets of perturbations come from a heap: the least set is shifted to
    its next perturbation or expanded by it; sets with two cells of one function are passed over.
    """
    best = [c[0][1] for c in logs]
    base = sum(c[0][0] for c in logs)
    steps = sorted((c[0][0] - p, f, cell) for f, c in enumerate(logs) for p, cell in c[1:])
    seen = math.exp(base)
    yield seen, best
    heap = [(steps[0][0], (0,))] if steps else []
    while heap and seen < wanted:
        cost, chosen = heapq.heappop(heap)
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (cost - steps[last][0] + steps[last + 1][0], chosen[:-1] + (last + 1,)))
            heapq.heappush(heap, (cost + steps[last + 1][0], chosen + (last + 1,)))
        functions = [steps[i][1] for i in chosen]
        if len(set(functions)) < len(functions):
            continue
        cells = list(best)
        for i in chosen:
            cells[steps[i][1]] = steps[i][2]
        chance = math.exp(base - cost)
        seen += chance
        yield chance, cells


_ERF = np.vectorize(math.erf, otypes=[float])


def _probes(index: Index, dimension: int, success: float, k: int):
    """(bucket, vec_id, v, floor): each query under the buckets it visits, v being the query itself."""
    tables = len(index.directions)
    wanted = 1 - (1 - success) ** (1 / tables)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch.column("v"), dimension)
            norms = np.linalg.norm(x, axis=1)
            unit = np.c_[x / norms[:, None], np.zeros(len(x))]
            at = np.einsum("tfd,nd->tnf", index.directions, unit)
            raw = [r.tobytes() for r in x.astype("<f8")]
            floors = index.floors(batch.column("vec_id").to_numpy(), x, k)
            own = np.clip(floors / (norms * index.longest), -0.98, 0.98)
            s = np.where(np.isfinite(floors), own, index.similarity)[:, None]
            spread = np.sqrt(1 - s * s)
            for t in range(tables):
                middle = s * at[t]
                names, who = [], []
                # Cells within five deviations of where a neighbour is expected.
                first = np.floor((middle - 5 * spread + index.shifts[t]) / index.width).astype(int)
                last = np.floor((middle + 5 * spread + index.shifts[t]) / index.width).astype(int)
                for i in range(len(x)):
                    logs = []
                    for f in range(at.shape[2]):
                        cells = np.arange(first[i, f], last[i, f] + 1)
                        edges = (np.r_[cells, cells[-1] + 1] * index.width - index.shifts[t, f] - middle[i, f]) / (spread[i, 0] * math.sqrt(2))
                        p = np.diff(_ERF(edges)) / 2
                        logs.append(sorted(((math.log(max(q, 1e-300)), int(c)) for q, c in zip(p, cells)), reverse=True))
                    for _, cells in probe_order(logs, wanted):
                        names.append(_bucket(t, np.asarray(cells)))
                        who.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), batch.column("vec_id").take(pa.array(who, pa.int64())), pa.array([raw[i] for i in who], pa.binary()),
                     pa.array(floors[who])],
                    names=["bucket", "vec_id", "v", "floor"])

    return rows


def _searched(k: int, dimension: int):
    """The k best of each query among the buckets of a task. Rows come by bucket and chunk, vectors before queries."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        here = None
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held: tuple[np.ndarray, np.ndarray] | None = None
        none = (np.empty(0), np.empty(0, np.int64))
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in ("bucket", "chunk", "is_query")], axis=1)
            ids = batch.column("vec_id").to_numpy()
            raw = batch.column("v")
            floors = batch.column("floor").to_numpy(zero_copy_only=False)
            stops = np.r_[np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)] if len(key) else []
            start = 0
            for stop in stops:
                bucket, chunk, is_query = key[start].tolist()
                x = np.frombuffer(b"".join(raw.slice(start, stop - start).to_pylist()), "<f8").reshape(-1, dimension)
                if here != (bucket, chunk):
                    here, parts, held = (bucket, chunk), [], None
                if not is_query:
                    parts.append((ids[start:stop], x))
                    held = None
                elif parts:
                    if held is None:
                        held = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                        parts = [held]
                    for i in range(0, len(x), 256):
                        # Summed in one order for every pair: equal vectors have equal scores wherever they are.
                        scores = np.einsum("qd,nd->qn", x[i:i + 256], held[1])
                        for row, query, floor in zip(scores, ids[start + i:start + i + 256].tolist(), floors[start + i:start + i + 256].tolist()):
                            top, names = best.get(query, none)
                            good = np.flatnonzero(row >= (max(top[-1], floor) if len(top) == k else floor))
                            if not len(good):
                                continue
                            all_names, all_scores = np.r_[names, held[0][good]], np.r_[top, row[good]]
                            own = all_names != query
                            all_names, all_scores = all_names[own], all_scores[own]
                            all_names, at = np.unique(all_names, return_index=True)
                            all_scores = all_scores[at]
                            order = np.lexsort((all_names, -all_scores))[:k]
                            best[query] = all_scores[order], all_names[order]
                start = stop
        if best:
            names = np.repeat(np.fromiter(best, np.int64, len(best)), [len(v[0]) for v in best.values()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names), pa.array(np.concatenate([v[1] for v in best.values()]), pa.int64()),
                 pa.array(np.concatenate([v[0] for v in best.values()]), pa.float64())],
                names=["query_id", "vec_id", "score"])

    return rows


def _search(index: Index, dimension: int, posted: DataFrame, sizes: DataFrame, queries: DataFrame, settings: Settings, success: float) -> DataFrame:
    """query_id, rank, vec_id, score."""
    asked = queries.select("vec_id", "v").mapInArrow(
        _probes(index, dimension, success, settings.k), "bucket long, vec_id long, v binary, floor double")
    chunk = F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")
    stored = posted.join(sizes, "bucket").select("bucket", chunk.alias("chunk"), F.lit(0).alias("is_query"), "vec_id", "v", F.lit(0.0).alias("floor"))
    visits = asked.join(sizes, "bucket").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(1).alias("is_query"), "vec_id", "v", "floor")
    dealt = stored.union(visits).repartition("bucket", "chunk").sortWithinPartitions("bucket", "chunk", "is_query", "vec_id")
    found = dealt.mapInArrow(_searched(settings.k, dimension), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= settings.k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row for which ``is_query`` (over vec_id) holds."""
    rows = staged(usable(vectors))
    fitted = fit(rows, settings)
    if fitted is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    index, dimension = fitted
    rows = rows.filter(F.col("length") == dimension)
    posted = staged(rows.select("vec_id", "v").mapInArrow(_posted(index, dimension), "bucket long, vec_id long, v binary"))
    sizes = staged(posted.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / settings.chunk_rows).cast("int").alias("chunks")))
    queries = rows.filter(is_query)
    result = staged(_search(index, dimension, posted, sizes, queries, settings, settings.success))
    enough = min(settings.k, rows.select("vec_id").distinct().count() - 1)
    for success in (0.999, 1 - 1e-7):
        short = queries.join(
            result.groupBy("query_id").count().filter(F.col("count") >= enough).select(F.col("query_id").alias("vec_id")), "vec_id", "left_anti")
        if enough < 1 or short.isEmpty():
            break
        again = staged(_search(index, dimension, posted, sizes, short, settings, success))
        result = staged(result.join(again.select("query_id").distinct(), "query_id", "left_anti").unionByName(again))
    return result
