"""Packing documents into fixed windows by non-negative least squares.

A document longer than the window gives full windows and a remainder. The histogram of remainder lengths is what
the plan is made from: shallow combinations of lengths that fill a window exactly are enumerated, repeat counts
that reproduce the histogram are solved by non-negative least squares and rounded, exact complements are paired
greedily, and the rest follow each other from window to window, cut at window ends. Plan and histogram have at
most a few entries a length, whatever the data; documents find their place by their rank among equal lengths,
which is counted in chunks, so a length that a third of all documents have is no single task.

The last, part-filled window is cut into windows of powers of two, which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for itself; an empty
table gives no row. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.common import chunk_count, freeing, text_or_empty
from flowsift.llm.terms import SLICE_BYTES, slices
from flowsift.llm.tokens import shared_encoder
from flowsift.operators.staging import staged

WINDOW = 2048
END = 1
MOST_COPIES = 8


# ---- the plan: from a histogram of lengths to places ----

def combinations(counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Length tuples that sum to the window, of lengths that occur: pairs, triples near an even split of what one
    length leaves, and several copies of a length with its filler."""
    have = lambda *lengths: all(0 < x < window and counts[x] for x in lengths)
    found = set()
    steps = sorted({0, 1, 2, 5, 11, 23, 47, 95, 190, 380} & set(range(window)))
    for a in np.flatnonzero(counts[:window]).tolist():
        if not a:
            continue
        if have(window - a):
            found.add(tuple(sorted((a, window - a))))
        for step in steps:
            b = (window - a) // 2 - step
            if b > 0 and have(b, window - a - b):
                found.add(tuple(sorted((a, b, window - a - b))))
        for copies in range(2, MOST_COPIES + 1):
            rest = window - copies * a
            if rest == 0 or have(rest):
                found.add(tuple(sorted([a] * copies + ([rest] if rest else []))))
    return sorted(found)


def repeat_counts(combos: list[tuple[int, ...]], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Non-negative x with A x near counts in least squares, A having a column per combination.

    Projected gradient steps with momentum; a column's entries are how often it uses a length.
    """
    column = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    row = np.fromiter((x for c in combos for x in c), np.int64, len(column))
    n, m = len(counts), len(combos)
    forth = lambda x: np.bincount(row, x[column], minlength=n)
    back = lambda y: np.bincount(column, y[row], minlength=m)
    # A bound of the largest eigenvalue of A'A: largest row sum of A A'.
    bound = forth(back(np.ones(n))).max()
    x = np.zeros(m)
    z, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, z - back(forth(z) - counts) / bound)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


@dataclass
class Plan:
    """Where the r-th remainder of a length goes.

    placed: sorted rows (length, first rank, last rank + 1, first sequence, offset) of whole remainders. Ranks
    from used[length] on are in the stream, from stream_base[length] on. Sequences of the stream start at
    stream_sequence and end at stream_ends.
    """

    placed: np.ndarray
    used: np.ndarray
    stream_base: np.ndarray
    stream_sequence: int
    stream_ends: np.ndarray
    window: int

    def __post_init__(self):
        self.keys = self.placed[:, 0] * (1 << 44) + self.placed[:, 1]

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the remainder, length, sequence, offset)."""
        if rank < self.used[length]:
            k = np.searchsorted(self.keys, length * (1 << 44) + rank, "right") - 1
            _, first, _, sequence, offset = self.placed[k].tolist()
            return [(0, length, sequence + rank - first, offset)]
        at = int(self.stream_base[length] + (rank - self.used[length]) * length)
        whole = int(self.stream_ends[0]) if len(self.stream_ends) else 0
        out, done = [], 0
        while done < length:
            p = at + done
            if p < whole:
                k, begin, end = p // self.window, p // self.window * self.window, (p // self.window + 1) * self.window
            else:
                i = int(np.searchsorted(self.stream_ends, p, "right"))
                begin, end = int(self.stream_ends[i - 1]), int(self.stream_ends[i])
                k = whole // self.window + i - 1
            n = min(length - done, end - p)
            out.append((done, n, self.stream_sequence + k, p - begin))
            done += n
        return out


def make_plan(counts: np.ndarray, first_sequence: int, window: int = WINDOW) -> Plan:
    """counts[length] remainders of each length below the window."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    used = np.zeros(len(counts), np.int64)
    placed: list[tuple[int, int, int, int, int]] = []
    sequence = first_sequence

    def place(combo: tuple[int, ...], times: int) -> None:
        nonlocal sequence
        offset = 0
        for length in combo:
            placed.append((length, int(used[length]), int(used[length]) + times, sequence, offset))
            used[length] += times
            left[length] -= times
            offset += length
        sequence += times

    combos = combinations(left, window)
    if combos:
        wanted = np.rint(repeat_counts(combos, left.astype(float))).astype(np.int64)
        for k in np.argsort(-wanted, kind="stable").tolist():
            lengths, copies = np.unique(combos[k], return_counts=True)
            times = min(int(wanted[k]), int((left[lengths] // copies).min()))
            if times > 0:
                place(combos[k], times)
    for a in range(window - 1, (window - 1) // 2, -1):  # greedy: exact complements, longest first
        b = window - a
        times = int(min(left[a], left[b])) if a != b else int(left[a] // 2)
        if times > 0:
            place((a, b), times)
    base = np.zeros(len(counts), np.int64)
    total = 0
    for length in range(len(counts) - 1, 0, -1):
        base[length] = total
        total += int(left[length]) * length
    whole, tail = divmod(total, window)
    ends, at = [whole * window], whole * window
    for bit in range(window.bit_length(), -1, -1):
        if tail >> bit & 1:
            at += 1 << bit
            ends.append(at)
    table = np.asarray(sorted(placed), np.int64).reshape(-1, 5)
    return Plan(table, used, base, sequence, np.asarray(ends, np.int64), window)


# ---- the jobs ----

TOKENISED = "row_no long, doc_id {id}, doc_tokens long, full long, full_crcs array<long>, rem int, rem_ids binary"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenised(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """Token counts, the CRCs of full windows and the ids of the remainder of every row, written once."""
    source = docs.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", text_or_empty().alias("text"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer_path)
        small = encoder.vocabulary <= 1 << 16
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                tokens, crcs, rem, rest = [], [], [], []
                for ids in encoder.ids(part.column("text").to_pylist()):
                    ids = np.append(ids, np.uint32(END))
                    full = len(ids) // window
                    tokens.append(len(ids))
                    crcs.append([_crc(ids[k * window:(k + 1) * window]) for k in range(full)])
                    rem.append(len(ids) - full * window)
                    rest.append(ids[full * window:].astype("<u2" if small else "<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_no"), part.column("doc_id"), pa.array(tokens, pa.int64()), pa.array([len(c) for c in crcs], pa.int64()),
                     pa.array(crcs, pa.list_(pa.int64())), pa.array(rem, pa.int32()), pa.array(rest, pa.binary())],
                    names=["row_no", "doc_id", "doc_tokens", "full", "full_crcs", "rem", "rem_ids"])

    return staged(source.mapInArrow(freeing(rows), TOKENISED.format(id=dict(source.dtypes)["doc_id"])))


def _places(plan: Plan, window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            doc_index: list[int] = []
            cols = [batch.column(c).to_pylist() for c in ("doc_tokens", "full", "full_crcs", "rem", "rem_ids", "rank", "full_start")]
            for i, (tokens, full, crcs, rem, rest, rank, full_start) in enumerate(zip(*cols)):
                for k in range(full):
                    out.append((k * window, window, crcs[k], tokens, full_start + k, 0))
                if rem:
                    ids = np.frombuffer(rest, "<u2" if len(rest) == 2 * rem else "<u4")
                    for begin, n, sequence, offset in plan.pieces(rem, rank):
                        out.append((full * window + begin, n, _crc(ids[begin:begin + n]), tokens, sequence, offset))
                doc_index += [i] * (len(out) - len(doc_index))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(doc_index, pa.int64())), *columns],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    rows = tokenised(docs, tokenizer_path, window)
    hist = rows.groupBy("rem").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("full")).collect()  # at most `window` rows
    counts, base, total = np.zeros(window, np.int64), {}, 0
    for r in sorted(hist, key=lambda r: r["rem"]):
        counts[r["rem"]] = r["n"]
        base[r["rem"]] = total
        total += r["full"]
    plan = make_plan(counts, total, window)
    # Rank among equal remainders, and full windows before this row: counted in chunks of a length.
    chunks = chunk_count(int(counts.max()), 1 << 14)
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("row_no"), F.lit(chunks)).cast("int"))
    parts = dealt.groupBy("rem", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("full").alias("f"))
    before = Window.partitionBy("rem").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("rem").alias("of_rem"), F.col("chunk").alias("of_chunk"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank0"),
        F.coalesce(F.sum("f").over(before), F.lit(0)).alias("full0"))
    own = Window.partitionBy("rem", "chunk").orderBy("row_no")
    numbered = dealt.withColumn("rank", F.row_number().over(own).cast("bigint") - 1).withColumn(
        "full_start", F.coalesce(F.sum("full").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    met = numbered.join(starts, (F.col("rem") == F.col("of_rem")) & (F.col("chunk") == F.col("of_chunk")))
    first = F.element_at(F.from_json(F.lit(str({str(k): v for k, v in base.items()}).replace("'", '"')), "map<string,bigint>"), F.col("rem").cast("string"))
    ready = met.select(
        "doc_id", "doc_tokens", "full", "full_crcs", "rem", "rem_ids", (F.col("rank") + F.col("rank0")).alias("rank"),
        (F.col("full_start") + F.col("full0") + first).alias("full_start"))
    kind = dict(ready.dtypes)["doc_id"]
    return ready.mapInArrow(
        freeing(_places(plan, window)),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
