"""What several operators share: column names that cannot clash, word and size expressions, chunked ranks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Words separated by white space, as long."""
    return F.regexp_count(text, F.lit(WORDS)).cast("bigint")


def byte_size(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def chunk_count(rows: int, per_chunk: int = 1 << 16) -> int:
    """How many chunks keep a chunk near ``per_chunk`` rows."""
    return max(1, -(-rows // per_chunk))


def ranked(df: DataFrame, keys: list[str], order: list[str], chunks: int, spread: Column, out: str) -> DataFrame:
    """0-based gapless row number per key, without a task that holds a whole key.

    Rows of a key are dealt to ``chunks`` chunks by ``spread`` (a hash of the row); a chunk numbers its own
    rows and starts after the earlier chunks' counts. The numbers follow (chunk, order).
    """
    chunk = f"{out}_chunk"
    start = f"{out}_start"
    rows = df.withColumn(chunk, F.pmod(spread, F.lit(chunks)).cast("int"))
    counts = rows.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(k).alias(f"{out}_{k}") for k in keys], F.col(chunk).alias(f"{out}_at"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    own = Window.partitionBy(*keys, chunk).orderBy(*order)
    numbered = rows.withColumn(out, F.row_number().over(own).cast("bigint") - 1)
    same = [F.col(k).eqNullSafe(F.col(f"{out}_{k}")) for k in keys] + [F.col(chunk) == F.col(f"{out}_at")]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return (numbered.join(starts, condition, "left").withColumn(out, F.col(out) + F.col(start))
            .drop(*[f"{out}_{k}" for k in keys], f"{out}_at", start, chunk))


def freeing(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same Arrow function; when its task ends, the worker's unused memory goes back to the system.

    Workers serve later stages too, and memory they have freed but kept counts against the executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return run
