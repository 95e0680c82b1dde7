"""Byte counting over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 4096
#: Bytes counted at once in a task, and the most that one row carries to it.
SPAN = 1 << 18
PIECE = 1 << 20


def _starts(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    """True where a row differs from the row before it in any key column; the first row is True."""
    n = batch.num_rows
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for name in names:
        column = batch.column(name)
        differs = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), True)
        both_null = pc.and_(pc.is_null(column.slice(1)), pc.is_null(column.slice(0, n - 1)))
        new[1:] |= np.asarray(differs.to_numpy(zero_copy_only=False) & ~both_null.to_numpy(zero_copy_only=False))
    return new


def _grouped(values: pa.Array, group: np.ndarray, n_groups: int) -> np.ndarray:
    """(n_groups, 256) byte counts of a binary column, given the ascending group of each row.

    The bytes are counted SPAN at a time, across rows and inside long ones: the eight bytes of index
    that each of them needs are held for one span only, whatever the length of the values.
    """
    counts = np.zeros((n_groups, 256), dtype=np.int64)
    offsets = np.frombuffer(values.buffers()[1], dtype=np.int32, count=len(values) + 1, offset=4 * values.offset)
    if offsets[0] == offsets[-1]:
        return counts
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)
    for start in range(int(offsets[0]), int(offsets[-1]), SPAN):
        end = min(start + SPAN, int(offsets[-1]))
        first, after = np.searchsorted(offsets, start, "right") - 1, np.searchsorted(offsets, end, "left")
        lowest, highest = group[first], group[after - 1]
        index = np.repeat((group[first:after] - lowest) * 256, np.diff(offsets[first:after + 1].clip(start, end)))
        index += data[start:end]
        counts[lowest:highest + 1] += np.bincount(index, minlength=(highest - lowest + 1) * 256).reshape(-1, 256)
    return counts


def count_bytes(batches: Iterator[pa.RecordBatch], names: list[str], value: str) -> Iterator[pa.RecordBatch]:
    """Per run of equal keys in sorted input: the keys and a list of (byte, count).

    Only the counts of the run still open at a batch's end are carried to the next batch.
    """
    open_keys, open_counts = None, None
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            keys = batch.select(names)
            new = _starts(batch, names)
            group = np.cumsum(new) - 1
            values = batch.column(value).cast(pa.binary())
            counts = _grouped(values, group, int(group[-1]) + 1)
            first_rows = keys.take(pa.array(np.flatnonzero(new)))
            if open_keys is not None:
                if open_keys.equals(first_rows.slice(0, 1)):
                    counts[0] += open_counts
                else:
                    yield _listed(open_keys, open_counts[None, :])
            if len(counts) > 1:
                yield _listed(first_rows.slice(0, len(counts) - 1), counts[:-1])
            open_keys, open_counts = first_rows.slice(len(counts) - 1, 1), counts[-1].copy()
    if open_keys is not None:
        yield _listed(open_keys, open_counts[None, :])


def _listed(keys: pa.RecordBatch, counts: np.ndarray) -> pa.RecordBatch:
    row, byte = np.nonzero(counts)
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(counts)))]).astype(np.int32)
    entries = pa.StructArray.from_arrays(
        [pa.array(byte.astype(np.int32)), pa.array(counts[row, byte].astype(np.int64))], names=["_token", "_c"])
    hist = pa.ListArray.from_arrays(pa.array(offsets), entries)
    return pa.RecordBatch.from_arrays([*keys.columns, hist], names=[*keys.schema.names, "_hist"])
