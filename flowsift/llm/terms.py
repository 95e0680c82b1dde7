"""Words of whole texts as numbers of a bounded vocabulary, for the operators that search."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of digits, letters and everything beyond ASCII, after lower-casing A-Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same rule on UTF-8 bytes: letters lower-cased, every other ASCII byte but digits a blank.
_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b not in range(123, 128) else 32 for b in range(256))
SLICE_BYTES = 4 << 20


def words_of(text: Column) -> Column:
    """The words of a text as an array; of a null text none."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def word_numbers(raw: bytes | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text, 0 for words outside the vocabulary; a long text goes in slices."""
    if not raw:
        return np.empty(0, np.int32)
    plain = raw.translate(_BYTES)
    parts, at, get = [], 0, vocabulary.get
    while at < len(plain):
        stop = plain.find(b" ", at + SLICE_BYTES) if at + SLICE_BYTES < len(plain) else -1
        stop = len(plain) if stop < 0 else stop
        words = plain[at:stop].split()
        parts.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
        at = stop
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of at most ``most_bytes`` of that text column, or of one row."""
    sizes = np.asarray([n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()], np.int64)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def raw_texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()
