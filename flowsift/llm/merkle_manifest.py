"""A Merkle manifest of documents, with leaf places from bitmap ranks instead of a sort.

Every row's leaf digest is made by column expressions. The place of a leaf in its group is the rank of its doc_id:

* each task builds bitmaps of the doc_ids it sees, one for each (group, doc_id div 4096); a bitmap of at most 256
  ids is kept as an array. Bitmaps of one key are merged, ids that occur more than once are noted beside them;
* popcounts of the merged bitmaps, summed along each group, are the directory: where a bitmap's first leaf is;
* a rank query meets its bitmap in the task of their common key and adds the directory's start, the popcounts of the
  bitmap's words before its own, and the bits below its own in that word.

Leaves are then keyed by (group, place div 1024) and fill their slot arrays by place. A slot array folds ten levels
at once to one node; nodes fill slot arrays again, until a group has one node. Siblings above a slot array are handed
down the same way, and each row's proof is read off its slot array and what was handed down.

Rows that share a doc_id, and rows without one, do not fit a bitmap: they are ordered by their leaf digest and then
by row, counted in ranges of the digest, and take places one after the other (without a doc_id: first).

Defined results: leaves of equal doc_ids ascend by digest; null doc_ids come first and are not tampered with; a null
lang is a group of its own, the first; a table without rows gives none. One row a group (its subroot) is ranked in
one task; that list has no text. Only doc_id, source, lang, n_chars and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.common import chunk_count, ranked
from flowsift.operators.ordered import running_sum, value_chunks
from flowsift.operators.staging import staged

ID_BITS = 12
SLOT_BITS = 10
SPAN = 1 << ID_BITS
WORDS = SPAN // 64
FEW = 256
SLOTS = 1 << SLOT_BITS


# ---- leaves ----

def _told(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(n_chars: Column) -> Column:
    """SHA-256 of the row's five values, 32 bytes."""
    parts = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*[_told(p) for p in parts]).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """row_no, grp (lang), doc_id, leaf, altered of every row; altered: the leaf after tampering, null where it is the same."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.col("n_chars").cast("bigint").alias("n_chars"), F.col("text").cast("string").alias("text"))
    picked = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return staged(rows.select(
        F.monotonically_increasing_id().alias("row_no"), F.col("lang").alias("grp"), "doc_id", leaf_digest(F.col("n_chars")).alias("leaf"),
        F.when(picked, leaf_digest(F.col("n_chars").cast("decimal(20,0)") + 1)).alias("altered")))


# ---- bitmaps ----

def _packed(lows: np.ndarray) -> bytes:
    """A bitmap of ascending places below SPAN: as an array if they are few."""
    if len(lows) <= FEW:
        return b"\0" + lows.astype("<u2").tobytes()
    bits = np.zeros(SPAN, np.uint8)
    bits[lows] = 1
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def _lows(packed: bytes) -> np.ndarray:
    if packed[0] == 0:
        return np.frombuffer(packed, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8, offset=1), bitorder="little"))


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    turn = np.ones(len(columns[0]), bool)
    turn[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(turn)


REPEATS = "array<struct<low:int,extra:long,below:long>>"
BITMAPS = f"grp string, high long, bits binary, repeats {REPEATS}, n long"
_REPEAT = pa.list_(pa.struct([("low", pa.int32()), ("extra", pa.int64()), ("below", pa.int64())]))


def _bitmap_batch(groups: pa.Array, highs: np.ndarray, counts: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each array of SPAN counts."""
    bits, repeats, n = [], [], []
    for count in counts:
        more = np.flatnonzero(count > 1)
        below = np.cumsum(count) - count if len(more) else count
        bits.append(_packed(np.flatnonzero(count)))
        repeats.append([{"low": int(k), "extra": int(count[k]) - 1, "below": int(below[k])} for k in more])
        n.append(int(count.sum()))
    return pa.RecordBatch.from_arrays(
        [groups, pa.array(highs, pa.int64()), pa.array(bits, pa.binary()), pa.array(repeats, _REPEAT), pa.array(n, pa.int64())],
        names=["grp", "high", "bits", "repeats", "n"])


def _construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of each batch."""
    for batch in batches:
        groups = batch.column("grp").dictionary_encode()
        code = np.asarray(groups.indices.fill_null(-1), np.int64)
        ids = np.asarray(batch.column("doc_id"), np.int64)
        high, low = ids >> ID_BITS, ids & (SPAN - 1)
        order = np.lexsort((low, high, code))
        code, high, low = code[order], high[order], low[order]
        begin = _changes(code, high)
        stop = np.append(begin[1:], len(code))
        names = batch.column("grp").take(pa.array(order[begin]))
        for i in range(0, len(begin), 256):
            counts = [np.bincount(low[a:b], minlength=SPAN) for a, b in zip(begin[i:i + 256], stop[i:i + 256])]
            yield _bitmap_batch(names.slice(i, 256), high[begin[i:i + 256]], counts)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of equal (grp, high), which come one after the other, as one."""
    key, count = None, None

    def done() -> pa.RecordBatch:
        return _bitmap_batch(pa.array([key[0]], pa.string()), np.asarray([key[1]]), [count])

    for batch in batches:
        for grp, high, bits, repeats in zip(*[batch.column(c).to_pylist() for c in ("grp", "high", "bits", "repeats")]):
            if (grp, high) != key:
                if key is not None:
                    yield done()
                key, count = (grp, high), np.zeros(SPAN, np.int64)
            count[_lows(bits)] += 1
            for r in repeats:
                count[r["low"]] += r["extra"]
    if key is not None:
        yield done()


def bitmap_index(ids: DataFrame) -> DataFrame:
    """grp, high, bits, repeats, n: merged bitmaps of (grp, doc_id)."""
    parts = ids.select("grp", "doc_id").mapInArrow(_construct, BITMAPS)
    return staged(parts.repartition("grp", "high").sortWithinPartitions("grp", "high").mapInArrow(_merge, BITMAPS))


def directory(bitmaps: DataFrame, nulls: DataFrame) -> DataFrame:
    """bitmaps with start (place of the first leaf) and total (leaves of the group); nulls: (grp, nulls) of rows without an id."""
    counts = bitmaps.select("grp", "high", "n", F.col("n").alias("start"))
    sums = running_sum(counts, ["grp"], "high", ["start"], value_chunks(counts, "high")).select(
        F.col("grp").alias("_grp"), F.col("high").alias("_high"), (F.col("start") - F.col("n")).alias("start"))
    totals = bitmaps.groupBy("grp").agg(F.sum("n").alias("ids")).withColumnRenamed("grp", "_of")
    first = nulls.select(F.col("grp").alias("_none"), "nulls")
    met = bitmaps.join(sums, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("high") == F.col("_high")))
    met = met.join(totals, F.col("grp").eqNullSafe(F.col("_of"))).join(first, F.col("grp").eqNullSafe(F.col("_none")), "left")
    none = F.coalesce("nulls", F.lit(0))
    return staged(met.select("grp", "high", "bits", "repeats", (F.col("start") + none).alias("start"), (F.col("ids") + none).alias("total")))


class _Ranks:
    """Popcount directory of some bitmaps; ranks of places in them."""

    def __init__(self, bits: list[bytes], repeats: list[list[dict]]):
        words = np.zeros((len(bits), SPAN), np.uint8)
        for k, packed in enumerate(bits):
            words[k, _lows(packed)] = 1
        self.words = np.packbits(words, axis=1, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts, axis=1) - counts
        self.repeats = {k: r for k, r in enumerate(repeats) if r}

    def of(self, which: np.ndarray, low: np.ndarray) -> np.ndarray:
        word, bit = low >> 6, (low & 63).astype(np.uint64)
        inside = np.bitwise_count(self.words[which, word] & ((np.uint64(1) << bit) - np.uint64(1)))
        rank = self.before[which, word] + inside
        for k, rows in self.repeats.items():
            at = np.flatnonzero(which == k)
            lows, extra = np.asarray([r["low"] for r in rows]), np.asarray([0] + [r["extra"] for r in rows])
            rank[at] += np.cumsum(extra)[np.searchsorted(lows, low[at])]
        return rank


PLACED = "grp string, total long, doc_id long, leaf binary, altered binary, place long"


def _rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows and bitmaps come by (grp, high), each bitmap before its rows."""
    last: pa.RecordBatch | None = None
    for whole in batches:
        for i in range(0, whole.num_rows, 2048):
            batch = whole.slice(i, 2048)
            is_bitmap = np.asarray(batch.column("is_bitmap"))
            maps = batch.filter(pa.array(is_bitmap))
            table = pa.Table.from_batches([b for b in (last, maps) if b is not None])
            which = np.cumsum(is_bitmap)[~is_bitmap] - (1 if last is None else 0)
            rows = batch.filter(pa.array(~is_bitmap))
            if table.num_rows:
                last = table.slice(table.num_rows - 1).combine_chunks().to_batches()[0]
            if not rows.num_rows:
                continue
            ranks = _Ranks(table.column("bits").to_pylist(), table.column("repeats").to_pylist())
            ids = np.asarray(rows.column("doc_id"), np.int64)
            place = np.asarray(table.column("start"))[which] + ranks.of(which, ids & (SPAN - 1))
            yield pa.RecordBatch.from_arrays(
                [rows.column("grp"), pa.array(np.asarray(table.column("total"))[which]), rows.column("doc_id"), rows.column("leaf"),
                 rows.column("altered"), pa.array(place, pa.int64())], names=["grp", "total", "doc_id", "leaf", "altered", "place"])


def _ordinals(tied: DataFrame) -> DataFrame:
    """tied with ``ordinal`` among the rows of its (grp, doc_id): by leaf, equal leaves one after the other.

    Digests are counted in 4096 ranges of a key, so a key with a third of all rows is many tasks.
    """
    keys = ["grp", "doc_id"]
    kinds = staged(tied.groupBy(*keys, "leaf").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.substring(F.hex("leaf"), 1, 3)))
    sums = kinds.groupBy(*keys, "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, "part").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("grp").eqNullSafe(F.col("_grp")) & F.col("doc_id").eqNullSafe(F.col("_doc_id"))
    firsts = kinds.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, same & (F.col("part") == F.col("_part")))
    firsts = firsts.select("_grp", "_doc_id", F.col("leaf").alias("_leaf"), (F.col("first") + F.col("_start")).alias("first"))
    chunks = chunk_count(kinds.agg(F.max("n")).first()[0] or 1)
    own = ranked(tied, [*keys, "leaf"], ["row_no"], chunks, F.xxhash64("row_no"), "copy")
    met = own.join(firsts, same & (F.col("leaf") == F.col("_leaf")))
    return met.select("grp", "doc_id", "leaf", "altered", (F.col("first") + F.col("copy")).alias("ordinal"))


def places(rows: DataFrame) -> DataFrame:
    """grp, total, doc_id, leaf, altered, place of every leaf."""
    known = rows.filter(F.col("doc_id").isNotNull())
    nulls = staged(rows.filter(F.col("doc_id").isNull()).groupBy("grp").agg(F.count(F.lit(1)).alias("nulls")))
    index = directory(bitmap_index(known), nulls)
    repeated = staged(index.select("grp", "high", "start", "total", F.explode("repeats").alias("r")).select(
        F.col("grp").alias("_in"), ((F.col("high") * SPAN) + F.col("r.low")).alias("_id"), (F.col("start") + F.col("r.below")).alias("_base"), "total"))
    tied = None
    if not repeated.isEmpty() or not nulls.isEmpty():
        alone = nulls.join(index.groupBy("grp").agg(F.max("total").alias("t")).withColumnRenamed("grp", "_g"), F.col("grp").eqNullSafe(F.col("_g")), "left")
        bases = staged(repeated.union(alone.select(
            F.col("grp").alias("_in"), F.lit(None).cast("bigint").alias("_id"), F.lit(0).cast("bigint").alias("_base"),
            F.coalesce("t", "nulls").alias("total"))))
        same = F.col("grp").eqNullSafe(F.col("_in")) & F.col("doc_id").eqNullSafe(F.col("_id"))
        tied = _ordinals(staged(rows.join(bases, same, "left_semi"))).join(bases, same).select(
            "grp", "total", "doc_id", "leaf", "altered", (F.col("_base") + F.col("ordinal")).alias("place"))
        known = known.join(bases, same, "left_anti")
    asked = known.select(
        "grp", F.shiftright("doc_id", ID_BITS).alias("high"), F.lit(False).alias("is_bitmap"), "doc_id", "leaf", "altered")
    both = asked.unionByName(index.withColumn("is_bitmap", F.lit(True)), allowMissingColumns=True)
    single = both.repartition("grp", "high").sortWithinPartitions("grp", "high", F.col("is_bitmap").desc()).mapInArrow(_rank, PLACED)
    return single if tied is None else single.union(tied)


# ---- slot arrays ----

def _parent(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(c.hex().encode() for c in children)).digest()


def fold_levels(digests: list[bytes], levels: int) -> list[list[bytes]]:
    """The given nodes and ``levels`` levels above them, in runs of two."""
    out = [digests]
    for _ in range(levels):
        row = out[-1]
        out.append([_parent(row[i:i + 2]) for i in range(0, len(row), 2)])
    return out


def levels_of(total: int) -> int:
    """Levels that a slot array folds: until one node remains, ten where other slot arrays remain beside it."""
    return SLOT_BITS if total > SLOTS else (total - 1).bit_length()


ARRAYS = "grp string, block long, total long, n int, doc_ids array<bigint>, leaves binary, altered binary, marks binary, node binary"


def _slot_array(key: tuple, table: pa.Table) -> pa.Table:
    n = table.num_rows
    slot = np.asarray(table.column("place")) & (SLOTS - 1)
    ids, leaves_, altered = [None] * n, [b""] * n, [None] * n
    for s, i, leaf, other in zip(slot.tolist(), *[table.column(c).to_pylist() for c in ("doc_id", "leaf", "altered")]):
        ids[s], leaves_[s], altered[s] = i, leaf, other
    total = table.column("total")[0].as_py()
    node = fold_levels(leaves_, levels_of(total))[-1][0]
    return pa.table({
        "grp": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([total], pa.int64()),
        "n": pa.array([n], pa.int32()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "leaves": pa.array([b"".join(leaves_)], pa.binary()),
        "altered": pa.array([b"".join(a or leaf for a, leaf in zip(altered, leaves_))], pa.binary()),
        "marks": pa.array([bytes(a is not None for a in altered)], pa.binary()), "node": pa.array([node], pa.binary())})


NODES = "grp string, block long, total long, digests binary, node binary"


def _node_array(key: tuple, table: pa.Table) -> pa.Table:
    digests = [b""] * table.num_rows
    for place, node in zip(table.column("place").to_pylist(), table.column("node").to_pylist()):
        digests[place & (SLOTS - 1)] = node
    total = table.column("total")[0].as_py()
    return pa.table({
        "grp": pa.array([key[0].as_py()], pa.string()), "block": pa.array([key[1].as_py()], pa.int64()), "total": pa.array([total], pa.int64()),
        "digests": pa.array([b"".join(digests)], pa.binary()), "node": pa.array([fold_levels(digests, levels_of(total))[-1][0]], pa.binary())})


def _split(packed: bytes) -> list[bytes]:
    return [packed[i:i + 32] for i in range(0, len(packed), 32)]


def _siblings(levels: list[list[bytes]], slot: int) -> list[bytes]:
    """33 bytes a level: L or R (where the sibling stands) and its digest, or 0 bytes where there is none."""
    out = []
    for row in levels[:-1]:
        other = slot ^ 1
        out.append((b"L" if other < slot else b"R") + row[other] if other < len(row) else bytes(33))
        slot >>= 1
    return out


def _hand_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, place, chain): for every node of a slot array its siblings up to the root; arrays have their own chain."""
    for batch in batches:
        for grp, block, total, packed, chain in zip(*[batch.column(c).to_pylist() for c in ("grp", "block", "total", "digests", "chain")]):
            digests = _split(packed)
            levels = fold_levels(digests, levels_of(total))
            chains = [b"".join(_siblings(levels, s)) + chain for s in range(len(digests))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([grp] * len(digests), pa.string()), pa.array(range(block * SLOTS, block * SLOTS + len(digests)), pa.int64()),
                 pa.array(chains, pa.binary())], names=["grp", "place", "chain"])


def _rounds(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """nodes: (grp, place, total, node). Slot arrays of every round, lowest first, and (grp, node) of the tops."""
    made = []
    while not nodes.filter("total > 1").isEmpty():
        arrays = staged(nodes.withColumn("block", F.shiftright("place", SLOT_BITS)).groupBy("grp", "block").applyInArrow(_node_array, NODES))
        made.append(arrays)
        nodes = arrays.select("grp", F.col("block").alias("place"), F.ceil(F.col("total") / SLOTS).cast("bigint").alias("total"), "node")
    return made, nodes.select("grp", "node")


def _chains(made: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(grp, place, chain) of the nodes of the lowest round; tops: (grp, chain) of the groups' last nodes."""
    chains = tops.select("grp", F.lit(0).cast("bigint").alias("place"), "chain")
    for arrays in reversed(made):
        above = chains.select(F.col("grp").alias("_grp"), "place", "chain")
        met = arrays.join(above, F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("place")))
        chains = staged(met.select("grp", "block", "total", "digests", "chain").mapInArrow(_hand_down, "grp string, place long, chain binary"))
    return chains


def fold(leaf: bytes, chain: bytes) -> bytes:
    """The root that a leaf and its siblings give."""
    node = leaf
    for i in range(0, len(chain), 33):
        side, other = chain[i:i + 1], chain[i + 1:i + 33]
        node = _parent([other, node] if side == b"L" else [node, other] if side == b"R" else [node])
    return node


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(root: bytes):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, total, packed, changed, marks, chain, subroot in zip(
                    *[batch.column(c).to_pylist() for c in ("doc_ids", "total", "leaves", "altered", "marks", "chain", "subroot")]):
                own, other = _split(packed), _split(changed)
                levels = fold_levels(own, levels_of(total))
                proofs, folded = [], []
                for s in range(len(own)):
                    path = b"".join(_siblings(levels, s)) + chain
                    told = b"".join(path[i + 1:i + 33].hex().encode() for i in range(0, len(path), 33) if path[i])
                    proofs.append(hashlib.sha256(told).hexdigest())
                    folded.append(fold(other[s] if marks[s] else own[s], path))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array([x.hex() for x in own]), pa.array([subroot.hex()] * len(own)), pa.array([root.hex()] * len(own)),
                     pa.array(proofs), pa.array([f.hex() for f in folded]), pa.array([f == root for f in folded])],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return rows


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    placed = places(leaves(docs))
    slots = staged(placed.withColumn("block", F.shiftright("place", SLOT_BITS)).groupBy("grp", "block").applyInArrow(_slot_array, ARRAYS))
    nodes = slots.select("grp", F.col("block").alias("place"), F.ceil(F.col("total") / SLOTS).cast("bigint").alias("total"), "node")
    made, tops = _rounds(nodes)
    # The groups' subroots, in order of lang, are the leaves of one more tree.
    whole = Window.partitionBy(F.lit(0))
    langs = staged(tops.select(
        F.col("grp").alias("lang"), F.col("node").alias("subroot"), (F.row_number().over(whole.orderBy(F.col("grp").asc_nulls_first())) - 1).cast("bigint").alias("no"),
        F.count(F.lit(1)).over(whole).alias("total")))
    above, top = _rounds(langs.select(F.lit(None).cast("string").alias("grp"), F.col("no").alias("place"), "total", F.col("subroot").alias("node")))
    root = top.select("node").first()
    if root is None:
        return slots.sparkSession.createDataFrame([], MANIFEST)
    lang_chains = _chains(above, top.select("grp", F.lit(b"").alias("chain")))
    handed = langs.join(lang_chains.select(F.col("place").alias("no"), "chain"), "no")
    chains = _chains(made, handed.select(F.col("lang").alias("grp"), "chain"))
    met = slots.join(chains.select(F.col("grp").alias("_grp"), "place", "chain"), F.col("grp").eqNullSafe(F.col("_grp")) & (F.col("block") == F.col("place")))
    met = met.join(langs.select("lang", "subroot"), F.col("grp").eqNullSafe(F.col("lang")))
    return met.select("doc_ids", "total", "leaves", "altered", "marks", "chain", "subroot").mapInArrow(_proofs(bytes(root["node"])), MANIFEST)
