"""Near duplicates by a signature-coordinate inverted join.

A document is its set of distinct word shingles; its signature has 64 minima of independent hashes of the set.
Documents are posted under each (coordinate, value) pair. Two documents at the wanted similarity agree in at
least ``least_matches`` of 64 coordinates (0.8: 51 on average; under 36 has a probability of 4.2e-6), so of
each document only its rarest 64 - 36 + 1 postings need to be merged (prefix), postings nobody shares are
skipped, and what a merged posting proposes is counted on whole signatures before the full sets confirm it.

In large corpora common shingles make most postings shared by chance. A member of a short list therefore stays
only if the lowest bits of its 64 minima agree with another member's in ``least_bits`` places: 58 on average at
0.8, 32 by chance, under 46 with a probability of 1.0e-5. Long lists are kept as they are.

No posting list is expanded into its pairs. Equal sets are one node. Each list has a hub, the member whose
postings are shared most. Lists with one hub, or with hubs whose signatures agree in ``family_matches``
coordinates along a chain, are one family, so a document travels about once however many postings it shares. A
family is cut into blocks, and a pair of blocks is one bounded group: its members are compared with the group's
middle, then those outside the middle's component with all of other components, signatures first, full sets
next. Links inside a component are skipped, links between components never.

Defined results: texts without words (null, empty, white space) have an empty set and are linked with nothing;
a text with fewer words than a shingle has its whole sequence as one shingle; repeated rows are equal sets; null
doc_ids are ignored as component ids unless a component has no other; an empty table gives no row. Only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.llm.common import freeing, text_or_empty
from flowsift.llm.graph import components
from flowsift.llm.terms import slices
from flowsift.operators.staging import staged

COORDINATES = 64
_DRAW = np.random.Generator(np.random.PCG64(20))
_FACTORS = _DRAW.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _DRAW.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """Shingle words, similarity in percent, least matches of 64 coordinates, least agreeing low bits
    in lists up to ``short_list`` long, matches that join families, shingles of a block (16 MB)."""

    words: int = 5
    percent: int = 80
    least_matches: int = 36
    least_bits: int = 46
    short_list: int = 512
    family_matches: int = 51
    block_shingles: int = 1 << 21


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text, A-Z lower-cased."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    whole = np.full(n, width, np.uint64)
    for i in range(width):
        whole = _mixed(whole * _MIX + h[i:i + n])
    return np.unique(whole)


def signature(hashes: np.ndarray) -> np.ndarray:
    """64 minima, 32 bits each."""
    low = np.full(COORDINATES, np.uint64(2**64 - 1))
    for i in range(0, len(hashes), 4096):
        part = hashes[i:i + 4096, None] * _FACTORS + _SHIFTS
        np.minimum(low, part.min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


SETS = "row_no long, doc_id long, text_key long, n_shingles long, digest binary, signature binary"


def _set_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sizes, digests, signatures = [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py(), words)
                sizes.append(len(hashes))
                digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                signatures.append(signature(hashes).tobytes() if len(hashes) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_no"), batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()),
                 pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                names=["row_no", "doc_id", "text_key", "n_shingles", "digest", "signature"])

    return rows


def _hash_rows(words: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            sets = [shingle_set(text.as_py(), words).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("nid"), batch.column("signature"), pa.array(sets, pa.binary())], names=["nid", "signature", "hashes"])

    return rows


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, token) for each coordinate-value pair; a token is the coordinate above the 32 bits of the value."""
    high = np.arange(COORDINATES, dtype=np.int64) << np.int64(32)
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, COORDINATES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(batch.column("nid").to_numpy(), COORDINATES)), pa.array((values.astype(np.int64) + high).ravel())],
            names=["nid", "token"])


def _low_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(nid, bits): the lowest bit of each minimum as one number."""
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, COORDINATES)
            bits = np.packbits((values & 1).astype(np.uint8), axis=1).view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column("nid"), pa.array(bits)], names=["nid", "bits"])


def _partnered(least: int):
    """Rows (token, nid, score) that agree in enough bits with another row of their token. Rows come sorted by token."""

    def kept(part: pa.Table) -> pa.RecordBatch:
        token, bits = part.column("token").to_numpy(), part.column("bits").to_numpy()
        good = np.zeros(len(token), bool)
        for lag in range(1, len(token)):
            same = token[lag:] == token[:-lag]
            if not same.any():
                break
            same &= np.bitwise_count(np.bitwise_xor(bits[lag:], bits[:-lag]).view(np.uint64)) <= COORDINATES - least
            good[lag:] |= same
            good[:-lag] |= same
        return part.select(["token", "nid", "score"]).filter(pa.array(good)).combine_chunks()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            token = held.column("token").to_numpy()
            change = np.flatnonzero(token[1:] != token[:-1]) + 1
            if len(change):  # all lists but the last are complete
                yield from kept(held.slice(0, change[-1])).to_batches()
                held = held.slice(change[-1])
        if held is not None and held.num_rows:
            yield from kept(held).to_batches()

    return rows


def _matching(least: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, COORDINATES) for c in ("sa", "sb"))
            keep = pa.array((left == right).sum(axis=1) >= least)
            yield batch.select(["a", "b"]).filter(keep)

    return rows


def _all_hashes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows as one array, a view of Arrow's memory, and where each row's begin and end."""
    held = column.combine_chunks()
    edges = np.frombuffer(held.buffers()[1], np.int32)[held.offset:held.offset + len(held) + 1].astype(np.int64)
    return np.frombuffer(held.buffers()[2], np.uint64, (edges[-1] - edges[0]) // 8, edges[0]), (edges - edges[0]) // 8


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """Equal numbers for equal hashes, from 0; one sort and half-width numbers, less than ``unique`` with its inverse holds."""
    order = np.argsort(hashes)
    turn = np.zeros(len(hashes), np.int32)
    ordered = hashes[order]
    turn[1:] = ordered[1:] != ordered[:-1]
    del ordered
    np.cumsum(turn, out=turn)
    out = np.empty(len(hashes), np.int32)
    out[order] = turn
    return out


def _block_links(least: int, percent: int):
    """Confirmed links (a, b) that connect what is connected inside each group. Rows come sorted by group."""

    def compare(part: pa.Table) -> pa.RecordBatch:
        ids = part.column("nid").to_numpy()
        values = np.frombuffer(b"".join(part.column("signature").to_pylist()), "<u4").reshape(-1, COORDINATES)
        hashes, edges = _all_hashes(part.column("hashes"))
        sizes, starts = np.diff(edges), edges[:-1]
        flat = _numbered(hashes)
        mark = np.zeros(len(flat), bool)
        comps = np.arange(len(ids))
        a, b = [], []

        def connect(i: int) -> None:
            """Link i with one member of each other component that has a similar member."""
            other = (comps != comps[i]) & ((values == values[i]).sum(axis=1) >= least)
            if not other.any():
                return
            own = flat[starts[i]:starts[i] + sizes[i]]
            mark[own] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[own] = False
            linked = np.flatnonzero(other & (100 * both >= percent * (sizes + sizes[i] - both)))
            found, first = np.unique(comps[linked], return_index=True)
            a.extend([int(ids[i])] * len(first))
            b.extend(ids[linked[first]].tolist())
            comps[np.isin(comps, found)] = comps[i]

        # The middle has the commonest value in most coordinates.
        usual = np.zeros(len(ids), np.int64)
        for column in values.T:
            kinds, at, n = np.unique(column, return_inverse=True, return_counts=True)
            usual += at == n.argmax()
        middle = int(usual.argmax())
        connect(middle)
        for i in np.flatnonzero(comps != comps[middle]):
            if comps[i] != comps[middle]:
                connect(int(i))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            key = np.stack([held.column(c).to_numpy() for c in ("family", "i", "j")], axis=1)
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1 if len(key) else key
            for start, stop in zip(np.r_[0, change[:-1]] if len(change) else [], change):
                yield compare(held.slice(start, stop - start))
            held = held.slice(change[-1]) if len(change) else held
        if held is not None and held.num_rows:
            yield compare(held)

    return rows


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    source = docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text_or_empty()).alias("text_key"), text_or_empty().alias("text"))
    return staged(source.mapInArrow(freeing(_set_rows(words)), SETS))


def posting_lists(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(token, nid, score): the prefix postings of each node that a like node shares; score: how shared its postings are."""
    least = settings.least_matches
    tokens = nodes.select("nid", "signature").mapInArrow(_tokens, "nid long, token long")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    posted = tokens.join(shared, "token")
    prefix = COORDINATES - least + 1
    # Rarest first, and postings nobody shares are rarer than all others: of m shared ones m - least + 1 are in the prefix.
    by_node = posted.groupBy("nid").agg(
        F.collect_list(F.struct("n", "token")).alias("held"), F.sum("n").alias("score")).filter(F.size("held") >= least)
    first = F.slice(F.array_sort("held"), F.lit(1), F.size("held") - (COORDINATES - prefix))
    bits = nodes.select("nid", "signature").mapInArrow(_low_bits, "nid long, bits long")
    posts = staged(by_node.join(bits, "nid").select("nid", "score", "bits", F.explode(first).alias("p")).select(
        "p.token", "p.n", "nid", "score", "bits"))
    short = posts.filter(F.col("n") <= settings.short_list).drop("n").repartition("token").sortWithinPartitions("token")
    partnered = short.mapInArrow(freeing(_partnered(settings.least_bits)), "token long, nid long, score long")
    return staged(partnered.union(posts.filter(F.col("n") > settings.short_list).select("token", "nid", "score")))


def _sets_of(docs: DataFrame, nodes: DataFrame, words: int, repeated: bool) -> DataFrame:
    """nid, hashes, signature of the given nodes; the sets are made anew from their texts.

    Rows equal in doc_id and text give a node several equal rows; they would multiply pairs, so one is kept.
    """
    wanted = nodes.select("nid", "signature", F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text")).withColumn(
        "text_key", F.xxhash64("text"))
    rows = text.join(wanted, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    made = rows.select("nid", "signature", "text")
    if repeated:
        made = made.dropDuplicates(["nid"])
    made = made.mapInArrow(freeing(_hash_rows(words)), "nid long, signature binary, hashes binary")
    return staged(made)


def families(nodes: DataFrame, settings: Settings) -> DataFrame:
    """(family, nid, n_shingles): a node is in the family of each of its lists; two nodes that share a prefix
    posting share a family."""
    lists = posting_lists(nodes, settings)
    hub = lists.groupBy("token").agg(
        F.max(F.struct("score", (-F.col("nid")).alias("m"))).alias("h"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(
        "token", (-F.col("h.m")).alias("hub"), F.col("h.score").alias("hub_score"))
    members = staged(lists.join(hub, "token").select("hub", "hub_score", "nid").distinct())
    best = members.filter(F.col("nid") != F.col("hub")).groupBy("nid").agg(
        F.max(F.struct("hub_score", (-F.col("hub")).alias("m"))).alias("h")).select(F.col("nid").alias("a"), (-F.col("h.m")).alias("b"))
    left, right = (nodes.select(F.col("nid").alias(k), F.col("signature").alias(f"s{k}")) for k in ("a", "b"))
    near = best.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(
        _matching(settings.family_matches), "a long, b long")
    of = staged(components(near)).select(F.col("id").alias("hub"), F.col("component"))
    named = members.join(of, "hub", "left").select(F.coalesce("component", "hub").alias("family"), "nid").distinct()
    return staged(named.join(nodes.select("nid", "n_shingles"), "nid"))


def link_components(docs: DataFrame, nodes: DataFrame, settings: Settings, repeated: bool) -> DataFrame:
    """(id, component) of the nodes that have links."""
    members = families(nodes, settings)
    sets = _sets_of(docs, nodes.join(members.select("nid").distinct(), "nid", "left_semi"), settings.words, repeated)
    groups = _blocks(members, settings.block_shingles).join(sets, "nid")
    links = groups.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(
        freeing(_block_links(settings.least_matches, settings.percent)), "a long, b long")
    return staged(components(links))


def _blocks(members: DataFrame, block_shingles: int) -> DataFrame:
    """(family, i, j, nid): a family is dealt to blocks of about ``block_shingles``; each pair of blocks is a group."""
    sizes = members.groupBy("family").agg(F.sum("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select(
        "family", F.ceil(F.col("n") / F.lit(block_shingles)).cast("int").alias("blocks"))
    dealt = members.join(sizes, "family").withColumn("own", F.pmod(F.xxhash64("nid"), F.col("blocks")).cast("int"))
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.select("family", "nid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """row_no, doc_id, text_key, n_shingles, component, component_id of every row of docs.

    component names the class itself; rows without words are classes of their own.
    """
    sets = document_sets(docs, settings.words)
    groups = sets.filter("n_shingles > 0").groupBy("digest").agg(
        F.min("row_no").alias("nid"), F.min("doc_id").alias("least_id"))
    groups = staged(groups)
    nodes = staged(sets.join(groups.select(F.col("nid").alias("row_no")), "row_no", "left_semi").withColumnRenamed("row_no", "nid"))
    repeated = not sets.filter("n_shingles > 0").groupBy("doc_id", "text_key").count().filter("count > 1").isEmpty()
    comps = link_components(docs, nodes, settings, repeated).withColumnRenamed("id", "nid")
    of = groups.join(comps, "nid", "left").withColumn("component", F.coalesce("component", "nid"))
    least = of.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = staged(of.join(least, "component").select("digest", "component", "component_id"))
    known = sets.filter("n_shingles > 0").join(named, "digest")
    alone = sets.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "component": -1 - F.col("row_no")})
    columns = ["row_no", "doc_id", "text_key", "n_shingles", "component", "component_id"]
    return known.select(*columns).union(alone.select(*columns))


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return near_copies(docs, settings).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_copies(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs of which each class keeps one, all columns; rows equal in doc_id and text stay together."""
    rows = near_copies(docs, settings)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_no", "text_key")).alias("first")
    stay = staged(rows.groupBy("component").agg(first).select(
        F.col("first.doc_id").alias("_keep_id"), F.col("first.text_key").alias("_keep_key")))
    # The row travels as one struct, so that its column names meet no others.
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_key"))
    same = (own["text_key"] == F.col("_keep_key")) & own["doc_id"].eqNullSafe(F.col("_keep_id"))
    return own.join(stay, same, "left_semi").select("row.*")
