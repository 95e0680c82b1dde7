"""Shards by k-d tree partitioning over document metadata.

All rows start in one node that stands for all shards. A node of k > 1 shards is split along its widest metadata
dimension at the weighted median (for odd k: the quantile of k//2 of k) of bytes, until each leaf is one shard.
Quantiles come from distributed histograms: 2^16 bins of the dimension, then 2^16 bins of the units' hash inside
the boundary bin. Only tree nodes (fewer than shards) reach the driver.

What is placed is a unit. Equal texts form one unit and share a shard, unless their bytes exceed a quarter of
a shard; then each row of theirs is a unit, since whole groups of that size would make sizes uneven. There are
fewer than 4 x shards such texts.

Defined results: a null text has size 8 and the CRC of the empty text; null metadata is a value of its own; a
null doc_id counts as the smallest in the doc_id dimension; repeated rows are dealt like others; an empty table
gives no row. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.llm.common import byte_size, chunk_count, ranked, text_or_empty
from flowsift.operators.staging import staged

BINS = 16
TOP = (1 << BINS) - 1
ROW_OVERHEAD = 8
#: A group of equal texts over this part of a shard is dealt row by row.
LARGE_PART = 4


@dataclass
class Node:
    """first, count: the shards below; a split node has dim, cut (bin, hash bin) and two children."""

    first: int
    count: int
    name: int
    dim: str | None = None
    cut: tuple[int, int] = (0, 0)


def _bin(value: Column, low: float, high: float) -> Column:
    width = max(high - low, 1e-9)
    return F.least(F.greatest(F.floor((value - F.lit(low)) / F.lit(width) * F.lit(TOP + 1.0)), F.lit(0)), F.lit(TOP)).cast("int")


def _spread(value: Column) -> Column:
    """A name's place on the axis: the first 16 bits of its hash; null is at the start."""
    return F.when(value.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(value), F.lit(TOP)) + 1).cast("int")


DIMS = ("d_id", "d_size", "d_source", "d_lang")


def units(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """rows with their unit, and one row per unit: bytes, hash bin and a bin on each dimension."""
    facts = rows.agg(
        F.sum("size").alias("bytes"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        F.min("size").alias("small"), F.max("size").alias("large")).first()
    limit = (facts["bytes"] or 0) / (shards * LARGE_PART)
    large = rows.groupBy("text_key").agg(F.sum("size").alias("n")).filter(F.col("n") > F.lit(limit)).select("text_key")
    # Fewer than LARGE_PART x shards rows: each holds more than that part of all bytes.
    apart = rows.join(F.broadcast(large.withColumn("large", F.lit(True))), "text_key", "left")
    held = staged(apart.withColumn("unit", F.when(F.col("large"), F.xxhash64("text_key", "doc_id", "row_no")).otherwise(
        F.col("text_key"))).drop("large"))
    low, high = float(facts["low"] or 0), float(facts["high"] or 0)
    small, huge = math.log(facts["small"] or 1), math.log(facts["large"] or 1)
    first = F.min(F.struct("doc_id", "size", "source", "lang")).alias("first")
    one = held.groupBy("unit").agg(F.sum("size").alias("bytes"), first)
    binned = one.select(
        "unit", "bytes", F.shiftrightunsigned("unit", 64 - BINS).cast("int").alias("tie"),
        _bin(F.coalesce(F.col("first.doc_id"), F.lit(low)).cast("double"), low, high).alias("d_id"),
        _bin(F.log(F.col("first.size").cast("double")), small, huge).alias("d_size"),
        _spread(F.col("first.source")).alias("d_source"), _spread(F.col("first.lang")).alias("d_lang"))
    return held, staged(binned)


def _node_of(tree: list[list[Node]]) -> Column:
    """The name of the deepest node a unit belongs to, as one nested CASE over the tree."""
    splits = {n.name: n for level in tree for n in level if n.dim}

    def place(name: int) -> Column:
        node = splits.get(name)
        if node is None:
            return F.lit(name)
        d, (b, tie) = F.col(node.dim), node.cut
        left = (d < b) | ((d == b) & (F.col("tie") < tie))
        return F.when(left, place(2 * name)).otherwise(place(2 * name + 1))

    return place(1)


def _boundary(hist: DataFrame, wanted: dict[int, float], bin_name: str) -> dict[int, tuple[int, int, int]]:
    """Per node: the bin where the running bytes pass what is wanted, the bytes before it and those up to its end.

    The histogram has at most 2^16 rows a node; the window over a node sees that many.
    """
    run = Window.partitionBy("node").orderBy(bin_name).rowsBetween(Window.unboundedPreceding, 0)
    goal = F.element_at(F.create_map(*[x for k, v in wanted.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("node"))
    passed = hist.withColumn("upto", F.sum("bytes").over(run)).filter(F.col("upto") > goal)
    got = passed.groupBy("node").agg(F.min(F.struct(bin_name, "upto", "bytes")).alias("c")).collect()
    return {r["node"]: (r["c"][bin_name], r["c"]["upto"] - r["c"]["bytes"], r["c"]["upto"]) for r in got}


def grow_tree(unit_rows: DataFrame, shards: int) -> list[list[Node]]:
    tree = [[Node(0, shards, 1)]]
    while any(n.count > 1 for n in tree[-1]):
        open_nodes = [n for n in tree[-1] if n.count > 1]
        here = unit_rows.withColumn("node", _node_of(tree)).filter(F.col("node").isin([n.name for n in open_nodes]))
        spans = [(F.max(d) - F.min(d)).alias(d) for d in DIMS]
        stats = {r["node"]: r for r in here.groupBy("node").agg(F.sum("bytes").alias("bytes"), *spans).collect()}
        dim, wanted = {}, {}
        for n in open_nodes:
            if n.name in stats:
                dim[n.name] = max(DIMS, key=lambda d: (stats[n.name][d], -DIMS.index(d)))
                wanted[n.name] = stats[n.name]["bytes"] * (n.count // 2) / n.count
        if dim:
            along = F.coalesce(*[F.when(F.col("node") == k, F.col(d)) for k, d in dim.items()])
            placed = here.filter(F.col("node").isin(list(dim))).select("node", along.alias("b"), "tie", "bytes")
            coarse = _boundary(placed.groupBy("node", "b").agg(F.sum("bytes").alias("bytes")), wanted, "b")
            at = F.coalesce(*[F.when(F.col("node") == k, F.lit(b)) for k, (b, _, _) in coarse.items()])
            inside = placed.filter(F.col("b") == at).groupBy("node", "tie").agg(F.sum("bytes").alias("bytes"))
            fine = _boundary(inside, {k: wanted[k] - before for k, (_, before, _) in coarse.items()}, "tie")
        below = []
        for n in tree[-1]:
            if n.count <= 1:
                continue
            half = n.count // 2
            if n.name in dim:
                n.dim = dim[n.name]
                tie, before, upto = fine[n.name]
                goal = wanted[n.name] - coarse[n.name][1]
                n.cut = (coarse[n.name][0], tie + (upto - goal < goal - before))  # the nearer end of the bin
            else:  # no unit here: any cut will do
                n.dim = DIMS[0]
            below += [Node(n.first, half, 2 * n.name), Node(n.first + half, n.count - half, 2 * n.name + 1)]
        tree.append(below)
    return tree


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; law `bytes`."""
    text = text_or_empty()
    rows = staged(docs.select(
        F.monotonically_increasing_id().alias("row_no"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        (byte_size(text) + ROW_OVERHEAD).alias("size"), F.crc32(F.encode(text, "UTF-8")).cast("bigint").alias("text_crc32"),
        F.xxhash64(text, F.col("text").isNull()).alias("text_key")))
    held, unit_rows = units(rows, shards)
    tree = grow_tree(unit_rows, shards)
    shard_of = {n.name: n.first for level in tree for n in level if n.count == 1}
    node = _node_of(tree)
    to_shard = F.coalesce(*[F.when(F.col("node") == k, F.lit(v)) for k, v in shard_of.items()])
    placed = unit_rows.withColumn("node", node).select("unit", to_shard.cast("int").alias("shard"))
    dealt = staged(held.join(placed, "unit").select("row_no", "doc_id", "size", "text_crc32", "shard"))
    per_shard = chunk_count(dealt.count(), shards << 13)
    numbered = ranked(dealt, ["shard"], ["row_no"], per_shard, F.xxhash64("row_no"), "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
