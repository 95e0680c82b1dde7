"""Tamper-evident alert chains: one hash chain per sensor."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsift.constants import GENESIS_HASH
from flowsift.functions.net import int_div
from flowsift.operators.ordered import CHUNK_ROWS, carry_first, rows_only, with_carry

CONTENT = ["timestamp", "flow_id", "threat_class", "confidence_score", "evidence"]


def content_text(timestamp: Column, flow_id: Column, threat_class: Column, confidence: Column, evidence: Column) -> Column:
    """Canonical text of an alert's content; lengths keep field borders unambiguous."""
    items = F.array_join(F.transform(evidence, lambda e: F.concat(F.length(e).cast("string"), F.lit(":"), e)), ",")
    fields = [timestamp, flow_id, threat_class, confidence, items]
    return F.concat_ws("|", *[F.concat(F.length(f).cast("string"), F.lit(":"), f) for f in fields])


def canonical_alerts(alerts: DataFrame) -> DataFrame:
    """Alert columns as the fixed texts the chain hashes (microsecond time, 12 decimals)."""
    return alerts.withColumns({
        "timestamp": F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        "confidence_score": F.format_string("%.12f", "confidence_score"),
    })


def digest(text: Column, key: str | None = None) -> Column:
    """SHA-256 in hex, or HMAC-SHA-256 when a key is given."""
    if not key:
        return F.sha2(text, 256)
    raw = key.encode()
    raw = hashlib.sha256(raw).digest() if len(raw) > 64 else raw
    raw = raw.ljust(64, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in raw))
    outer = F.lit(bytes(b ^ 0x5C for b in raw))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def entry_text(seq: Column, prev_hash: Column, content: Column) -> Column:
    return F.concat_ws("|", seq.cast("string"), prev_hash, content)


def append_chain(alerts: DataFrame, heads: DataFrame | None = None, *, key: str | None = None) -> DataFrame:
    """Chain entries for new alerts, per chain_id in ``position`` order.

    A hash chain is sequential within one chain, so the unit of parallelism is the chain. Content
    is digested in parallel first; the ordered fold sees one 64-digit digest per alert, streams
    Arrow batches and keeps only the running hash, so no chain is ever held in memory. ``heads``
    (chain_id, head_hash, next_seq) resumes stored chains.
    """
    content = content_text(*[F.col(c) for c in CONTENT])
    narrow = alerts.select("chain_id", "position", digest(content, key).alias("content_hash"))
    if heads is not None:
        narrow = narrow.join(heads, "chain_id", "left")
    else:
        narrow = narrow.withColumns({"head_hash": F.lit(None).cast("string"), "next_seq": F.lit(None).cast("bigint")})
    narrow = narrow.select(
        "chain_id", "position", "content_hash", F.coalesce("head_hash", F.lit(GENESIS_HASH)).alias("prev_hash"),
        F.coalesce("next_seq", F.lit(0)).cast("bigint").alias("seq"))
    secret = key.encode() if key else None

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, head, seq = None, None, 0
        for batch in batches:
            ids, digests, starts, seqs = [
                batch.column(n).to_pylist() for n in ("chain_id", "content_hash", "prev_hash", "seq")]
            prevs, numbers, hashes = [], [], []
            for chain_id, text, start, start_seq in zip(ids, digests, starts, seqs):
                if chain_id != chain:
                    chain, head, seq = chain_id, start, start_seq
                body = f"{seq}|{head}|{text}".encode()
                made = hmac.new(secret, body, hashlib.sha256) if secret else hashlib.sha256(body)
                prevs.append(head)
                numbers.append(seq)
                head = made.hexdigest()
                hashes.append(head)
                seq += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("chain_id"), batch.column("position"), pa.array(numbers, pa.int64()),
                 pa.array(prevs, pa.string()), pa.array(hashes, pa.string())],
                names=["chain_id", "position", "seq", "prev_hash", "hash"])

    ordered = narrow.repartition("chain_id").sortWithinPartitions("chain_id", "position")
    links = ordered.mapInArrow(fold, "chain_id string, position bigint, seq bigint, prev_hash string, hash string")
    return alerts.join(links, ["chain_id", "position"])


def chain_heads(entries: DataFrame) -> DataFrame:
    """Where each chain would continue: its last hash and the next sequence number."""
    last = F.max_by(F.struct("hash", "seq"), "seq")
    return entries.groupBy("chain_id").agg(last.alias("_last")).select(
        "chain_id", F.col("_last.hash").alias("head_hash"), (F.col("_last.seq") + 1).alias("next_seq"))


def check_entries(entries: DataFrame, *, key: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add is_valid per entry: digest, link to the previous entry, sequence, genesis and completeness."""
    staged = with_carry(
        entries.withColumn("_follows", F.lit(True)), ["chain_id"], int_div(F.col("position"), chunk_rows),
        {"_last": F.max(F.struct("position", "seq", "hash"))},
        {"seq": lambda w: F.last("_last.seq").over(w), "hash": lambda w: F.last("_last.hash").over(w),
         "_follows": lambda w: F.count(F.lit(1)).over(w) > 0})
    order = carry_first(["chain_id"], "position")
    linked = rows_only(staged.withColumns({
        "_seq": F.lag("seq").over(order), "_hash": F.lag("hash").over(order), "_follows": F.lag("_follows").over(order)}))
    complete = F.lit(True)
    for name in ("seq", "prev_hash", "hash", *CONTENT):
        complete = complete & F.col(name).isNotNull()
    content = digest(content_text(*[F.col(c) for c in CONTENT]), key)
    own = F.col("hash") == digest(entry_text(F.col("seq"), F.col("prev_hash"), content), key)
    start = (F.col("seq") != 0) | (F.col("prev_hash") == GENESIS_HASH)
    link = (F.col("seq") == F.col("_seq") + 1) & (F.col("prev_hash") == F.col("_hash"))
    valid = complete & own & F.when(F.col("_follows"), link).otherwise(start)
    return linked.withColumn("is_valid", F.coalesce(valid, F.lit(False))).drop("_seq", "_hash", "_follows")


def verify_chains(entries: DataFrame, **options) -> DataFrame:
    """Per chain: whether it is intact and the position of the first break."""
    checked = check_entries(entries, **options)
    return checked.groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("entries"), F.bool_and("is_valid").alias("intact"),
        F.min(F.when(~F.col("is_valid"), F.col("position"))).alias("first_break"))


def retained(entries: DataFrame, keep: int) -> DataFrame:
    """The last ``keep`` entries of each chain. Sequence numbers are dense, so no ranking is needed."""
    top = entries.groupBy("chain_id").agg(F.max("seq").alias("_top"))
    return entries.join(top, "chain_id").filter(F.col("seq") > F.col("_top") - keep).drop("_top")


# ---- segmented chains ----

def append_segmented(alerts: DataFrame, segment_rows: int, *, key: str | None = None) -> DataFrame:
    """Chain entries in two levels: each ``segment_rows`` positions of a chain are a chain of their own.

    Segments start from the genesis hash and are folded in parallel, so one sensor uses many tasks; ``segment_links``
    ties their heads together. Adds segment, seq (within the segment), prev_hash and hash.
    """
    inner = alerts.withColumns({
        "_chain": F.col("chain_id"), "_segment": int_div(F.col("position"), segment_rows)}).withColumn(
        "chain_id", F.concat_ws("/", F.col("_segment").cast("string"), F.col("_chain")))
    made = append_chain(inner, key=key)
    return made.withColumn("chain_id", F.col("_chain")).withColumnRenamed("_segment", "segment").drop("_chain")


def segment_heads(entries: DataFrame) -> DataFrame:
    """(chain_id, segment, entries, head) of the entries of segmented chains."""
    return entries.groupBy("chain_id", "segment").agg(F.count(F.lit(1)).alias("entries"), F.max_by("hash", "seq").alias("head"))


def segment_links(heads: DataFrame, last: DataFrame | None = None, *, key: str | None = None) -> DataFrame:
    """heads with prev_link and link: the second level, one link a segment, in order of segment.

    A link covers the segment's number, how many entries it has and its head, so that no segment can be cut short,
    left out or moved. ``last`` (chain_id, link) resumes stored chains. The ordered fold sees one row a segment.
    """
    start = heads.withColumn("_start", F.lit(GENESIS_HASH)) if last is None else heads.join(
        last.select("chain_id", F.col("link").alias("_start")), "chain_id", "left").withColumn("_start", F.coalesce("_start", F.lit(GENESIS_HASH)))
    body = F.concat_ws("|", F.col("segment").cast("string"), F.col("entries").cast("string"), F.col("head"))
    secret = key.encode() if key else None

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, link = None, None
        for batch in batches:
            before, links = [], []
            for chain_id, text, first in zip(*[batch.column(n).to_pylist() for n in ("chain_id", "_body", "_start")]):
                if chain_id != chain:
                    chain, link = chain_id, first
                before.append(link)
                said = f"{link}|{text}".encode()
                link = (hmac.new(secret, said, hashlib.sha256) if secret else hashlib.sha256(said)).hexdigest()
                links.append(link)
            kept = batch.select(["chain_id", "segment", "entries", "head"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(before, pa.string()), pa.array(links, pa.string())],
                                             names=[*kept.schema.names, "prev_link", "link"])

    ordered = start.withColumn("_body", body).repartition("chain_id").sortWithinPartitions("chain_id", "segment")
    return ordered.mapInArrow(fold, "chain_id string, segment bigint, entries bigint, head string, prev_link string, link string")


def verify_segmented(entries: DataFrame, links: DataFrame, *, key: str | None = None, **options) -> DataFrame:
    """Per chain: whether all segments and links hold, and the first segment that does not.

    Entries are checked inside their segments; a link is recomputed from its own segment's head, its number of entries
    and the link before it, all in parallel.
    """
    inner = entries.withColumn("chain_id", F.concat_ws("/", F.col("segment").cast("string"), F.col("chain_id")))
    sound = verify_chains(inner, key=key, **options).select(
        F.substring_index("chain_id", "/", 1).cast("bigint").alias("segment"),
        F.expr("substring(chain_id, instr(chain_id, '/') + 1)").alias("chain_id"), "intact")
    whole = segment_heads(entries).join(sound, ["chain_id", "segment"])
    stored = links.select("chain_id", "segment", F.col("entries").alias("_entries"), F.col("head").alias("_head"), "prev_link", "link")
    both = stored.join(whole, ["chain_id", "segment"], "full")
    # One row a segment of a chain: a list without texts.
    order = Window.partitionBy("chain_id").orderBy("segment")
    text = F.concat_ws("|", "prev_link", F.col("segment").cast("string"), F.col("_entries").cast("string"), "_head")
    held = (F.col("intact") & (F.col("entries") == F.col("_entries")) & (F.col("head") == F.col("_head")) & (F.col("link") == digest(text, key))
            & (F.col("prev_link") == F.coalesce(F.lag("link").over(order), F.lit(GENESIS_HASH)))
            & (F.col("segment") == F.coalesce(F.lag("segment").over(order) + 1, F.lit(0))))
    judged = both.withColumn("_ok", F.coalesce(held, F.lit(False)))
    return judged.groupBy("chain_id").agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.bool_and("_ok").alias("intact"),
        F.min(F.when(~F.col("_ok"), F.col("segment"))).alias("first_broken_segment"))
