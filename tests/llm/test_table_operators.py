import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowsift.llm import kd_shards, mixing, packing, tokens, vector_search
from tests.llm.helpers import documents

WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(WORDS_FILE)


# ---- packing ----

ODD_TEXTS = [
    "", None, "  \n", "a<|endoftext|>b x", "<|STARTOFTEXT|>", "İstanbul ΣΑΣ J̌ ǰ Å", "it's don't '''s !'s 12½³ ª²", "naïvé été \x1cfoo\x85bar\xa0baz",
    "🙂🙂 hello", "　x", "_a_b 1_2 <|x|>", "ÀÖØß ÿ÷× µ", "Straße's,", "word. word, word., (word). w3.", "été ẛ̣", "x" * 30_000, "ab " * 9000]


def test_cached_ids_are_the_tokenizers(tokenizer, sf, spark):
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + [t or "" for t in ODD_TEXTS]
    for most in (10, 1 << 25):
        encoder = tokens.CachedEncoder(WORDS_FILE, most)
        for i in range(0, len(texts), 60):
            for text, got in zip(texts[i:i + 60], encoder.ids(texts[i:i + 60])):
                assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check_pieces(got, texts, tokenizer, window):
    """texts: (doc_id, text) of every row; rows that share a doc_id have equal texts."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    times = defaultdict(int)
    for i, text in texts:
        times[i] += 1
    for i, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        covered = np.zeros(len(ids) + 1, int)
        for r in by_doc[i]:
            part = ids[r["start"]:r["start"] + r["length"]]
            assert r["doc_tokens"] == len(ids) and len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
            covered[r["start"]] += 1
            covered[r["start"] + r["length"]] -= 1
        assert (np.cumsum(covered)[:-1] == times[i]).all()
    sizes = []
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        sizes.append(at)
    assert all(s & (s - 1) == 0 for s in sizes)  # full, or a power of two: no padding
    return sizes


def test_packing_round_trip(spark, tokenizer, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + k, t) for k, t in enumerate(ODD_TEXTS)] + [(77_777, "same text here")] * 300
    docs = documents(spark, rows).withColumn("rank", F.lit(1)).withColumn("length", F.lit("x"))
    check_pieces(packing.pack(docs, WORDS_FILE).collect(), rows, tokenizer, 2048)
    check_pieces(packing.pack(docs, WORDS_FILE, window=64).collect(), rows, tokenizer, 64)
    assert packing.pack(documents(spark, []), WORDS_FILE).collect() == []
    one = packing.pack(documents(spark, [(None, None)]), WORDS_FILE).collect()
    assert len(one) == 1 and one[0]["doc_tokens"] == 1 and one[0]["offset"] == 0


def test_plan_solves_a_histogram_of_exact_combinations():
    window = 256
    counts = np.zeros(window, np.int64)
    for combo, n in (((100, 156), 4000), ((60, 60, 136), 900), ((30, 226), 50)):
        for length in combo:
            counts[length] += n
    plan = packing.make_plan(counts, 7, window)
    assert plan.used.sum() >= 0.98 * counts.sum()
    places = defaultdict(int)
    for length in np.flatnonzero(counts):
        for rank in range(counts[length]):
            for _, n, sequence, _ in plan.pieces(int(length), rank):
                places[sequence] += n
    full = sum(counts[length] * length for length in range(window)) // window
    assert sum(v == window for v in places.values()) == full and min(places) == 7


# ---- mixing ----

def mixed(rows):
    """(doc_id, size, source_size, target, taken) by sorting."""
    size = lambda t: len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    of = defaultdict(list)
    for r in rows:
        of[r[3]].append(r)
    names = sorted((s for s in of if s is not None)) + ([None] if None in of else [])
    total = {s: sum(size(r[1]) for r in of[s]) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_names = {}, set(names)
    while True:
        left = sum(total.values()) - sum(3 * total[s] for s in names if s not in open_names)
        share = {s: weight[s] * left / sum(weight[n] for n in open_names) for s in open_names}
        over = {s for s in open_names if share[s] > 3 * total[s]}
        if not over:
            break
        open_names -= over
    target = {s: share[s] if s in open_names else 3.0 * total[s] for s in names}
    return size, total, target


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(0, 40), "en", rng.choice(["a"] * 12 + ["b", "c", "é", None, ""])) for i in range(3000)]
    rows += [(5000 + i, None, None, "zz") for i in range(3)] + [(6000, "one two", "en", "tiny")] + [(6001, "w " * 20_000, "en", "c")]
    docs = documents(spark, rows).withColumn("target", F.lit(1)).withColumn("h", F.lit("x"))
    size, total, target = mixed(rows)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        g = got[r[0]]
        assert g["size"] == size(r[1]) and g["source_size"] == total[r[3]] and g["target"] == pytest.approx(target[r[3]])
        assert g["taken"] <= 3 * g["size"] and (not g["size"] or g["taken"] % g["size"] == 0)
        taken[r[3]] += g["taken"]
        largest[r[3]] = max(largest[r[3]], g["size"])
    for s in total:
        assert abs(taken[s] - target[s]) <= largest[s]
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    copies = mixing.mixed_documents(docs)
    assert copies.columns == docs.columns
    times = {r["doc_id"]: r["count"] for r in copies.groupBy("doc_id").count().collect()}
    assert all(times.get(i, 0) * r["size"] == r["taken"] for i, r in got.items())


def test_mix_of_repeated_rows_and_of_nothing(spark):
    docs = documents(spark, [(1, "a b c", "en", "s")] * 50 + [(None, "x y", "en", None)] * 5)
    got = mixing.mix(docs).collect()
    assert len(got) == 55 and all(r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix(documents(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(documents(spark, [(1, None), (2, "")])).collect()] == [0, 0]


# ---- shards ----

def check_shards(got, rows, shards=24):
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        assert r["law"] == "bytes" and 0 <= r["shard"] < shards and r["grown_shard"] is None
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = np.zeros(shards)
    for r in got:
        sizes[r["shard"]] += r["size"]
    return sizes


def test_shards_have_near_equal_bytes(spark):
    rng = random.Random(6)
    rows = [(i, "word " * rng.randint(1, 60) + str(i), rng.choice(["en", "de", None]), rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(6000)]
    rows += [(10_000 + i, "copied text " * 10, "en", "hot") for i in range(3000)] + [(20_000 + i, f"twice {i % 200} " * 5, "en", f"s{i}") for i in range(400)]
    rows += [(None, None, None, None), (None, "", None, None), (7, "é" * 500, "en", "a"), (7, "é" * 500, "en", "a")]
    docs = documents(spark, rows).withColumn("unit", F.lit(1)).withColumn("slot", F.lit("x"))
    got = kd_shards.shard_documents(docs).collect()
    sizes = check_shards(got, rows)
    assert sizes.max() <= 1.05 * sizes.mean() and sizes.min() >= 0.95 * sizes.mean()
    text = defaultdict(set)
    for r in got:
        text[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(len(text[zlib.crc32((f"twice {k} " * 5).encode()), 8 + len(f"twice {k} " * 5)]) == 1 for k in range(200))
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] is None} == {(8, 0)}
    assert any(r["size"] == 1008 and r["text_crc32"] == zlib.crc32("é".encode() * 500) for r in got)


def test_shards_of_few_rows(spark):
    assert kd_shards.shard_documents(documents(spark, [])).collect() == []
    check_shards(kd_shards.shard_documents(documents(spark, [(1, "a")])).collect(), [1])
    check_shards(kd_shards.shard_documents(documents(spark, [(1, "a")] * 100)).collect(), [1] * 100)


# ---- vectors ----

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def exact(rows, k, every):
    good = {i: np.asarray(np.float32(v), float) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    names = np.array(sorted(good))
    table = np.array([good[i] for i in names])
    for q in (i for i in names.tolist() if i % every == 0):
        scores = np.einsum("nd,d->n", table, good[q])
        keep = names != q
        order = np.lexsort((names[keep], -scores[keep]))[:k]
        yield q, list(zip(names[keep][order].tolist(), scores[keep][order].tolist()))


def test_small_table_is_exact_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist(), 0) for i in range(400)]
    rows += [(1000 + i, rows[20][1], 0) for i in range(60)]  # equal vectors: ties to the smaller id
    rows += [(2000, None, 0), (2020, [0.0] * 8, 0), (2040, [float("nan")] * 8, 0), (2060, [1.0] * 7 + [None], 0), (2080, [float("inf")] * 8, 0), (None, [1.0] * 8, 0)]
    table = vectors(spark, rows).withColumn("bucket", F.lit(1)).withColumn("v", F.lit("x"))
    got = defaultdict(list)
    for r in vector_search.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    want = dict(exact(rows, 20, 20))
    assert set(got) == set(want)
    for q, near in want.items():
        assert [g[:2] for g in got[q]] == [(k + 1, i) for k, (i, _) in enumerate(near)]
        assert [g[2] for g in got[q]] == pytest.approx([s for _, s in near], abs=1e-12)


def test_recall_of_hashed_tables(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (v / np.linalg.norm(v) * (1 + i % 3)).tolist(), 0) for i, v in enumerate(rng.normal(size=(3000, 24)))]
    rows += [(5000 + i, (np.asarray(rows[40][1]) + rng.normal(size=24) * 1e-3).tolist(), 0) for i in range(1500)]  # a hot bucket
    settings = vector_search.Settings(one_bucket=100, chunk_rows=200)
    got = defaultdict(set)
    for r in vector_search.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, settings).collect():
        got[r["query_id"]].add(r["vec_id"])
    want = dict(exact(rows, 20, 20))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert np.mean([len(got[q] & {i for i, _ in near}) / 20 for q, near in want.items()]) >= 0.9


def test_isolated_queries_beside_hot_clusters(spark):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v)
    centres = [unit(rng.normal(size=24)) for _ in range(4)]
    rows = [(i, unit(rng.normal(size=24)).tolist(), 0) for i in range(2000)]
    rows += [(5000 + i, unit(centres[i % 4] + rng.normal(size=24) * 0.03).tolist(), 0) for i in range(4000)]
    settings = vector_search.Settings(one_bucket=100)
    got = defaultdict(set)
    for r in vector_search.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, settings).collect():
        got[r["query_id"]].add(r["vec_id"])
    recall = sorted(len(got[q] & {i for i, _ in near}) / 20 for q, near in exact(rows, 20, 20))
    assert np.mean(recall[:len(recall) // 10]) >= 0.75 and np.mean(recall) >= 0.93, (np.mean(recall[:len(recall) // 10]), np.mean(recall))


def test_probe_order_falls_and_covers():
    rng = random.Random(3)
    logs = []
    for _ in range(3):
        p = [rng.random() for _ in range(4)]
        logs.append(sorted(((float(np.log(x / sum(p))), c) for c, x in enumerate(p)), reverse=True))
    got = list(vector_search.probe_order(logs, 2.0))
    assert len({tuple(c) for _, c in got}) == 4**3 and sum(p for p, _ in got) == pytest.approx(1.0)
    assert all(a >= b - 1e-12 for (a, _), (b, _) in zip(got, got[1:]))


def test_few_vectors(spark):
    assert vector_search.nearest(vectors(spark, []), F.lit(True)).collect() == []
    assert vector_search.nearest(vectors(spark, [(20, [1.0], 0)]), F.col("vec_id") % 20 == 0).collect() == []
    got = vector_search.nearest(vectors(spark, [(20, [1.0], 0), (1, [2.0], 0), (1, [2.0], 0)]), F.col("vec_id") % 20 == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(20, 1, 1, 2.0)]
