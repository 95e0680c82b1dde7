import re
from collections import Counter, defaultdict

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tests.llm.helpers import documents, near_classes
from tests.llm.test_table_operators import check_pieces, mixed


def stages(spark, docs, folder):
    """The rows after each stage, each written and read again."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, "").write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def hold_against_brute_force(docs, after):
    columns = docs.columns
    assert all(d.columns == columns for d in after[:-1])
    spoken, exact, near, mix, pieces = ([tuple(r) for r in d.select(*columns).collect()] for d in after[:-1]), None, None, None, after[-1].collect()
    spoken, exact, near, mix = spoken
    given = [tuple(r) for r in docs.collect()]
    gone = Counter(given) - Counter(spoken)
    lettered = [r for r in given if re.search(r"[^\W\d_]", r[1] or "")]
    assert not [r for r in gone if r in lettered] or len(spoken) >= 0.98 * len(lettered)
    assert all(re.search(r"[^\W\d_]", r[1] or "") for r in spoken)
    same = defaultdict(list)
    for r in spoken:
        same[re.sub(r"[\x20\x09-\x0D]+", " ", r[1])].append(r)
    assert sorted(exact) == sorted(min(v) for v in same.values())
    classes = near_classes([(r[0], r[1]) for r in exact], 2)
    assert sorted(r[0] for r in near) == sorted(set(classes.values()))
    assert set(near) <= set(exact)
    size, total, target = mixed(near)
    taken, largest = defaultdict(int), defaultdict(int)
    times = Counter(mix)
    assert set(times) <= set(near) and max(times.values()) <= 3
    for r, n in times.items():
        taken[r[3]] += n * size(r[1])
    for r in near:
        largest[r[3]] = max(largest[r[3]], size(r[1]))
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in total)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check_pieces(pieces, [(r[0], r[1]) for r in mix], tokenizer, 2048)


def test_stages_match_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    hold_against_brute_force(docs, stages(spark, docs, tmp_path))


def test_stages_with_odd_rows(spark, tmp_path):
    rows = [(i, f"the cat and the dog number {chr(97 + i % 7) * 3} sat here", "en", "a" if i % 3 else "b") for i in range(60)]
    rows += [(100, None, None, None), (101, "", "en", "a"), (102, "1 2 3 !!", "en", "a"), (103, "word " * 50_000, "en", "c"), (104, "le chat noir", "fr", None)]
    docs = documents(spark, rows)
    hold_against_brute_force(docs, stages(spark, docs, tmp_path))


def test_stages_of_nothing_and_with_more_columns(spark, tmp_path):
    assert [d.count() for d in stages(spark, documents(spark, []), tmp_path / "a")] == [0] * 5
    docs = documents(spark, [(1, "the cat"), (2, "the  cat"), (3, "a dog")]).withColumn("_keep_id", F.lit("x")).withColumn("score", F.lit(1))
    after = stages(spark, docs, tmp_path / "b")
    assert all(d.columns == docs.columns for d in after[:-1]) and after[1].count() == 2


def test_run_gives_the_last_stage(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and got.count() > 0


def test_all_document_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {re.match(r"op\d+_|", n)[0] for n in names} and "pipeline" in names
