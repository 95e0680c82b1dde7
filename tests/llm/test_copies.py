import hashlib
import random
import re

from pyspark.sql import functions as F

from flowsift.llm import digest_index, near_copies
from tests.llm.helpers import documents, near_classes, word_shingles

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "Ünë two"), (None, "one two"), (9, "one two"), (9, "one two")]


def marked(spark, rows, index=None):
    got = digest_index.mark_copies(documents(spark, rows), index or digest_index.DigestIndex(spark, buckets=4))
    return got.collect()


def test_exact_copies_match_brute_force(spark):
    rows = ODD + [(100 + i, "hot text") for i in range(500)] + [(i + 700, "x" * 100_000 + (" y" if i % 2 else "  y")) for i in range(4)]
    got = marked(spark, rows)
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert len(got) == len(rows)
    groups = {}
    for i, t in rows:
        groups.setdefault(digest(t), []).append(i)
    for r in got:
        members = groups[r["text_sha256"]]
        known = [m for m in members if m is not None]
        assert r["group_size"] == len(members) and r["keep_id"] == (min(known) if known else None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_index_remembers_and_reattaches(spark, tmp_path):
    where = str(tmp_path / "index")
    first = digest_index.DigestIndex(spark, where, buckets=4)
    assert sum(r["kept"] for r in marked(spark, [(1, "a"), (2, "b"), (3, "a")], first)) == 2
    again = digest_index.DigestIndex(spark, where, buckets=4)
    later = marked(spark, [(10, "a"), (11, "c"), (12, "c")], again)
    assert {r["doc_id"] for r in later if r["kept"]} == {11}
    assert again.rows().count() == 3
    assert sum(r["kept"] for r in marked(spark, [(10, "a"), (11, "c"), (12, "c")], again)) == 0  # a rerun adds nothing
    plan = again.rows().join(again.rows().select("digest"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan.split("Physical Plan")[1]


def test_later_batches_get_their_rows_from_the_index_without_moving_it(spark, tmp_path):
    index = digest_index.DigestIndex(spark, str(tmp_path / "index"), buckets=4)
    rng = random.Random(4)
    first = {}
    for batch in range(3):
        rows = [(1000 * batch + i, f"text {rng.randrange(150)}") for i in range(200)] + [(1000 * batch + 900 + i, "hot  text" if i % 2 else "hot text") for i in range(300)]
        groups = {}
        for i, t in rows:
            groups.setdefault(t.replace("  ", " "), []).append(i)
        got = {r["doc_id"]: r for r in marked(spark, rows, index)}
        assert len(got) == len(rows)
        for t, members in groups.items():
            new = t not in first
            keep, size = first.setdefault(t, (min(members), len(members)))
            assert {(r["keep_id"], r["group_size"], r["kept"]) for r in (got[m] for m in members)} == (
                {(keep, size, False)} if not new or size > 1 else set()) | ({(keep, size, True)} if new else set())
    assert index.rows().count() == len(first)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = index.rows().limit(5).select("digest").distinct()
        plan = index.hits(asked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    # The index is read by one scan whose rows meet no exchange before the join.
    index_side = plan.split("SortMergeJoin")[1].split("Bucketed: true")[0]
    assert "Exchange" not in index_side


def test_drop_copies_keeps_columns_and_one_of_repeated_rows(spark):
    docs = documents(spark, ODD).withColumn("digest", F.lit(1)).withColumn("keep_id", F.lit("x"))
    got = digest_index.drop_copies(docs, digest_index.DigestIndex(spark, buckets=2))
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3, 4, 5, 6, 8]


def test_exact_copies_of_nothing(spark):
    assert marked(spark, []) == []


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def near_rows(seed=3):
    rng = random.Random(seed)
    texts = []
    for size, n, edits in ((120, 90, 14), (60, 40, 8), (30, 30, 4), (8, 20, 2)):
        base = [f"v{rng.randrange(10**6)}" for _ in range(size)]
        texts += family(rng, base, n, edits)
    shared = " ".join(f"s{i}" for i in range(25))
    texts += [shared + " " + " ".join(f"u{rng.randrange(10**9)}" for _ in range(rng.randint(3, 20))) for _ in range(80)]
    texts += ["", None, "a", "A", "a b", "a\tb", "a b c", "long " * 30_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_near_copies_match_brute_force(spark):
    rows = near_rows()
    for words in (2, 5):
        want = near_classes(rows, words)
        got = near_copies.classes(documents(spark, rows), near_copies.Settings(words=words)).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == want
        text = dict(rows)
        assert all(r["n_shingles"] == len(word_shingles(text[r["doc_id"]], words)) for r in got)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_copies_do_not_depend_on_the_block_size(spark):
    rows = near_rows(8)
    want = near_classes(rows, 2)
    got = near_copies.classes(documents(spark, rows), near_copies.Settings(words=2, block_shingles=500))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_near_copies_with_repeated_rows_nulls_and_no_rows(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (4, "x y z"), (None, "p q r"), (7, None)]
    got = near_copies.classes(documents(spark, rows).withColumn("component", F.lit(1)), near_copies.Settings(words=2)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got) == [(-1, -1), (-1, 5), (4, 4), (5, 5), (5, 5), (7, 7)]
    assert near_copies.classes(documents(spark, [])).collect() == []


def test_drop_near_copies_keeps_one_of_each_class(spark):
    rows = near_rows(5)
    want = {root for root in near_classes(rows, 2).values()}
    docs = documents(spark, rows)
    got = near_copies.drop_near_copies(docs, near_copies.Settings(words=2))
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == want
