import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.llm import decontamination, lexical_search, merkle_manifest, terms
from tests.llm.helpers import documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def benchmark(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_word_numbers_are_the_words(monkeypatch):
    texts = ["", "A b,C-d 9é É\x7f~x ©® ß_ẞ 日本 a b\xa0c", "x" * 5000 + " y " * 3000, " ".join(map(str, range(3000)))]
    monkeypatch.setattr(terms, "SLICE_BYTES", 100)
    for text in texts:
        vocabulary = {w.encode(): k + 1 for k, w in enumerate(dict.fromkeys(words(text)))}
        back = {v: k.decode() for k, v in vocabulary.items()}
        assert [back[n] for n in terms.word_numbers(text.encode(), vocabulary)] == words(text)
    assert not len(terms.word_numbers(None, {}))


# ---- decontamination ----

def brute_contamination(docs, items, width=10):
    out = []
    windows = [(str(i) if i is not None else "", tuple(w[k:k + min(width, len(w))]))
               for i, t in items for w in [words(t)] if w for k in range(len(w) - min(width, len(w)) + 1)]
    for doc_id, text in docs:
        own, hit, met = words(text), set(), set()
        for item, win in windows:
            for k in range(len(own) - len(win) + 1):
                if tuple(own[k:k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    met.add(item)
        out.append((doc_id, len(own), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def contamination_rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


@pytest.mark.parametrize("most_words", [1 << 20, 60])
def test_contamination_matches_brute_force(spark, most_words):
    draw = random.Random(5)
    say = lambda n, kinds=6: " ".join(draw.choice("abcdefghij"[:kinds]) for _ in range(n))
    items = [(i, say(n)) for i, n in enumerate([3, 9, 10, 11, 14, 30, 12, 25])]
    items += [(20, items[5][1]), (5, items[3][1]), (30, "solo"), (31, "Two Words"), (32, ""), (33, None), (None, say(12)), (34, "Ünï-cödé 9.9 日本 x y z q r s t")]
    docs = [(k, say(draw.randrange(60))) for k in range(30)]
    for k in range(20):
        item = draw.choice(items)[1] or ""
        docs.append((100 + k, say(8) + ". " + item.upper().replace(" ", "--") + "! " + say(6)))
    docs += [(200, None), (201, ""), (202, "  ..."), (None, items[5][1]), (203, items[5][1]), (203, items[5][1]), (204, (items[4][1] + " ") * 400)]
    docs += [(205, "Solo"), (206, "sol o two  words"), (207, "é" * 4000)]
    got = contamination_rows(decontamination.contamination(documents(spark, docs), benchmark(spark, items), most_words=most_words))
    assert got == brute_contamination(docs, items)


def test_contamination_of_nothing_and_with_more_columns(spark):
    docs = documents(spark, [(1, "a b c d e f g h i j k")])
    items = benchmark(spark, [(1, "a b c d e f g h i j")])
    assert contamination_rows(decontamination.contamination(docs.limit(0), items)) == []
    assert [r[2] for r in contamination_rows(decontamination.contamination(docs, items.limit(0)))] == [0]
    more = docs.withColumn("row_no", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("items", F.lit(2))
    assert [r[2] for r in contamination_rows(decontamination.contamination(more, items.withColumn("words", F.lit(1)).withColumn("item", F.lit(1))))] == [10]


def test_shift_tables_skip_and_lose_nothing():
    draw = np.random.default_rng(3)
    text = draw.integers(0, 400, 200_000).astype(np.int32)
    patterns = np.unique(np.stack([text[i:i + 10] for i in draw.integers(0, 199_000, 300)]), axis=0)
    patterns = patterns[(patterns > 0).all(axis=1)]
    table = decontamination.Shifts(patterns, 7)
    begin, which = table.occurrences(text)
    want = {(i, 7 + k) for k, p in enumerate(patterns) for i in np.flatnonzero(text[:-9] == p[0]) if (text[i:i + 10] == p).all()}
    assert set(zip(begin.tolist(), which.tolist())) == want and len(begin) == len(want)
    assert len(table.candidates(text)) < len(text) / 100 and table.shift.mean() > 7


# ---- lexical search ----

def brute_search(docs, items, k=10):
    rows = [(d, Counter(words(t))) for d, t in docs]
    rows = [(d, c, sum(c.values())) for d, c in rows if c]
    count, every = len(rows), sum(n for _, _, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c, n in rows:
            m = 10 + 90 * n * count // every
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def search_rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def many_documents(count):
    draw = random.Random(8)
    kinds = [f"w{k}" for k in range(300)]
    odds = [1 / (k + 1) for k in range(300)]
    docs = [(k * 3 % count if k % 50 else 7, " ".join(draw.choices(kinds, odds, k=draw.randrange(1, 80)))) for k in range(count)]
    items = [(i, " ".join(draw.choices(kinds, odds, k=draw.choice([1, 5, 30])))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("shard_docs,short,stretch,most_terms", [(8192, 16, 1024, 1 << 20), (64, 4, 16, 100), (500, 1000, 7, 1 << 20), (100, 1, 64, 1 << 20)])
def test_search_matches_brute_force(spark, shard_docs, short, stretch, most_terms):
    docs, items = many_documents(1500)
    docs += [(5000, None), (5001, ""), (5002, "..."), (None, "w250 w251 w1"), (None, "w250 w251 w1"), (5003, "W0 w1, " * 20_000), (5004, "w299")]
    items += [(100, None), (101, ""), (102, "nowhere"), (103, "w299 w299 W299"), (3, items[3][1]), (None, "w250 w251")]
    settings = lexical_search.Settings(shard_docs=shard_docs, short=short, stretch=stretch)
    assert search_rows(lexical_search.search(documents(spark, docs), benchmark(spark, items), settings, most_terms)) == brute_search(docs, items)


def test_search_of_nothing_and_with_more_columns(spark):
    docs, items = documents(spark, [(1, "a b"), (2, "c")]), benchmark(spark, [(1, "a"), (2, "z")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.withColumn("text", F.lit("")), items)):
        got = lexical_search.search(d, i)
        assert got.collect() == [] and got.dtypes == lexical_search.search(docs, items).dtypes
    more = lexical_search.search(docs.withColumn("score", F.lit("x")).withColumn("n", F.lit(1)), items.withColumn("rank", F.lit(1)).withColumn("item_no", F.lit(1)))
    assert search_rows(more) == brute_search([(1, "a b"), (2, "c")], [(1, "a"), (2, "z")])


def test_ties_and_equal_texts(spark):
    docs = [(k, "same words here") for k in range(30)] + [(50 + k, "other") for k in range(40)]
    items = [(1, "words"), (2, "same other")]
    got = lexical_search.search(documents(spark, docs).repartition(5), benchmark(spark, items), lexical_search.Settings(shard_docs=9))
    assert search_rows(got) == brute_search(docs, items)


def test_skipping_leaves_documents_unscored():
    """Long lists alone cannot pass the threshold that short lists give: only their documents are looked up."""
    size = 4096
    docs = np.concatenate([np.arange(size), np.arange(0, size, 300)])
    shard = lexical_search.Shard(np.r_[np.full(size, 1), np.full(len(docs) - size, 2)], docs, np.r_[np.full(size, 3), np.full(len(docs) - size, 50)], 2, size)
    found, scores = shard.best(np.array([1, 2]), lexical_search.Settings(k=5))
    assert found.tolist() == [0, 300, 600, 900, 1200] and set(scores.tolist()) == {53}


# ---- Merkle manifest ----

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def brute_tree(nodes):
    """root and, for each node, the (left?, sibling) pairs, None where a run has one node."""
    where, paths, row = list(range(len(nodes))), [[] for _ in nodes], nodes
    while len(row) > 1:
        for k, w in enumerate(where):
            other = w ^ 1
            paths[k].append((other < w, row[other]) if other < len(row) else None)
            where[k] = w // 2
        row = [sha(*row[i:i + 2]) for i in range(0, len(row), 2)]
    return row[0], paths


def brute_manifest(rows):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        leaf = sha(*map(told, (doc_id, source, lang, n_chars, text)))
        picked = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        altered = sha(*map(told, (doc_id, source, lang, n_chars + 1, text))) if picked else leaf
        groups[lang].append((doc_id is not None, doc_id or 0, leaf, doc_id, altered))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: (sorted(groups[x]), *brute_tree([r[2] for r in sorted(groups[x])])) for x in langs}
    root, above = brute_tree([trees[x][1] for x in langs])
    out = []
    for x, top in zip(langs, above):
        own, subroot, paths = trees[x]
        for (_, _, leaf, doc_id, altered), path in zip(own, paths):
            node, proof = altered, ""
            for step in [*path, *top]:
                node = sha(node) if step is None else sha(step[1], node) if step[0] else sha(node, step[1])
                proof += step[1] if step else ""
            out.append((doc_id, leaf, subroot, root, sha(proof), node, node == root))
    return sorted(out, key=repr)


def manifest_rows(spark, rows, parts=4):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(parts)
    return sorted((tuple(r) for r in merkle_manifest.manifest(docs).collect()), key=repr)


def test_manifest_matches_brute_force(spark):
    draw = random.Random(4)
    rows = [(draw.randrange(-9000, 40_000), f"text {k}", draw.choice(["en", "en", "en", "de", None, "", "é"]), "s", k) for k in range(2500)]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(2**62 + k, "far", "en", None, None) for k in range(3)] + [(-2**63, None, "zz", "s", 2**63 - 1)]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


@pytest.mark.parametrize("count", [1, 2, 3, 1023, 1024, 1025, 2049])
def test_manifest_sizes(spark, count):
    rows = [(5 * k, "x", "en", "s", k) for k in range(count)]
    assert manifest_rows(spark, rows, 2) == brute_manifest(rows)


def test_manifest_with_repeated_and_missing_ids(spark):
    rows = [(k % 40 if k % 3 else None, f"t{k % 7}", "en" if k % 2 else None, "s", k % 5) for k in range(600)]
    rows += [(7, "same", "en", "s", 1)] * 200 + [(None, None, None, None, None)] * 50 + [(k, "x", "de", "s", 1) for k in range(100)]
    rows += [(None, "only", "fr", "s", 3), (9, "y" * 300_000, "it", "s", 1)]
    assert manifest_rows(spark, rows) == brute_manifest(rows)


def test_manifest_of_nothing_and_with_more_columns(spark):
    docs = documents(spark, [(1, "a"), (2, "b"), (3, None)])
    assert merkle_manifest.manifest(docs.limit(0)).collect() == []
    plain = sorted(map(tuple, merkle_manifest.manifest(docs).collect()))
    more = docs.withColumn("grp", F.lit(1)).withColumn("leaf", F.lit(2)).withColumn("place", F.lit("x")).withColumn("row_no", F.lit("y"))
    assert sorted(map(tuple, merkle_manifest.manifest(more).collect())) == plain


def test_ranks_of_merged_bitmaps():
    lows = [np.array([0, 5, 63, 64, 4095]), np.arange(0, 4096, 3)]
    for own in lows:
        assert merkle_manifest._lows(merkle_manifest._packed(own)).tolist() == own.tolist()
    ranks = merkle_manifest._Ranks([merkle_manifest._packed(x) for x in lows], [[{"low": 5, "extra": 2, "below": 1}], []])
    assert ranks.of(np.array([0, 0, 0, 1, 1]), np.array([5, 63, 4095, 0, 300])).tolist() == [1, 4, 6, 0, 100]
