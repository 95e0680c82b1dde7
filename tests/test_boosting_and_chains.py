"""Boosted trees against plain Python, rolling KS and segmented chains against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsift.operators import boosting, chain, drift

CLASSES = ["benign", "recon_scanning", "volumetric_ddos"]


def labelled(count, seed=1):
    draw = random.Random(seed)
    rows = []
    for k in range(count):
        x = [draw.randrange(12) / 2, draw.randrange(30) * 1.0, draw.randrange(5) * 1.0]
        label = CLASSES[0] if x[0] < 2 else CLASSES[1] if x[1] + 3 * x[2] > 20 else CLASSES[2]
        rows.append((x, draw.choice(CLASSES) if draw.random() < 0.1 else label, k))
    return rows


def plain_trees(rows, cuts, settings):
    """The same trees without Spark: every node tries every cut of every feature."""
    y = np.array([CLASSES.index(r[1]) for r in rows])
    counts = np.bincount(y, minlength=3)
    w = len(rows) / (3 * counts[y])
    x = np.array([r[0] for r in rows])
    margins, out = np.zeros((len(rows), 3)), []
    for _ in range(settings.rounds):
        p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
        moves, trees = np.zeros_like(margins), []
        for k in range(3):
            g = np.rint((p[:, k] - (y == k)) * w * 2**20) / 2**20
            h = np.rint(2 * p[:, k] * (1 - p[:, k]) * w * 2**20) / 2**20
            tree = {}

            def grow(node, at, depth):
                value = -settings.rate * g[at].sum() / (h[at].sum() + 1)
                tree[node] = (None, None, value)
                moves[at, k] = value
                best = (1e-9, None, None)
                if depth < settings.depth:
                    for f in range(x.shape[1]):
                        for c in cuts[f]:
                            left = at[x[at, f] <= c]
                            right = at[x[at, f] > c]
                            if h[left].sum() >= 1 and h[right].sum() >= 1:
                                gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right)) - g[at].sum() ** 2 / (h[at].sum() + 1)
                                if gain > best[0] + 1e-9:
                                    best = (gain, f, c)
                if best[1] is not None:
                    tree[node] = (best[1], best[2], value)
                    grow(2 * node + 1, at[x[at, best[1]] <= best[2]], depth + 1)
                    grow(2 * node + 2, at[x[at, best[1]] > best[2]], depth + 1)

            grow(0, np.arange(len(rows)), 0)
            trees.append(tree)
        margins += moves
        out.append(trees)
    return out, margins


@pytest.mark.parametrize("parts", [1, 5])
def test_boosted_trees_are_the_plain_ones(spark, parts):
    rows = labelled(400)
    df = spark.createDataFrame(rows, "features array<double>, label string, row_key long").repartition(parts)
    settings = boosting.Settings(rounds=3, depth=3, rate=0.3, rows=1.0, columns=1.0)
    model = boosting.fit_boosted(df, CLASSES, settings)
    want, margins = plain_trees(rows, model.cuts, settings)
    for got_round, want_round in zip(model.rounds, want):
        for got, tree in zip(got_round, want_round):
            for node, (feature, cut, value) in tree.items():
                assert got.value[node] == pytest.approx(value, abs=1e-6)
                assert (None if got.feature[node] < 0 else (got.feature[node], model.cuts[got.feature[node]][got.cut[node]])) == (
                    None if feature is None else (feature, cut))
    x = np.array([r[0] for r in rows])
    assert np.allclose(model.margins(model.binned(x)), margins, atol=1e-5)
    said = spark.createDataFrame(rows, "features array<double>, label string, row_key long").select(
        "row_key", boosting.boosted_probabilities(model)("features").alias("p")).orderBy("row_key").collect()
    assert np.allclose([r["p"] for r in said], boosting.softmax(margins), atol=1e-5)


def test_drawn_rows_and_columns_are_the_same_every_time(spark):
    df = spark.createDataFrame(labelled(300), "features array<double>, label string, row_key long")
    settings = boosting.Settings(rounds=2, depth=2, rows=0.6, columns=0.7)
    one, two = (boosting.fit_boosted(d, CLASSES, settings) for d in (df.repartition(4), df.orderBy(F.rand(3))))
    for a, b in zip(one.rounds, two.rounds):
        assert all((s.feature == t.feature).all() and (s.value == t.value).all() for s, t in zip(a, b))


def test_rolling_ks_matches_brute_force(spark):
    draw = random.Random(2)
    ref = [draw.randrange(20) / 10 for _ in range(150)]
    rows = [(s, k, k // 17, draw.choice([None, draw.randrange(30) / 10, draw.random()])) for s in ("a", "b", None) for k in range(140)]
    got = drift.rolling_ks(
        spark.createDataFrame(rows, "stream string, seq long, batch long, score double"), spark.createDataFrame([(v,) for v in ref], "score double"),
        window=25, chunk_rows=30).collect()

    def plain(now):
        both = sorted({*ref, *now})
        return max(abs(sum(r <= v for r in ref) / len(ref) - sum(c <= v for c in now) / len(now)) for v in both)

    want = {}
    for stream in ("a", "b", None):
        for batch in range(9):
            seen = [r[3] for r in rows if r[0] == stream and r[2] <= batch and r[3] is not None]
            want[stream, batch] = plain(seen[-25:])
    assert {(r["stream"], r["batch"]): r["ks"] for r in got} == pytest.approx(want)


def alerts(spark, counts):
    rows = [(c, p, f"t{p}", f"f{p}", "recon_scanning", str(p / 7), ["e", str(p % 3)]) for c, n in counts.items() for p in range(n)]
    return spark.createDataFrame(
        rows, "chain_id string, position long, timestamp string, flow_id string, threat_class string, confidence_score string, evidence array<string>")


@pytest.mark.parametrize("key", [None, "secret"])
def test_segmented_chains_find_every_kind_of_change(spark, key):
    made = chain.append_segmented(alerts(spark, {"a": 23, "b/x": 8, "c": 1}), 5, key=key).persist()
    links = chain.segment_links(chain.segment_heads(made), key=key).persist()
    assert {(r["chain_id"], r["segment"], r["entries"]) for r in links.collect()} == {
        *(("a", s, 5) for s in range(4)), ("a", 4, 3), ("b/x", 0, 5), ("b/x", 1, 3), ("c", 0, 1)}
    verdict = lambda e, l: {r["chain_id"]: (r["intact"], r["first_broken_segment"]) for r in chain.verify_segmented(e, l, key=key).collect()}
    sound = {c: (True, None) for c in ("a", "b/x", "c")}
    assert verdict(made, links) == sound
    here = (F.col("chain_id") == "a") & (F.col("position") == 12)
    assert verdict(made.withColumn("flow_id", F.when(here, "forged").otherwise(F.col("flow_id"))), links) == {**sound, "a": (False, 2)}
    assert verdict(made.filter(~((F.col("chain_id") == "a") & (F.col("position") == 22))), links) == {**sound, "a": (False, 4)}
    assert verdict(made.filter("not (chain_id = 'a' and segment = 1)"), links)["a"] == (False, 1)
    assert verdict(made.filter("not (chain_id = 'a' and segment = 1)"), links.filter("not (chain_id = 'a' and segment = 1)"))["a"] == (False, 2)
    made.unpersist()
    links.unpersist()


def test_segment_links_are_plain_hashes_and_resume(spark):
    heads = spark.createDataFrame([("a", k, 2, f"h{k}") for k in range(5)], "chain_id string, segment long, entries long, head string")
    want, link = [], "0" * 64
    for k in range(5):
        link = hashlib.sha256(f"{link}|{k}|2|h{k}".encode()).hexdigest()
        want.append(link)
    whole = [r["link"] for r in chain.segment_links(heads).orderBy("segment").collect()]
    first = chain.segment_links(heads.filter("segment < 2"))
    rest = chain.segment_links(heads.filter("segment >= 2"), first.filter("segment = 1"))
    assert whole == want == [r["link"] for r in first.union(rest).orderBy("segment").collect()]
