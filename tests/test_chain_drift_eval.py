"""Alert chains, drift measures and quality figures."""

import hashlib
import hmac
import math
import random

import pytest
from pyspark.sql import functions as F

from flowsift.operators import chain, drift, evaluate, sampling, timings
from flowsift.operators.ordered import exact_quantiles, rank_rows


def alerts(spark, n=12, chains=("a", "b")):
    rows = [(c, i, f"2024-01-01T00:00:{i:02d}.000000", f"f{i}", "recon_scanning", f"0.{i:012d}", [f"e{i}", "x|y"])
            for c in chains for i in range(n)]
    return spark.createDataFrame(rows, "chain_id string, position long, timestamp string, flow_id string, threat_class string, "
                                       "confidence_score string, evidence array<string>")


@pytest.fixture(scope="module")
def entries(spark):
    return chain.append_chain(alerts(spark)).persist()


def verdicts(df, **options):
    return {r.chain_id: (r.intact, r.first_break) for r in chain.verify_chains(df, **options).collect()}


@pytest.mark.parametrize("chunk", [3, 1000])
def test_intact_chain(entries, chunk):
    assert verdicts(entries, chunk_rows=chunk) == {"a": (True, None), "b": (True, None)}


@pytest.mark.parametrize("chunk", [3, 1000])
@pytest.mark.parametrize("column, value", [
    ("flow_id", "forged"), ("confidence_score", "0.9"), ("threat_class", None), ("prev_hash", "0" * 64), ("seq", None)])
def test_edit_is_found(entries, chunk, column, value):
    hit = (F.col("chain_id") == "a") & (F.col("position") == 6)
    forged = entries.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)))
    assert verdicts(forged, chunk_rows=chunk) == {"a": (False, 6), "b": (True, None)}


def test_rewritten_entry_breaks_the_next_link(entries):
    hit = (F.col("chain_id") == "a") & (F.col("position") == 6)
    own = chain.digest(chain.entry_text(F.col("seq"), F.col("prev_hash"), chain.digest(chain.content_text(
        *[F.col(c) for c in chain.CONTENT]))))
    forged = entries.withColumn("flow_id", F.when(hit, F.lit("forged")).otherwise(F.col("flow_id"))).withColumn(
        "hash", F.when(hit, own).otherwise(F.col("hash")))
    assert verdicts(forged)["a"] == (False, 7)


def test_deleted_entry_is_found_and_late_start_is_fine(entries):
    assert verdicts(entries.filter("not (chain_id = 'a' and position = 6)"), chunk_rows=3)["a"] == (False, 7)
    assert verdicts(chain.retained(entries, 5), chunk_rows=3) == {"a": (True, None), "b": (True, None)}


def test_resume_and_key(spark, entries):
    heads = chain.chain_heads(entries)
    more = alerts(spark, 3, ("a",)).withColumn("position", F.col("position") + 12)
    grown = entries.unionByName(chain.append_chain(more, heads))
    assert verdicts(grown)["a"] == (True, None)
    assert grown.filter("chain_id = 'a'").agg(F.max("seq")).first()[0] == 14
    keyed = chain.append_chain(alerts(spark), key="k" * 70).persist()
    assert verdicts(keyed, key="k" * 70)["a"] == (True, None)
    assert verdicts(keyed)["a"] == (False, 0)


def test_hmac_matches_the_standard_one(spark):
    df = spark.createDataFrame([("text é",)], "t string")
    got = df.select(chain.digest(F.col("t"), "key")).first()[0]
    assert got == hmac.new(b"key", "text é".encode(), hashlib.sha256).hexdigest()


def scores(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "score double")


def brute_psi(base, cur, bins=10):
    lo, width = min(base), (max(base) - min(base)) / bins
    def hist(vs):
        c = [0] * bins
        for v in vs:
            c[min(max(int((v - lo) / width), 0), bins - 1)] += 1
        return c
    b, c = hist(base), hist(cur)
    return sum(((y + .5) / (len(cur) + 5) - (x + .5) / (len(base) + 5)) * math.log(((y + .5) / (len(cur) + 5)) / ((x + .5) / (len(base) + 5)))
               for x, y in zip(b, c))


def test_psi_and_ks(spark):
    rng = random.Random(3)
    base, cur = [rng.random() for _ in range(300)], [rng.random() * 1.4 for _ in range(200)] + [0.5] * 100
    assert drift.psi(scores(spark, base), scores(spark, cur)).first()[0] == pytest.approx(brute_psi(base, cur))
    want = max(abs(sum(b <= x for b in base) / 300 - sum(c <= x for c in cur) / 300) for x in base + cur)
    assert drift.ks(scores(spark, base), scores(spark, cur)).first()[0] == pytest.approx(want)
    assert drift.ks(scores(spark, base), scores(spark, base)).first()[0] == 0.0
    assert drift.psi(scores(spark, base), scores(spark, base)).first()[0] == pytest.approx(0.0)


def test_psi_edges(spark):
    flat = scores(spark, [0.5] * 5)
    assert drift.psi(flat, flat).first()[0] == 0.0
    assert drift.psi(flat, scores(spark, [0.6])).first()[0] == math.inf
    assert drift.psi(scores(spark, []), flat).first()[0] == 0.0
    assert drift.psi(scores(spark, [0.0, 1.0]), scores(spark, [])).first()[0] == 0.0


def test_rolling_drift_small_chunks(spark):
    rng = random.Random(5)
    ref = [rng.random() for _ in range(200)]
    rows = [("s", i, i // 10, rng.random() + (0.6 if i > 60 else 0)) for i in range(100)]
    df = spark.createDataFrame(rows, "stream string, seq long, batch long, score double")
    got = {r.batch: (r.n, r.psi, r.drifted) for r in drift.rolling_drift(df, scores(spark, ref), window=30, chunk_rows=30).collect()}
    for b in range(10):
        last = [v for _, i, _, v in rows if i // 10 <= b][-30:]
        assert got[b][0] == len(last)
        assert got[b][1] == pytest.approx(brute_psi(ref, last))
    assert got[9][2]


def test_reference_is_set_once(spark, tmp_path):
    path = str(tmp_path / "ref")
    assert drift.write_reference_once(scores(spark, [1.0]), path)
    assert not drift.write_reference_once(scores(spark, [2.0]), path)
    assert spark.read.parquet(path).first()[0] == 1.0


def test_retrain_needs_rows_and_reference(spark):
    from tests.test_detection import flows
    few = flows(spark, {}, {})
    assert drift.bounded_retrain(few, few, scores(spark, [0.1]))[0]["reason"] == "insufficient trusted samples"
    many = flows(spark, *[dict(ttl=50 + i % 20) for i in range(60)])
    assert "reference" in drift.bounded_retrain(many, few.limit(0), scores(spark, []))[0]["reason"]


def marks(spark):
    pairs = [("benign", "benign")] * 6 + [("benign", "recon_scanning")] * 2 + [("recon_scanning", "recon_scanning")] * 3 + [("c2_beaconing", "benign")]
    return spark.createDataFrame(pairs, "truth string, predicted string")


def test_quality_figures(spark):
    m = {r["class"]: r for r in evaluate.class_metrics(marks(spark)).collect()}
    assert m["benign"]["precision"] == pytest.approx(6 / 7) and m["benign"]["recall"] == pytest.approx(6 / 8)
    assert m["c2_beaconing"]["f1"] == 0.0 and m["c2_beaconing"]["support"] == 1 and m["volumetric_ddos"]["support"] == 0
    overall = evaluate.macro_metrics(marks(spark)).first()
    assert overall["accuracy"] == pytest.approx(9 / 12)
    assert overall["macro_recall"] == pytest.approx((6 / 8 + 1 + 0) / 3)
    assert evaluate.benign_false_positives(marks(spark)).first()[0] == pytest.approx(2 / 8)
    assert {r[0] for r in evaluate.unvalidated_classes(marks(spark)).collect()} == {
        "volumetric_ddos", "dga_dns_tunneling", "encrypted_malware", "data_exfiltration"}


def test_partition_leaks(spark):
    rows = [("train", "g1", "h1"), ("test", "g2", "h1"), ("calibration", "g3", None), ("test", "g4", None)]
    df = spark.createDataFrame(rows, "partition string, `group` string, source_sha256 string")
    with pytest.raises(ValueError, match="source_sha256"):
        evaluate.check_partitions(df)
    evaluate.check_partitions(df.filter("group <> 'g2'"))


def test_stride_and_replicas(spark):
    df = spark.range(1000).withColumnRenamed("id", "n")
    for target in (7, 333, 999):
        got = sorted(r.n for r in sampling.stride_sample(df, "n", target).collect())
        assert got == [int(i * (1000 / float(target))) for i in range(target)]
    copies = sampling.replicate(df.filter("n < 3").withColumn("flow_id", F.col("n").cast("string")), "n", 7)
    assert sorted(r.flow_id for r in copies.collect()) == sorted(f"{i % 3}_bench{i}" for i in range(7))


def test_ranks_and_quantiles_in_small_chunks(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("v"), (F.col("id") % 2).alias("k"))
    got = rank_rows(df, ["k"], "v", "r", chunk_rows=17).collect()
    for k in (0, 1):
        assert [r.r for r in sorted((x for x in got if x.k == k), key=lambda x: x.v)] == list(range(1, 251))
    import numpy as np
    values = [1.0] * 300 + [random.Random(1).random() for _ in range(50)]
    sample = spark.createDataFrame([(v,) for v in values], "v double")
    assert exact_quantiles(sample, "v", [0.05, 0.5, 0.95]) == pytest.approx(list(np.percentile(values, [5, 50, 95])))


def test_percentile_pick(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 1, 4, 2, 3, 3]], "ms double")
    got = {r.fraction: r.value for r in timings.picked_percentiles(df, "ms", [0.5, 0.95]).collect()}
    assert got == {0.5: 3.0, 0.95: 5.0}
    assert timings.window_headroom(12.0) == pytest.approx(0.9)


def test_jitter_is_reproducible(spark):
    from tests.test_detection import flows
    base = flows(spark, {}, {"entropy": 7.9})
    a, b = [sorted(map(repr, sampling.jitter_copies(base.repartition(n), 4).collect())) for n in (1, 3)]
    assert a == b and len(a) == 8
    ratios = [r.byte_ratio for r in sampling.jitter_copies(base, 4).collect()]
    assert all(0 <= r <= 1 for r in ratios) and len(set(ratios)) > 2
