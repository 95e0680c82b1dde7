"""Headline timings, one JSON line.

Each figure is the wall time of one complete run after a warm-up on the smallest tables, so code
generation and the JVM's start stay out, as in the published figures this is compared with.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from flowsift.operators import boosting, chain, fusion, state, flows as fl
from flowsift.operators.iforest import fit_forest, forest_layer
from flowsift.operators.rules import rules_layer
from flowsift.operators.sampling import replicate
from flowsift.operators.staging import staged
from flowsift.operators.zscore import fit_baseline, zscore_layer
from flowsift.plans import queries as q
from flowsift.sources.tables import table

WARM_DIR = "/root/testdata/sf0.001"


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        # Small test files: let a scan use every core.
        .config("spark.sql.files.maxPartitionBytes", "2m").config("spark.sql.files.openCostInBytes", "64k")
        .getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    return spark


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def measure(spark, folder: str, target: int = 0) -> dict[str, float]:
    times: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        result = action()
        times[name] = round(time.perf_counter() - start, 3)
        return result

    packets = staged(q.packets(spark, folder))
    windowed = fl.in_windows(packets, q.DAY)
    flows = timed("packets_to_flows", lambda: staged(fl.build_flows(
        packets, window_us=q.DAY, horizon_us=7 * q.DAY, beacon_lookback_us=30 * q.DAY, protected=q.PROTECTED)))
    flows = flows.repartition(spark.sparkContext.defaultParallelism).persist()
    n_flows, n_packets = flows.count(), packets.count()
    base = fit_baseline(flows.filter("dst_port = 80"))
    # A plan is set up once and then serves any number of flows, so scoring is timed without set-up.
    fused = fusion.fuse(q.given_scores(zscore_layer(rules_layer(flows, q.LIMITS), base)))
    ruled, rated = rules_layer(flows, q.LIMITS), zscore_layer(flows, base)
    timed("rules_zscore_fusion", lambda: run(fused))
    timed("rules", lambda: run(ruled))
    timed("zscore", lambda: run(rated))
    forest = timed("forest_fit", lambda: fit_forest(flows.filter("dst_port = 80")))
    isolated = forest_layer(flows, forest)
    timed("forest_score", lambda: run(isolated))
    timed("payload_entropy", lambda: run(fl.payload_entropy(windowed)))
    timed("document_entropy", lambda: run(q.a4_document_entropy(spark, folder)))
    seen = staged(fl.sightings(fl.with_reverse(fl.packet_totals(windowed))))
    timed("horizon_fanout", lambda: run(state.horizon_fanout(seen, horizon_us=7 * q.DAY)))
    timed("beacon_intervals", lambda: run(state.beacon_intervals(seen, lookback_us=30 * q.DAY, keep=64)))
    timed("carried_ja4", lambda: run(state.carried_ja4(seen, horizon_us=7 * q.DAY)))
    timed("psi", lambda: run(q.dr1_psi(spark, folder)))
    timed("ks", lambda: run(q.dr2_ks(spark, folder)))
    alerts = flows.select(
        F.col("capture_id").alias("chain_id"), F.col("first_frame").alias("position"), "timestamp", "flow_id",
        F.lit("recon_scanning").alias("threat_class"), F.col("entropy").alias("confidence_score"), F.array("protocol").alias("evidence"))
    entries = timed("chain_append", lambda: staged(chain.append_chain(chain.canonical_alerts(alerts))))
    timed("chain_verify", lambda: run(chain.verify_chains(entries)))
    timed("ja4", lambda: run(q.p7_ja4(spark, folder)))
    timed("distinct_ratio", lambda: run(q.e6_distinct_ratio(spark, folder)))
    times["_flows"], times["_packets"] = n_flows, n_packets
    times["_rates"] = scoring_rates(flows, base, forest, target) if target else {}
    flows.unpersist()
    return times


def scoring_rates(flows, base, forest, target: int) -> dict[str, float]:
    """Flows a second of each layer over ``target`` flows (the given ones repeated), medians of three runs."""
    many = replicate(flows, "first_frame", target).repartition(2 * flows.sparkSession.sparkContext.defaultParallelism).persist()
    n = many.count()
    boosted = boosting.fit_boosted_flows(q.with_labels(flows), settings=boosting.Settings(rounds=10, depth=6))
    jobs = {
        "rules": rules_layer(many, q.LIMITS), "zscore": zscore_layer(many, base), "forest_score": forest_layer(many, forest),
        "boosted_score_10_rounds": boosting.boosted_layer(many, boosted),
        "rules_zscore_fusion": fusion.fuse(q.given_scores(zscore_layer(rules_layer(many, q.LIMITS), base)))}
    out = {}
    for name, df in jobs.items():
        spent = []
        for _ in range(3):
            start = time.perf_counter()
            run(df)
            spent.append(time.perf_counter() - start)
        out[f"{name}_flows_per_s_over_{n}"] = n / sorted(spent)[1]
    many.unpersist()
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    measure(spark, WARM_DIR if os.path.isdir(WARM_DIR) else folder)
    times = measure(spark, folder, target=1_000_000)
    flows, packets, large = (times.pop(k) for k in ("_flows", "_packets", "_rates"))
    rates = {
        "packets_to_flows_flows_per_s": flows / times["packets_to_flows"],
        "packets_to_flows_packets_per_s": packets / times["packets_to_flows"],
        "rules_zscore_fusion_flows_per_s": flows / times["rules_zscore_fusion"],
        "rules_flows_per_s": flows / times["rules"],
        "zscore_flows_per_s": flows / times["zscore"],
        "forest_score_flows_per_s": flows / times["forest_score"],
        "all_layers_flows_per_s": flows / (times["rules_zscore_fusion"] + times["forest_score"]),
        "chain_append_per_s": flows / times["chain_append"],
        **large,
    }
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "flows": flows, "packets": packets,
        "rates": {k: round(v, 1) for k, v in rates.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
