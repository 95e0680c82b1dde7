"""Combination of the layer scores of one flow into an alert, and the gate on alerts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.constants import (
    ADVISORY_MIN, ANOMALY_ROUTES, BENIGN, CORROBORATED_MIN, LAYERS, THREAT_CLASSES, UNSUPERVISED_MIN)
from flowsift.functions.core import let


def layers_from_long(scores: DataFrame, layers=tuple(LAYERS), keys=("flow_id",)) -> DataFrame:
    """Long layer scores to one row per flow with a ``scores`` array in layer order.

    ``keys`` name a flow (flow ids repeat across captures: give both then). A flow with two scores of a layer, or
    with a score of a layer that is not listed, is an error. Each layer is one aggregate column, so the shuffle is
    partially combined and a repeated flow id never builds up a list.
    """
    fields = ["layer_name", "raw_score", "calibrated_probability", "threat_class_guess", "evidence"]
    entry = F.struct(*fields)
    picked = [F.first(F.when(F.col("layer_name") == n, entry), ignorenulls=True).alias(n) for n in layers]
    name = F.col("layer_name")
    wrong = F.concat_ws(
        ", ", *[F.when(F.count_if(name == n) > 1, F.lit(f"several scores of {n}")) for n in layers],
        F.when(F.count_if(~F.coalesce(name.isin(*layers), F.lit(False))) > 0, F.lit("a score of no listed layer")))
    wide = scores.groupBy(*keys).agg(*picked, wrong.alias("_wrong"))
    told = F.concat_ws(": ", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), F.col("_wrong"))
    return wide.select(*keys, F.when(F.col("_wrong") == "", F.array_compact(F.array(*layers))).otherwise(
        F.raise_error(told)).alias("scores"))


def fuse_scores(scores: Column) -> Column:
    """Alert struct from an array of layer structs in layer order."""
    guess, p = (lambda s: s["threat_class_guess"]), (lambda s: s["calibrated_probability"])
    strings = F.array().cast("array<string>")

    def sort_out(s):
        named = F.filter(s, lambda x: F.coalesce(guess(x).isin(*THREAT_CLASSES), F.lit(False)))
        return F.struct(
            s.alias("all"), named.alias("named"),
            F.filter(s, lambda x: guess(x).isNull() & (p(x) >= UNSUPERVISED_MIN)).alias("strong"),
            F.array_distinct(F.transform(named, guess)).alias("classes"))

    def support(v):
        helped = F.filter(v["strong"], lambda x: F.size(v["classes"]) == 1)
        base = F.flatten(F.transform(v["all"], lambda x: F.coalesce(x["evidence"], strings)))
        said = F.concat(base, F.transform(helped, lambda x: F.format_string("%s_corroborates=%.3f", x["layer_name"], p(x))))
        total = F.aggregate(v["all"], F.lit(0.0), lambda a, x: a + p(x))
        return F.struct(
            v["named"].alias("named"), v["strong"].alias("strong"), v["classes"].alias("classes"),
            helped.alias("helped"), said.alias("said"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / F.size(v["all"]))).alias("confidence"),
            F.when(F.size(v["classes"]) > 0, "named").when(F.size(v["strong"]) > 0, "anomaly").otherwise("none").alias("kind"))

    def choose(v):
        def tally(cls, i):
            return let(F.concat(F.filter(v["named"], lambda x: guess(x) == cls), v["helped"]), lambda votes: F.struct(
                F.size(votes).alias("n"),
                (F.aggregate(votes, F.lit(0.0), lambda a, x: a + p(x)) / F.size(votes)).alias("mean"),
                (-i).alias("rank"), cls.alias("cls")))

        best = F.array_max(F.transform(v["classes"], tally))
        repeated = F.exists(v["classes"], lambda c: F.size(F.filter(v["named"], lambda x: guess(x) == c)) >= 2)
        corroborated = (v["kind"] == "named") & (repeated | (F.size(v["helped"]) > 0))
        return F.struct(
            v["kind"].alias("kind"), v["said"].alias("said"), v["confidence"].alias("confidence"),
            F.size(v["strong"]).alias("n_strong"), best.alias("best"), F.when(v["kind"] == "anomaly", _route(v["said"])).alias("route"),
            F.when(corroborated, CORROBORATED_MIN).otherwise(ADVISORY_MIN).alias("bar"))

    def settle(v):
        kind = v["kind"]
        agreeing = F.when(kind == "named", v["best"]["n"]).when(kind == "anomaly", v["n_strong"]).otherwise(0)
        tier = F.when(kind == "anomaly", "advisory").when(agreeing >= 2, "high").when(
            agreeing == 1, "advisory").otherwise("uncorroborated")
        extra = (
            F.when(kind == "anomaly", F.array(
                F.lit("unclassified_anomaly=true"),
                F.concat(F.lit("unsupervised_layers_alerted="), v["n_strong"].cast("string"))))
            .when(kind == "none", F.array(F.lit("no_layer_named_a_threat_class"))).otherwise(strings))
        last = F.array(F.concat(F.lit("tier="), tier), F.concat(F.lit("corroborating_layers="), agreeing.cast("string")))
        return F.struct(
            F.when(kind == "named", v["best"]["cls"]).when(kind == "anomaly", v["route"]).otherwise("volumetric_ddos").alias("threat_class"),
            v["confidence"].alias("confidence_score"), tier.alias("tier"), agreeing.alias("corroborating_layers"),
            F.concat(v["said"], extra, last).alias("evidence"),
            ((kind != "none") & (v["confidence"] >= v["bar"])).alias("is_actionable"),
            (kind == "anomaly").alias("is_anomaly_route"), v["bar"].alias("gate_minimum"), (kind == "none").alias("is_unnamed"))

    return let(let(let(let(scores, sort_out), support), choose), settle)


def _route(said: Column) -> Column:
    """Nearest class of an unnamed anomaly, from the words of its evidence."""
    def pick(text):
        route = None
        for cls, words in ANOMALY_ROUTES:
            found = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
            route = F.when(found, cls) if route is None else route.when(found, cls)
        return route.otherwise("recon_scanning")
    return let(F.lower(F.array_join(said, " ")), pick)


ALERT_FIELDS = ["threat_class", "confidence_score", "tier", "corroborating_layers", "evidence", "is_actionable",
                "is_anomaly_route", "gate_minimum", "is_unnamed"]


def fuse(flows: DataFrame, scores: Column | None = None) -> DataFrame:
    """Add the alert columns to flows. ``scores`` defaults to the four layer columns, in order."""
    scores = scores if scores is not None else F.array(*LAYERS)
    fused = flows.withColumn("_alert", fuse_scores(scores))
    return fused.select("*", *[F.col(f"_alert.{n}").alias(n) for n in ALERT_FIELDS]).drop("_alert")


def gate(fused: DataFrame) -> DataFrame:
    """Only the alerts worth surfacing."""
    return fused.filter("is_actionable")


def alerts(fused: DataFrame) -> DataFrame:
    """Alert rows of a fused table. The alert time is the flow's own time."""
    return fused.select("timestamp", "flow_id", "threat_class", "confidence_score", "evidence")


def benign_consensus(fused: DataFrame, min_benign: float = 0.9, max_raw: float = 0.25) -> DataFrame:
    """Flows all four layers take for benign: candidates for a later refit.

    The classifier layer reports 1 - P(benign) and no class for benign flows, so its condition is
    P(benign) >= min_benign.
    """
    quiet = reduce(lambda a, b: a & b, [
        F.coalesce(F.col(f"{n}.threat_class_guess"), F.lit(BENIGN)).eqNullSafe(BENIGN)
        & (F.col(f"{n}.raw_score") <= max_raw) for n in LAYERS[:3]])
    sure = (1 - F.col("xgb.raw_score") >= min_benign) & F.coalesce(
        F.col("xgb.threat_class_guess"), F.lit(BENIGN)).eqNullSafe(BENIGN)
    return fused.filter(quiet & sure)
