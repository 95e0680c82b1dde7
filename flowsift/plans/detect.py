"""Scoring of flows by all layers, and the offline candidate fit."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsift.constants import ALL_CLASSES, BENIGN
from flowsift.operators import evaluate
from flowsift.operators.calibration import Calibration, apply_calibration, fit_calibration
from flowsift.operators.classifier import Classifier, classifier_layer, fit_classifier
from flowsift.operators.fusion import fuse
from flowsift.operators.iforest import Forest, fit_forest, forest_layer
from flowsift.operators.rules import RuleLimits, rules_layer
from flowsift.operators.zscore import Baseline, fit_baseline, zscore_layer


@dataclass(frozen=True)
class Models:
    baseline: Baseline
    forest: Forest
    classifier: Classifier
    calibration: Calibration | None = None
    limits: RuleLimits = RuleLimits()
    version: int = 1


def fit_models(flows: DataFrame, label: str = "label", *, version: int = 1, limits: RuleLimits = RuleLimits(), trees: int = 200) -> Models:
    """Baseline and forest on benign rows, classifier on all rows."""
    benign = flows.filter(F.col(label) == BENIGN)
    return Models(
        fit_baseline(benign), fit_forest(benign, version=version, trees=trees),
        fit_classifier(flows, label, version=version, trees=trees), None, limits, version)


def score_layers(flows: DataFrame, models: Models) -> DataFrame:
    """The four layer structs on each flow: narrow projections only."""
    df = rules_layer(flows, models.limits)
    df = zscore_layer(df, models.baseline)
    df = forest_layer(df, models.forest, version=models.version)
    return classifier_layer(df, models.classifier)


def detect(flows: DataFrame, models: Models) -> DataFrame:
    """Every flow with its alert columns; is_actionable marks the alerts to surface."""
    fused = apply_calibration(fuse(score_layers(flows, models)), models.calibration)
    if models.calibration is None:
        return fused
    # The gate's minimum does not change with calibration, only the confidence held against it.
    return fused.withColumn(
        "is_actionable", ~F.col("is_unnamed") & (F.col("confidence_score") >= F.col("gate_minimum")))


def candidate_report(train: DataFrame, calibration: DataFrame, test: DataFrame, *, version: int = 1,
                     limits: RuleLimits = RuleLimits(), trees: int = 200) -> tuple[dict, Models]:
    """Check the partitions for leaks, fit, calibrate and evaluate. Nothing is promoted.

    The partitions are labelled flows with group and source_sha256.
    """
    parts = {"train": train, "calibration": calibration, "test": test}
    marks = None
    for name, rows in parts.items():
        piece = rows.select(F.lit(name).alias("partition"), "group", "source_sha256")
        marks = piece if marks is None else marks.unionByName(piece)
    evaluate.check_partitions(marks)

    models = fit_models(train, version=version, limits=limits, trees=trees)
    fused = fuse(score_layers(calibration, models))
    fitted = fit_calibration(fused, F.col("threat_class") == F.col("label"))
    models = Models(models.baseline, models.forest, models.classifier, fitted, limits, version)

    scored = detect(test, models).select(
        F.col("label").alias("truth"), "threat_class", "confidence_score",
        F.when(F.col("is_actionable"), F.col("threat_class")).otherwise(BENIGN).alias("predicted")).persist()
    try:
        report = {
            "feature_version": version,
            "counts": {n: {r["label"]: r["n"] for r in evaluate.label_counts(p).collect()} for n, p in parts.items()},
            "class_order": ALL_CLASSES,
            "per_class": {r["class"]: {k: r[k] for k in ("precision", "recall", "f1", "support")}
                          for r in evaluate.class_metrics(scored).collect()},
            "overall": evaluate.macro_metrics(scored).first().asDict(),
            "confusion": [r.asDict() for r in evaluate.confusion(scored).collect()],
            "benign_false_positive_rate": evaluate.benign_false_positives(scored).first()[0],
            "brier_class_correctness": evaluate.brier(
                scored, F.col("threat_class") == F.col("truth"), F.col("confidence_score")).first()[0],
            "unvalidated_classes": sorted(r["class"] for r in evaluate.unvalidated_classes(scored).collect()),
            "promoted": False,
        }
    finally:
        scored.unpersist()
    return report, models


def cross_validate(flows: DataFrame, order: str, label: str = "label", *, k: int = 5, version: int = 1, trees: int = 200) -> DataFrame:
    """Stratified k-fold F1 of the classifier: mean, population deviation, lowest and highest per class.

    The folds are fitted one after the other; each fit is itself a distributed job.
    """
    folds = evaluate.stratified_folds(flows, label, order, k)
    results = None
    for fold in range(k):
        model = fit_classifier(folds.filter(F.col("fold") != fold), label, version=version, trees=trees)
        scored = classifier_layer(folds.filter(F.col("fold") == fold), model).select(
            F.col(label).alias("truth"), F.coalesce("xgb.threat_class_guess", F.lit(BENIGN)).alias("predicted"))
        metrics = evaluate.class_metrics(scored).withColumn("fold", F.lit(fold))
        results = metrics if results is None else results.unionByName(metrics)
    return results


def binary_anomaly(scored: DataFrame, truth: str = "label", threshold: float = 0.5) -> DataFrame:
    """(truth, predicted) as benign or anomalous, from the forest's probability."""
    return scored.select(
        F.when(F.col(truth) == BENIGN, BENIGN).otherwise("anomalous").alias("truth"),
        F.when(F.col("isoforest.calibrated_probability") < threshold, BENIGN).otherwise("anomalous").alias("predicted"))
