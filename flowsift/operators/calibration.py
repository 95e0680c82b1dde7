"""Calibration of the fused confidence on held-out flows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.constants import LAYERS


@dataclass(frozen=True)
class Calibration:
    coefficients: tuple[float, ...]
    intercept: float
    rows: int


def inputs() -> list[Column]:
    """Fused confidence, then the four raw layer scores."""
    return [F.col("confidence_score"), *[F.col(f"{n}.raw_score") for n in LAYERS]]


def fit_calibration(fused: DataFrame, correct: Column) -> Calibration:
    """Logistic regression with unit L2 penalty on whether the proposed class was right."""
    rows = fused.select(array_to_vector(F.array(*inputs())).alias("features"), correct.cast("double").alias("y"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("outcomes")).first()
    if seen["n"] < 20 or seen["outcomes"] != 2:
        raise ValueError("calibration needs at least 20 rows and both right and wrong predictions")
    model = LogisticRegression(
        featuresCol="features", labelCol="y", regParam=1.0 / seen["n"], elasticNetParam=0.0,
        standardization=False, maxIter=1000, tol=1e-9).fit(rows)
    return Calibration(tuple(float(c) for c in model.coefficients), float(model.intercept), seen["n"])


def apply_calibration(fused: DataFrame, calibration: Calibration | None) -> DataFrame:
    """Replace the confidence by the calibrated one and say so in the evidence."""
    if calibration is None:
        return fused.withColumn("evidence", F.concat("evidence", F.array(F.lit("confidence=uncalibrated_heuristic"))))
    value = F.lit(calibration.intercept)
    for weight, column in zip(calibration.coefficients, inputs()):
        value = value + column * F.lit(weight)
    held = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), value))
    return fused.withColumns({
        "confidence_score": F.lit(1.0) / (F.lit(1.0) + F.exp(-held)),
        "evidence": F.concat("evidence", F.array(F.lit("confidence=held_out_calibrated")))})
