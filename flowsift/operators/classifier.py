"""Supervised threat classifier on pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsift.constants import ALL_CLASSES, BENIGN, THREAT_CLASSES
from flowsift.functions.core import let
from flowsift.functions.features import feature_vector
from flowsift.operators.rules import layer_score


@dataclass(frozen=True)
class Classifier:
    model: RandomForestClassificationModel
    classes: list[str]
    version: int


def class_order(present: set[str]) -> list[str]:
    """Benign first, then the threat classes that occur, in their fixed order."""
    if BENIGN not in present or len(present) < 2 or not present <= set(ALL_CLASSES):
        raise ValueError("training needs benign rows and at least one known threat class, nothing else")
    return [c for c in ALL_CLASSES if c in present]


def fit_classifier(
    flows: DataFrame, label: str = "label", *, version: int = 1, trees: int = 200, depth: int = 6, seed: int = 42,
) -> Classifier:
    """Random forest with weights n / (classes * n_class)."""
    counts = {r[label]: r["n"] for r in flows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    classes = class_order(set(counts))
    total = sum(counts.values())
    index = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, float(i))])
    weight = F.create_map(*[F.lit(x) for c in classes for x in (c, total / (len(classes) * counts[c]))])
    rows = flows.select(
        array_to_vector(feature_vector(version)).alias("features"),
        F.element_at(index, F.col(label)).alias("y"), F.element_at(weight, F.col(label)).alias("w"))
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth,
        subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)
    return Classifier(forest.fit(rows), classes, version)


def classifier_layer(flows: DataFrame, classifier: Classifier, out: str = "xgb") -> DataFrame:
    """Add the classifier layer's score struct: 1 - P(benign), best threat class when P(benign) < 0.5."""
    ready = flows.withColumn("_features", array_to_vector(feature_vector(classifier.version)))
    model = classifier.model.setFeaturesCol("_features").setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
    return probability_layer(model.transform(ready), vector_to_array("_p"), classifier.classes, out).drop(
        "_features", "_p")


def probability_layer(flows: DataFrame, probabilities, classes: list[str], out: str = "xgb") -> DataFrame:
    """Layer struct from class probabilities in ``classes`` order (benign first)."""
    names = F.array(*[F.lit(c) for c in classes])

    def read(prob: Column) -> Column:
        ranked = F.array_sort(F.transform(prob, lambda p, i: F.struct(
            (-p).alias("neg"), i.alias("i"), F.element_at(names, i + 1).alias("cls"))))
        return F.struct(F.element_at(prob, 1).alias("benign"), ranked.alias("ranked"))

    def layer(r: Column) -> Column:
        best = F.element_at(F.filter(r["ranked"], lambda x: x["cls"].isin(*THREAT_CLASSES)), 1)["cls"]
        raw = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - r["benign"]))
        said = F.transform(F.slice(r["ranked"], 1, 2), lambda x: F.format_string("%s=%.3f", x["cls"], -x["neg"]))
        return layer_score("xgb", raw, raw, F.when(r["benign"] < 0.5, best), said)

    return flows.withColumn(out, let(let(probabilities, read), layer))
