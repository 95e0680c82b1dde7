"""Nothing is dropped, picked or capped without the caller asking for it."""

import pytest
from pyspark.sql import functions as F

from flowsift.functions.ja4 import code_number
from flowsift.functions.net import is_pure_syn
from flowsift.operators import drift, fusion, staging
from flowsift.operators.classifier import classifier_layer, fit_classifier
from flowsift.operators.iforest import fit_forest, forest_layer
from flowsift.plans.queries import labelled_flows
from flowsift.sources import labelled

SCORES = "capture_id string, flow_id string, layer_name string, raw_score double, calibrated_probability double, threat_class_guess string, evidence array<string>"


def long_scores(spark, rows):
    return spark.createDataFrame([(c, f, n, p, p, None, []) for c, f, n, p in rows], SCORES)


def test_layers_are_keyed_by_capture_and_flow(spark):
    rows = long_scores(spark, [("a", "f", "rules", 0.1), ("b", "f", "rules", 0.2), ("b", "f", "stats", 0.3)])
    got = {(r["capture_id"], r["flow_id"]): len(r["scores"]) for r in fusion.layers_from_long(rows, keys=("capture_id", "flow_id")).collect()}
    assert got == {("a", "f"): 1, ("b", "f"): 2}


@pytest.mark.parametrize("extra,word", [(("a", "f", "rules", 0.5), "several scores of rules"), (("a", "f", "other", 0.5), "no listed layer"),
                                        (("a", "f", None, 0.5), "no listed layer")])
def test_repeated_and_unknown_scores_raise(spark, extra, word):
    rows = long_scores(spark, [("a", "f", "rules", 0.1), extra])
    with pytest.raises(Exception, match=word):
        fusion.layers_from_long(rows).collect()


def write(path, name, text):
    path.mkdir(exist_ok=True)
    (path / name).write_text(text)


def test_files_without_label_are_reported(spark, tmp_path):
    folder = tmp_path / "csv"
    write(folder, "a.csv", " Destination Port, Label\n80,BENIGN\n81,Nonsense\n")
    write(folder, "b.csv", "Destination Port,Protocol\n1,6\n")
    write(folder, "c.csv", "")
    seen = labelled.read_labelled_csv(spark, str(folder), "cicids2017")
    report = {r["path"].rsplit("/", 1)[1]: r for r in labelled.load_report(seen, labelled.unlabelled_files(spark, str(folder))).collect()}
    assert {n: (r["rows"], r["ok"], r["unmatched"], r["unlabelled"]) for n, r in report.items()} == {
        "a.csv": (2, 1, 1, False), "b.csv": (0, 0, 0, True), "c.csv": (0, 0, 0, True)}


def test_each_lenient_file_has_its_own_header(spark, tmp_path):
    folder = tmp_path / "two"
    write(folder, "a.csv", "Destination Port,Label\n80,BENIGN\n")
    write(folder, "b.csv", "Label,Protocol,Destination Port\nDDoS,17,53\n")
    got = {r["dst_port"]: (r["label"], r["protocol"]) for r in labelled.read_lenient_csv(spark, str(folder)).collect()}
    assert got == {80: ("benign", "TCP"), 53: ("volumetric_ddos", "UDP")}


def test_zeek_rows_without_header_are_kept_and_counted(spark, tmp_path):
    folder = tmp_path / "zeek"
    write(folder, "a.log", "#fields\tts\tid.resp_p\tlabel\n1.0\t80\tBenign\n")
    write(folder, "b.log", "1.0\t80\tBenign\n")
    report = {r["path"].rsplit("/", 1)[1]: r for r in labelled.load_report(labelled.read_zeek(spark, str(folder))).collect()}
    assert (report["a.log"]["rows"], report["a.log"]["invalid"]) == (1, 0)
    assert (report["b.log"]["rows"], report["b.log"]["unmatched"], report["b.log"]["invalid"]) == (1, 1, 1)


def test_long_numbers_are_read(spark):
    rows = spark.createDataFrame([("0x" + "0" * 30 + "1301",), ("4865",), ("0" * 25 + "4865",), ("x",)], "t string")
    assert [r[0] for r in rows.select(F.pmod(code_number(F.col("t")), F.lit(65536))).collect()] == [0x1301, 4865, 4865, None]
    flags = spark.createDataFrame([("0x" + "0" * 20 + "02",), ("0x12",), ("zz",)], "f string")
    assert [r[0] for r in flags.select(is_pure_syn(F.col("f"))).collect()] == [True, False, False]


def test_forest_and_retrain_do_not_depend_on_placement(spark, sf):
    flows = labelled_flows(spark, sf).filter("label = 'benign'")
    a, b = (fit_forest(flows.repartition(n), trees=20) for n in (1, 5))
    assert a.offset == pytest.approx(b.offset, abs=1e-9) and (a.feature == b.feature).all()
    reference = flows.filter("bucket % 2 = 0")
    scores = forest_layer(reference, fit_forest(reference, trees=20)).select(F.col("isoforest.raw_score").alias("score"))
    pool = flows.filter("bucket % 2 = 1")
    many = pool.crossJoin(spark.range(-(-5500 // pool.count())).withColumnRenamed("id", "_n")).withColumn(
        "flow_id", F.concat("flow_id", F.lit("-"), F.col("_n").cast("string"))).drop("_n")
    assert many.count() > 5000
    whole = [drift.bounded_retrain(many.repartition(n), reference, scores, trees=10, min_rows=10)[0] for n in (2, 7)]
    assert whole[0]["psi"] == pytest.approx(whole[1]["psi"], abs=1e-9) and whole[0]["accepted"] == whole[1]["accepted"]
    some = [drift.bounded_retrain(many.repartition(n), reference, scores, trees=10, min_rows=10, max_rows=200)[0] for n in (2, 7)]
    assert some[0]["psi"] == pytest.approx(some[1]["psi"], abs=1e-9)


def test_classifier_learns_and_reports_probabilities(spark, sf):
    flows = labelled_flows(spark, sf)
    model = fit_classifier(flows, trees=10)
    layer = classifier_layer(flows, model)
    row = layer.agg(
        F.min("xgb.raw_score").alias("low"), F.max("xgb.raw_score").alias("high"),
        F.avg((F.coalesce("xgb.threat_class_guess", F.lit("benign")) == F.col("label")).cast("double")).alias("right")).first()
    largest = flows.groupBy("label").count().agg(F.max("count")).first()[0] / flows.count()
    assert 0 <= row["low"] <= row["high"] <= 1 and row["right"] > largest
    with pytest.raises(ValueError):
        fit_classifier(flows.filter("label <> 'benign'"), trees=2)


def test_recorded_tables_can_be_removed(spark, tmp_path):
    paths = []
    with staging.recorded(paths):
        table = staging.staged(spark.range(3).toDF("x"))
    assert table.count() == 3 and len(paths) == 1
    staging.remove(spark, paths)
    from pathlib import Path
    assert not Path(paths[0].removeprefix("file:")).exists()
