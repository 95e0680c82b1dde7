"""One query per operator over the test tables. Each takes (spark, folder) and returns a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.constants import BENIGN, SUSPICIOUS_PORTS
from flowsift.functions import ja4 as tls
from flowsift.functions.features import FEATURE_NAMES, WIDTH, feature_columns
from flowsift.functions.labels import map_labels, substring_label
from flowsift.functions.net import direction, flow_id, in_networks, int_div, is_pure_syn, window_bucket
from flowsift.functions.scores import confidence_tier, severity, squash
from flowsift.operators import chain, dashboard, drift, evaluate, flows as fl, fusion, sampling, state, timings
from flowsift.operators import boosting
from flowsift.operators.calibration import Calibration, apply_calibration, fit_calibration, inputs as calibration_inputs
from flowsift.operators.classifier import classifier_layer, fit_classifier, probability_layer
from flowsift.operators.iforest import Forest, fit_forest, forest_layer
from flowsift.operators.ordered import rank_rows
from flowsift.operators.rules import RuleLimits, layer_score, rules_layer
from flowsift.operators.staging import shared_folder, staged
from flowsift.operators.zscore import baseline_table, fit_baseline, zscore_layer
from flowsift.plans import detect as plans
from flowsift.sources import flow_json, labelled, packet_json, sinks
from flowsift.sources.tables import epoch_us, packets_from_events, table
from flowsift.schemas import PACKET_DDL
from flowsift.streaming import detection, state as keyed, windows

DAY = 86_400_000_000
PROTECTED = ["10.0.0.0/8"]

# The rule limits scaled to one-day windows, where rates are a millionth of those in 120 ms.
LIMITS = RuleLimits(
    syn_flood_rate=0.00003, distributed_rate=0.00005, distributed_entropy=1.01, beacon_max_s=260_000,
    beacon_jitter=0.6, dns_entropy=4.51, port_entropy=5.43, no_sni_entropy=5.33, no_alpn_entropy=5.41,
    high_entropy=5.47, exfil_bytes=4000)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(*columns: str):
    return [(F.round(c, 6) + 0.0).alias(c) for c in columns]


def r6s(*columns: str, digits: int = 6):
    """Rounded seconds. Means of microsecond gaps often end exactly on half a microsecond, where
    the last bit decides; the small shift moves them off that edge in both engines."""
    return [(F.round(F.col(c) + 0.00000013, digits) + 0.0).alias(c) for c in columns]


def packets(spark, folder) -> DataFrame:
    return packets_from_events(table(spark, folder, "events"))


def windowed(spark, folder) -> DataFrame:
    return fl.in_windows(packets(spark, folder), DAY)


def totals(spark, folder) -> DataFrame:
    return fl.packet_totals(windowed(spark, folder))


def kept(spark, folder) -> DataFrame:
    return fl.with_reverse(totals(spark, folder))


def flows(spark, folder) -> DataFrame:
    return fl.build_flows(
        packets(spark, folder), window_us=DAY, horizon_us=7 * DAY, beacon_lookback_us=30 * DAY, protected=PROTECTED)


def given_scores(df: DataFrame) -> DataFrame:
    """Deterministic stand-ins for the two fitted layers, as scores an outside system would supply."""
    raw = F.least(F.lit(1.0), F.col("entropy") / 6)
    threat = (1 - F.pmod(F.col("bucket") * 7 + F.col("src_port") + F.col("dst_port"), F.lit(10)) / 10.0)
    top = (
        F.when(F.col("dst_port") == 80, "volumetric_ddos").when(F.col("dst_port") == 443, "c2_beaconing")
        .when(F.col("dst_port") == 53, "dga_dns_tunneling").when(F.col("dst_port") == 8443, "recon_scanning")
        .when(F.col("dst_port") == 4444, "encrypted_malware").otherwise("data_exfiltration"))
    none = F.array().cast("array<string>")
    return df.withColumn("isoforest", layer_score("isoforest", raw, squash(raw, 0.6), None, none)).withColumn(
        "xgb", layer_score("xgb", threat, threat, F.when(1 - threat < 0.5, top), F.array(F.concat(top, F.lit("=0")))))


def scored(spark, folder) -> DataFrame:
    f = staged(flows(spark, folder))
    base = fit_baseline(f.filter("dst_port = 80"))
    return given_scores(zscore_layer(rules_layer(f, LIMITS), base))


def in_range(metrics: DataFrame) -> DataFrame:
    """Support per class, and whether the other figures of the class can be right."""
    fine = [F.col(n).between(0, 1) for n in ("precision", "recall", "f1")]
    between = F.col("f1").between(F.least("precision", "recall") - 1e-9, F.greatest("precision", "recall") + 1e-9)
    return metrics.select("class", "support", (fine[0] & fine[1] & fine[2] & between).alias("in_range"))


def fused(spark, folder) -> DataFrame:
    return fusion.fuse(scored(spark, folder))


def surfaced(spark, folder) -> DataFrame:
    scored_once = staged(fused(spark, folder).drop("rules", "stats", "isoforest", "xgb"))
    return fusion.gate(scored_once)


def with_labels(df: DataFrame) -> DataFrame:
    """Truth by service port, for the fitted layers."""
    return df.withColumn("label", F.when(F.col("dst_port") == 53, "dga_dns_tunneling")
                         .when(F.col("dst_port") == 443, "c2_beaconing").when(F.col("dst_port") == 8443, "recon_scanning")
                         .when(F.col("dst_port") == 4444, "encrypted_malware").otherwise(BENIGN))


def labelled_flows(spark, folder) -> DataFrame:
    return staged(with_labels(flows(spark, folder)))


def doc_marks(spark, folder) -> DataFrame:
    """Truth from the label table, prediction from a length rule on the documents."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    joined = docs.join(table(spark, folder, "labels"), "doc_id")
    n = F.col("n_chars")
    return joined.select(
        "doc_id", "lang", "source",
        F.when(F.col("toxic") == 1, "data_exfiltration").when(F.col("quality") == 1, "benign").otherwise("recon_scanning").alias("truth"),
        F.when(n < 600, "recon_scanning").when(n < 4000, "benign").when(n < 20000, "data_exfiltration")
        .otherwise("c2_beaconing").alias("predicted"),
        (1 / (1 + n / 1000.0)).alias("confidence"))


def score_halves(spark, folder) -> tuple[DataFrame, DataFrame]:
    events = table(spark, folder, "events").select(epoch_us(F.col("ts")).alias("t"), F.col("value"))
    cut = events.agg(F.min("t")).first()[0] + 15 * DAY
    return (events.filter(F.col("t") < cut).select(F.col("value").alias("score")),
            events.filter(F.col("t") >= cut).select((F.col("value") * 1.2).alias("score")))


def fresh_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query
def flagship_verdicts(spark, folder):
    ruled = rules_layer(flows(spark, folder), LIMITS)
    return ruled.groupBy(F.coalesce("rules.threat_class_guess", F.lit("none")).alias("verdict")).agg(
        F.count(F.lit(1)).alias("flows"), F.round(F.avg("rules.raw_score"), 6).alias("mean_score"))


# ---- sources and sinks ----

def packet_json_lines(p: DataFrame) -> DataFrame:
    """Packets in the dissected-packet JSON layout."""
    code = F.create_map(*[F.lit(x) for kv in {"A": "1", "AAAA": "28", "TXT": "16", "MX": "15"}.items() for x in kv])
    text = lambda c: F.col(c).cast("string")
    tcp, udp = F.col("protocol") == "TCP", F.col("protocol") == "UDP"
    layers = F.struct(
        F.struct(text("frame_no").alias("frame.number"), text("frame_len").alias("frame.len"),
                 (F.col("ts_us").cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(8,0)")).cast("decimal(20,6)")
                 .cast("string").alias("frame.time_epoch")).alias("frame"),
        F.struct(F.col("src_ip").alias("ip.src"), F.col("dst_ip").alias("ip.dst"), text("ttl").alias("ip.ttl")).alias("ip"),
        F.when(tcp, F.struct(text("src_port").alias("tcp.srcport"), text("dst_port").alias("tcp.dstport"),
                             F.when(F.col("is_syn"), "0x0002").otherwise("0x0012").alias("tcp.flags"))).alias("tcp"),
        F.when(udp, F.struct(text("src_port").alias("udp.srcport"), text("dst_port").alias("udp.dstport"))).alias("udp"),
        F.when(F.size("dns_names") > 0, F.struct(F.struct(F.struct(
            F.get("dns_names", F.lit(0)).alias("dns.qry.name"),
            F.element_at(code, F.col("dns_type")).alias("dns.qry.type")).alias("query")).alias("Queries"))).alias("dns"),
        F.when(F.col("ja4").isNotNull(), F.struct(F.lit("1").alias("tls.handshake.type"), F.col("ja4").alias("tls.handshake.ja4"))).alias("tls"),
        F.when(F.col("payload_hex") != "", F.struct(F.col("payload_hex").alias("data.data"))).alias("data"))
    return p.select(F.to_json(F.struct(F.struct(layers.alias("layers")).alias("_source"))).alias("value"))


@query
def s1_packet_json(spark, folder):
    path = fresh_folder(spark)
    packet_json_lines(packets(spark, folder)).write.text(path)
    back = packet_json.read_packets(spark, path, capture_id="c")
    return back.select(
        "frame_no", "ts_us", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "frame_len", "ttl", "payload_hex",
        F.coalesce(F.get("dns_names", F.lit(0)), F.lit("")).alias("dns_name"), "dns_type", "is_syn", "ja4")


@query
def s2_flow_records(spark, folder):
    path = fresh_folder(spark)
    _flow_lines(spark, folder).write.text(path)
    read = flow_json.read_flow_lines(spark, path)
    return read.groupBy(F.coalesce(F.get("violations", F.lit(0)), F.lit("valid")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query
def s3_stream_quarantine(spark, folder):
    """Records in three files, a micro-batch each: rows by outcome, and the counters the stream kept."""
    path, out = fresh_folder(spark), fresh_folder(spark)
    _flow_lines(spark, folder).repartition(3).write.text(path)
    flow_json.quarantine_stream(flow_json.stream_flow_lines(spark, path, maxFilesPerTrigger=1), out).awaitTermination()
    flows = spark.read.parquet(f"{out}/flows").groupBy(F.lit("valid").alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    rejected = spark.read.parquet(f"{out}/rejected").groupBy(F.get("violations", F.lit(0)).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    counted = spark.read.parquet(f"{out}/counters").agg(F.sum("valid").alias("valid"), F.sum("rejected").alias("rejected"))
    return flows.unionAll(rejected).unionAll(counted.select(F.lit("counted valid"), "valid")).unionAll(
        counted.select(F.lit("counted rejected"), "rejected"))


def _flow_lines(spark, folder):
    """Events as flow records in JSON lines, some broken or against a rule."""
    e = table(spark, folder, "events")
    m = F.pmod("event_id", F.lit(50))
    record = F.to_json(F.struct(
        F.col("event_id").cast("string").alias("flow_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit(1).alias("src_port"), F.lit(80).alias("dst_port"), F.lit("TCP").alias("protocol"),
        F.struct(F.col("value").alias("min"), F.col("value").alias("max"), F.col("value").alias("mean"), F.lit(0.0).alias("std")).alias("packet_size_stats"),
        F.struct(F.lit(0.1).alias("mean"), F.lit(0.0).alias("std")).alias("inter_arrival_stats"),
        F.lit(3.0).alias("entropy"), F.lit(0.5).alias("byte_ratio"), F.when(m != 1, 64).alias("ttl"),
        F.when(m == 2, 1.5).otherwise(0.5).alias("syn_fraction"), F.when(m == 3, -1.0).otherwise(2.0).alias("pkt_rate")))
    return e.select(F.when(m == 0, F.concat(F.lit("{broken "), record)).otherwise(record).alias("value"))


@query
def s3_validation(spark, folder):
    spoiled = flows(spark, folder).withColumn("syn_fraction", F.when(F.col("dst_port") == 53, 2.0).otherwise(F.col("syn_fraction")))
    return flow_json.with_violations(spoiled).agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.size("violations") > 0).alias("rejected"),
        F.count_if(F.size("violations") == 0).alias("accepted"))


def _label_text(click, view, error, signup, other):
    t = F.col("event_type")
    return F.when(t == "click", click).when(t == "view", view).when(t == "error", error).when(t == "signup", signup).otherwise(other)


def _labelled_csv(spark, folder) -> str:
    path = fresh_folder(spark)
    table(spark, folder, "events").select(
        (F.pmod("user_id", F.lit(100)) + 1).alias(" Destination Port"), F.col("event_id").alias(" Total Fwd Packets"),
        F.lit(7).alias("Total Length of Bwd Packets"), F.lit(10).alias(" Flow Duration"), F.lit(0.5).alias(" Fwd IAT Mean"),
        _label_text("BENIGN", "DDoS", "PortScan", "Bot", "Infiltration").alias(" Label"),
    ).write.option("header", True).csv(path)
    return path


@query
def s4_labelled_csv(spark, folder):
    seen = labelled.read_labelled_csv(spark, _labelled_csv(spark, folder), "cicids2017")
    return seen.groupBy("label", F.size("measurements").alias("n_measures")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("measurements.dst_port").cast("bigint")).alias("ports"))


def lenient_csv(spark, folder) -> str:
    e = F.col("event_id")
    path = fresh_folder(spark)
    table(spark, folder, "events").select(
        F.lit(80).alias("Destination Port"), F.pmod("user_id", F.lit(9)).alias("Total Fwd Packets"),
        (F.pmod("user_id", F.lit(7)) * 100).alias("Total Length of Fwd Packets"),
        F.when(F.pmod(e, F.lit(11)) == 0, "NaN").otherwise(F.pmod(e, F.lit(300)).cast("string")).alias("Fwd Packet Length Mean"),
        F.when(F.pmod(e, F.lit(13)) == 0, "Infinity").otherwise((F.pmod(e, F.lit(5)) * 700).cast("string")).alias("Fwd IAT Mean"),
        (F.pmod(e, F.lit(1000)) * 100).alias("Flow Duration"), _label_text("BENIGN", "DDoS", "PortScan", "Bot", "FTP-Patator").alias("Label"),
    ).write.option("header", True).csv(path)
    return path


@query
def s5_lenient_csv(spark, folder):
    read = labelled.read_lenient_csv(spark, lenient_csv(spark, folder))
    return read.groupBy(F.coalesce("label", F.lit("none")).alias("label")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("inter_arrival_stats.mean"), 6).alias("gap_mean"),
        F.round(F.avg("byte_ratio"), 6).alias("byte_ratio"))


@query
def s6_zeek_log(spark, folder):
    rows = table(spark, folder, "events").select(F.concat_ws("\t", F.lit("1.0"), F.lit("10.0.0.1"),
        (F.pmod("user_id", F.lit(100)) + 1).cast("string"), F.lit("tcp"), F.lit("-"),
        _label_text("Benign", "C&C-HeartBeat", "PartOfAHorizontalPortScan", "Okiru", "Attack")).alias("value"))

    def with_header(batches):
        import pandas as pd
        yield pd.DataFrame({"value": ["#separator x09", "#fields\tts\tid.orig_h\tid.resp_p\tproto\tlabel\tdetailed-label"]})
        yield from batches

    path = fresh_folder(spark)
    rows.mapInPandas(with_header, "value string").write.text(path)
    seen = labelled.read_zeek(spark, path, "iot23", endings=(".txt",))
    return seen.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("measurements.dst_port").cast("bigint")).alias("ports"))


@query
def s7_provenance(spark, folder):
    path = _labelled_csv(spark, folder)
    seen = labelled.matched(labelled.read_labelled_csv(spark, path, "cicids2017", provenance=True))
    # The streamed digests against those of the engine's own function over whole contents.
    whole = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("want"))
    own = F.col("measurements.fwd_pkts").cast("bigint")
    return seen.join(whole, "path", "left").filter(F.col("row") >= 2).agg(
        F.count(F.lit(1)).alias("n"), F.sum(own).alias("ids"), F.sum(F.pmod(own, F.lit(97))).alias("check"),
        F.count_if(F.col("sha256") == F.col("want")).alias("hashed"))


@query
def s6_iot23_folder(spark, folder):
    """Logs and CSV files of one folder, each with its own header, as exported observations."""
    path = fresh_folder(spark)
    parts = table(spark, folder, "events").select(
        (F.pmod("user_id", F.lit(100)) + 1).alias("Destination Port"), F.col("event_id").alias("Total Fwd Packets"),
        _label_text("Benign", "C&C-HeartBeat", "PartOfAHorizontalPortScan", "Okiru", "DDoS").alias("Label"))
    log = parts.filter("`Total Fwd Packets` % 3 = 0").select(F.concat_ws("\t", "Total Fwd Packets", "Destination Port", F.lit("-"), "Label").alias("value"))

    def with_header(batches):
        import pandas as pd
        yield pd.DataFrame({"value": ["#separator x09", "#fields\torig_pkts\tid.resp_p\tlabel\tdetailed-label"]})
        yield from batches

    log.mapInPandas(with_header, "value string").write.text(f"{path}/logs")
    parts.filter("`Total Fwd Packets` % 3 <> 0").write.option("header", True).csv(f"{path}/csv")
    seen = labelled.read_iot23(spark, path, provenance=True, log_endings=(".txt",))
    return labelled.observation_records(seen).groupBy("label", "record_type", F.col("source.path").endswith(".csv").alias("csv")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("measurements.dst_port").cast("bigint")).alias("ports"),
        F.sum(F.col("measurements.fwd_pkts").cast("bigint")).alias("ids"), F.array_join(F.first("missing_features"), ",").alias("missing"))


@query
def s8_sinks(spark, folder):
    path = fresh_folder(spark)
    f = flows(spark, folder)
    sinks.write_json_lines(f, path)
    return spark.read.schema(f.schema).json(path).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("packet_size_stats.mean"), 3).alias("size_mean"),
        F.sum("fanout_count").alias("fanout"))


# ---- projections and predicates ----

@query
def p1_window_bucket(spark, folder):
    return packets(spark, folder).groupBy(window_bucket(F.col("ts_us"), 120_000).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_ts"), F.max("ts_us").alias("last_ts"))


@query
def p2_flow_id(spark, folder):
    c = F.col
    return windowed(spark, folder).select("frame_no", flow_id(
        c("src_ip"), c("src_port"), c("dst_ip"), c("dst_port"), c("protocol"), c("bucket")).alias("flow_id"))


@query
def p3_pure_syn(spark, folder):
    v = F.col("l_quantity").cast("bigint")
    flags = F.when(F.col("l_linenumber") == 7, "zz").otherwise(F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(v), 4, "0"))))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", flags.alias("flags")).withColumn(
        "is_syn", is_pure_syn(F.col("flags")))


@query
def p4_dns_fields(spark, folder):
    lines = packet_json_lines(packets(spark, folder).filter(F.size("dns_names") > 0))
    raw = lines.select(F.get_json_object("value", "$._source.layers.dns").alias("dns"),
                       F.get_json_object("value", "$._source.layers.frame['frame.number']").cast("bigint").alias("frame_no"))
    return raw.select("frame_no", F.get(packet_json.dns_names(F.col("dns")), F.lit(0)).alias("dns_name"),
                      packet_json.dns_type(F.col("dns")).alias("dns_type"))


@query
def p5_networks(spark, folder):
    p = packets(spark, folder)
    return p.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(in_networks(F.col("src_ip"), PROTECTED)).alias("in_wide"),
        F.bool_or(in_networks(F.col("src_ip"), ["10.0.0.4/30", "2001:db8::/32"])).alias("in_narrow"))


@query
def p6_direction(spark, folder):
    way = direction(in_networks(F.col("src_ip"), PROTECTED), in_networks(F.col("dst_ip"), PROTECTED))
    return packets(spark, folder).groupBy(way.alias("direction")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("frame_len").alias("bytes"))


def hellos(spark, folder) -> DataFrame:
    """Client Hello fields derived from the embedding table's numbers."""
    v, label = F.col("vec_id"), F.col("label")
    mod = lambda n: F.pmod(v, F.lit(n))
    pick = lambda items, n: F.element_at(F.array(*[F.lit(i) for i in items]), (mod(n) + 1).cast("int"))
    none = F.array().cast("array<string>")
    return table(spark, folder, "embeddings").select(
        "vec_id", F.when(mod(5) == 0, "UDP").otherwise("TCP").alias("protocol"),
        pick(["0x0301", "0x0302", "0x0303", "0x0304", "0x0300", "0x0002", "0x9999"], 7).alias("version"),
        F.when(mod(2) == 0, F.array(F.lit("0x0304"), F.lit("0x0303"), F.lit("0x3a3a"))).otherwise(none).alias("versions"),
        F.array(pick(["0x1301", "0x1302", "0xc02f", "4865", "0x0a0a"], 5),
                F.concat(F.lit("0x"), F.lower(F.hex(mod(512) + 4096))), (label + 49195).cast("string")).alias("ciphers"),
        F.array(mod(20).cast("string"), label.cast("string"), F.lit("16"), F.lit("0x2a2a")).alias("extensions"),
        F.when(mod(4) == 0, "h2").when(mod(4) == 1, "http/1.1").when(mod(4) == 2, "").alias("alpn"),
        F.when(mod(3) == 0, F.concat(F.lit("host"), v.cast("string"), F.lit(".example.test")))
        .when(mod(3) == 1, F.concat(F.lit("10.0.0."), mod(256).cast("string"))).alias("sni"),
        F.when(mod(6) == 0, none).otherwise(F.array(F.lit("0x0403"), F.lit("0x0804"), F.lit("0x0a0a"))).alias("sigs"))


@query
def p7_ja4(spark, folder):
    c = F.col
    made = tls.ja4(c("protocol"), c("version"), c("versions"), c("ciphers"), c("extensions"), c("alpn"), c("sni"), c("sigs"))
    return hellos(spark, folder).select("vec_id", made.alias("ja4")).withColumns(
        {"no_sni": tls.lacks_sni(c("ja4")), "no_alpn": tls.lacks_alpn(c("ja4"))})


@query
def p8_ja4_tests(spark, folder):
    j = F.col("ja4")
    return packets(spark, folder).filter(j.isNotNull()).groupBy("ja4").agg(F.count(F.lit(1)).alias("n")).select(
        "ja4", tls.is_malicious(j).alias("malicious"), tls.lacks_sni(j).alias("no_sni"), tls.lacks_alpn(j).alias("no_alpn"), "n")


@query
def p9_features(spark, folder):
    named = flows(spark, folder).select("flow_id", "capture_id", *feature_columns(2))
    renamed = named.withColumnsRenamed(dict(zip(FEATURE_NAMES, [
        "gap_mean", "gap_std", "size_mean", "size_std", "size_min", "size_max", "entropy", "byte_ratio", "ttl", "fanout_count",
        "dns_ngram_entropy", "has_beacon", "has_ja4", "malicious", "no_sni", "no_alpn"]))).withColumnsRenamed({
            "outbound_bytes_log1p": "out_log", "outbound_observed": "out_seen", "dns_is_txt": "is_txt", "dns_query_len": "query_len"})
    return renamed.select(
        "flow_id", "capture_id",
        *r6s("gap_mean", "gap_std"), *r6("size_mean", "size_std", "size_min", "size_max", "entropy", "byte_ratio"),
        "ttl", "fanout_count", *r6("dns_ngram_entropy"), "has_beacon", "has_ja4", "malicious", "no_sni", "no_alpn",
        *r6("out_log"), "out_seen", "is_txt", *r6("query_len"))


@query
def p10_exact_labels(spark, folder):
    t = F.col("event_type")
    raw = F.when(t == "click", "Benign").when(t == "error", " DDoS ").when(t == "signup", "PortScan").otherwise(t)
    rows = table(spark, folder, "events").select(raw.alias("raw"), F.lit("cicids2017").alias("dataset"))
    return map_labels(rows, "raw", "dataset").groupBy("raw", "threat_class").agg(F.count(F.lit(1)).alias("n"))


@query
def p11_substring_labels(spark, folder):
    raw = _label_text("BENIGN", "FTP-Patator", "DoS Hulk", "Bot", "Port_Scan")
    return table(spark, folder, "events").select(raw.alias("raw")).withColumn(
        "threat_class", substring_label(F.col("raw"))).groupBy("raw", "threat_class").agg(F.count(F.lit(1)).alias("n"))


@query
def p12_severity(spark, folder):
    return fused(spark, folder).groupBy(
        "threat_class", severity(F.col("threat_class")).alias("severity"),
        confidence_tier(F.col("confidence_score")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query
def p13_squash(spark, folder):
    return table(spark, folder, "events").select("event_id", F.round(squash(F.col("value") / 500), 6).alias("p"))


@query
def p14_jitter(spark, folder):
    made = sampling.jitter_copies(flows(spark, folder).filter("dst_port = 80"), 5)
    return made.withColumn("size_mean", F.col("packet_size_stats.mean")).select(
        "flow_id", "capture_id", "copy", *r6("size_mean", "entropy", "byte_ratio"))


@query
def p15_stride_sample(spark, folder):
    return sampling.stride_sample(table(spark, folder, "events"), "event_id", 333).select("event_id", "value")


@query
def p16_replicate(spark, folder):
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("copy_id"))
    return sampling.replicate(rows, "vec_id", rows.count() * 5 // 2, "copy_id").select("copy_id", "vec_id")


# ---- aggregates of one window ----

@query
def a1_flow_assembly(spark, folder):
    return totals(spark, folder).select(*fl.FLOW_KEYS, "n_packets", "n_sized")


@query
def a2_size_stats(spark, folder):
    return totals(spark, folder).select(*fl.FLOW_KEYS, *r6("size_min", "size_max", "size_mean", "size_std"))


@query
def a3_inter_arrival(spark, folder):
    return fl.inter_arrivals(windowed(spark, folder)).select(*fl.FLOW_KEYS, *r6s("gap_mean", "gap_std"))


@query
def a4_payload_entropy(spark, folder):
    return fl.payload_entropy(windowed(spark, folder)).select(*fl.FLOW_KEYS, *r6("entropy"))


@query
def a4_document_entropy(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("bytes"))
    return fl.byte_entropy(docs, ["doc_id"], F.lit(0), "bytes", "entropy").select("doc_id", *r6("entropy"))


@query
def a5_payload_fraction(spark, folder):
    return totals(spark, folder).filter("n_sized > 0").select(*fl.FLOW_KEYS, F.round(
        F.least(F.lit(1.0), F.col("payload_bytes") / F.col("total_bytes")), 6).alias("byte_ratio"))


@query
def a6_window_fanout(spark, folder):
    return fl.window_fanout(totals(spark, folder))


def _targets(spark, folder):
    return fl.target_profile(totals(spark, folder), DAY)


@query
def a7_source_entropy(spark, folder):
    return _targets(spark, folder).select(*fl.TARGET_KEYS, *r6("src_ip_entropy"))


@query
def a8_target_rate(spark, folder):
    return _targets(spark, folder).select(*fl.TARGET_KEYS, F.round("target_pkt_rate", 9).alias("target_pkt_rate"))


@query
def a9_target_syn(spark, folder):
    return _targets(spark, folder).select(*fl.TARGET_KEYS, *r6("target_syn_fraction"))


@query
def a10_rates(spark, folder):
    span = DAY / 1e6
    return totals(spark, folder).select(*fl.FLOW_KEYS, F.round(F.col("n_packets") / span, 9).alias("pkt_rate"),
                                        F.round(F.col("total_bytes") / span, 9).alias("byte_rate"))


@query
def a11_syn(spark, folder):
    return totals(spark, folder).select(*fl.FLOW_KEYS, "syn_count", F.round(F.col("syn_count") / F.col("n_packets"), 6).alias("syn_fraction"))


@query
def a12_dns_entropy(spark, folder):
    return fl.dns_features(windowed(spark, folder)).select(*fl.FLOW_KEYS, *r6("dns_ngram_entropy"))


@query
def a12_host_entropy(spark, folder):
    hosts = table(spark, folder, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/:?]+)", 1).alias("host"))
    text = F.lower(F.replace("host", F.lit("."), F.lit("")))
    return fl.token_entropy(hosts.withColumn("text", text), ["host"], fl.bigrams(F.col("text")), "ngram").select(
        "host", *r6("ngram"))


@query
def a13_dns_label_length(spark, folder):
    return fl.dns_features(windowed(spark, folder)).select(*fl.FLOW_KEYS, *r6("dns_query_len"))


@query
def a14_modal_dns_type(spark, folder):
    return fl.modal_dns_type(windowed(spark, folder))


@query
def a15_first_packet(spark, folder):
    return totals(spark, folder).select(*fl.FLOW_KEYS, "first_frame", "first_ts_us", "ttl")


@query
def a16_class_shares(spark, folder):
    return dashboard.class_shares(surfaced(spark, folder)).select("threat_class", "n", F.round("share", 6).alias("share"))


@query
def a16_timeline(spark, folder):
    return dashboard.timeline(surfaced(spark, folder), buckets=10).select(F.unix_micros("minute").alias("minute_us"), "n")


@query
def a16_latest(spark, folder):
    return dashboard.latest_alerts(surfaced(spark, folder), 500, "ts_us").select("flow_id", "capture_id", "ts_us", "threat_class")


@query
def a17_run_counters(spark, folder):
    return dashboard.run_counters(fused(spark, folder))


@query
def a18_label_counts(spark, folder):
    rows = doc_marks(spark, folder).select(F.col("lang").alias("partition"), F.col("truth").alias("label"))
    return evaluate.label_counts(rows, "label", "partition")


@query
def a19_load_report(spark, folder):
    seen = labelled.read_labelled_csv(spark, _labelled_csv(spark, folder), "cicids2017")
    return labelled.load_report(seen).agg(F.sum("rows").alias("rows"), F.sum("ok").alias("ok"), F.sum("unmatched").alias("unmatched"))


@query
def a19_layouts(spark, folder):
    """Rows, kept, unmatched and invalid rows of files of three layouts; the third has no label column."""
    path = fresh_folder(spark)
    layouts = [["Destination Port", "Label"], ["Label", "Remark"], ["Destination Port", "Remark"]]
    rows = table(spark, folder, "events").select(
        F.pmod("event_id", F.lit(3)).alias("layout"), F.col("user_id").alias("Destination Port"), F.lit("x").alias("Remark"),
        _label_text("BENIGN", "DDoS", "PortScan", "Bot", "Infiltration").alias("Label"))
    for k, columns in enumerate(layouts):
        rows.filter(F.col("layout") == k).select(*columns).write.option("header", True).csv(f"{path}/layout{k}")
    report = labelled.load_report(
        labelled.read_labelled_csv(spark, path, "cicids2017"), labelled.unlabelled_files(spark, path))
    return report.groupBy(F.regexp_extract("path", "layout([0-9])", 1).alias("layout")).agg(
        *[F.sum(n).alias(n) for n in ("rows", "ok", "unmatched", "invalid")], F.max("unlabelled").alias("unlabelled"))


# ---- across windows ----

@query
def w1_beacon_interval(spark, folder):
    found = state.beacon_intervals(fl.sightings(kept(spark, folder)), lookback_us=10 * DAY, keep=8)
    return found.withColumns({"beacon_mean": F.col("beacon_interval_stats.mean"), "beacon_std": F.col("beacon_interval_stats.std")}).select(
        *state.PAIR, "bucket", *r6s("beacon_mean", "beacon_std", digits=3))


@query
def w2_horizon_fanout(spark, folder):
    return state.horizon_fanout(fl.sightings(kept(spark, folder)), horizon_us=7 * DAY)


@query
def w3_carried_ja4(spark, folder):
    return state.carried_ja4(fl.sightings(kept(spark, folder)), horizon_us=3 * DAY)


def _arrival():
    """An arrival order that turns each 64 frames around."""
    f = F.pmod("frame_no", F.lit(1_000_000_000))
    return (f - F.pmod(f, F.lit(64)) + 63 - F.pmod(f, F.lit(64))) * 2 + (F.col("frame_no") >= 1_000_000_000).cast("int")


def _arrived(spark, folder):
    """Packets with their fate; every eleventh has no TTL, so flows that begin with one break the record schema."""
    sent = packets(spark, folder).withColumn("arrival", _arrival()).withColumn(
        "ttl", F.when(F.pmod("frame_no", F.lit(11)) != 0, F.col("ttl")))
    return fl.arrivals(sent, window_us=DAY, cap=60, order="arrival")


@query
def w4_flows_without_late(spark, folder):
    found = fl.build_flows(
        _arrived(spark, folder), window_us=DAY, horizon_us=7 * DAY, beacon_lookback_us=30 * DAY, protected=PROTECTED)
    return found.select(
        "capture_id", "bucket", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "first_frame", "ts_us", "syn_count", "ttl",
        F.round(F.col("pkt_rate") * (DAY / 1e6)).cast("bigint").alias("packets"),
        F.round(F.col("byte_rate") * (DAY / 1e6)).cast("bigint").alias("bytes"))


@query
def a17_packet_counters(spark, folder):
    """Packets by fate and flows by validity of each capture, all from one marked table."""
    arrived = _arrived(spark, folder)
    found = fl.build_flows(arrived, window_us=DAY, horizon_us=7 * DAY, beacon_lookback_us=30 * DAY, protected=PROTECTED)
    return dashboard.packet_counters(arrived, "capture_id").join(dashboard.flow_counters(found, "capture_id"), "capture_id", "left")


@query
def w4_late_packets(spark, folder):
    arrived = packets(spark, folder).select("capture_id", int_div(F.col("ts_us"), 3_600_000_000).alias("bucket"), _arrival().alias("arrival"))
    return state.mark_late(arrived, order="arrival").groupBy("capture_id", "bucket").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_late").alias("late"))


@query
def w5_packet_cap(spark, folder):
    marked = state.mark_over_cap(windowed(spark, folder).select("capture_id", "bucket", "frame_no"), 40)
    return marked.groupBy("capture_id", "bucket").agg(
        F.count_if(~F.col("over_cap")).alias("kept"), F.count_if("over_cap").alias("dropped"))


# ---- joins ----

@query
def j1_reverse_flow(spark, folder):
    return kept(spark, folder).select(*fl.FLOW_KEYS, "total_bytes", "reverse_bytes")


@query
def j2_flow_context(spark, folder):
    t = totals(spark, folder)
    return kept(spark, folder).join(fl.window_fanout(t), fl.SOURCE_KEYS, "left").join(
        fl.target_profile(t, DAY), fl.TARGET_KEYS, "left").select(
        *fl.FLOW_KEYS, "window_fanout", F.round("target_pkt_rate", 9).alias("target_pkt_rate"))


@query
def j3_ioc_flows(spark, folder):
    return totals(spark, folder).filter(tls.is_malicious(F.col("own_ja4"))).select(*fl.FLOW_KEYS, "own_ja4")


@query
def j4_label_join(spark, folder):
    rows = table(spark, folder, "events").select(
        _label_text("benign", "dga", "Scanning", "Tunneling ", "syn").alias("raw"),
        F.element_at(F.array(*[F.lit(d) for d in ("dns", "iot23", "cicddos2019")]), (F.pmod("user_id", F.lit(3)) + 1).cast("int")).alias("dataset"))
    return map_labels(rows, "raw", "dataset").groupBy("raw", "dataset", "threat_class").agg(F.count(F.lit(1)).alias("n"))


@query
def j5_layer_zip(spark, folder):
    s = scored(spark, folder)
    long = s.select("capture_id", F.col("flow_id").alias("id"), F.explode(F.array("rules", "stats", "isoforest", "xgb")).alias("s")).select(
        "capture_id", F.col("id"), *[F.col(f"s.{n}").alias(n) for n in (
            "layer_name", "raw_score", "calibrated_probability", "threat_class_guess", "evidence")])
    both = fusion.layers_from_long(long, keys=("capture_id", "id"))
    return both.select(
        F.col("id").alias("flow_id"), "capture_id", F.size("scores").alias("layers"),
        F.round(F.aggregate("scores", F.lit(0.0), lambda a, x: a + x["calibrated_probability"]), 6).alias("total"))


@query
def j6_partition_leaks(spark, folder):
    rows = table(spark, folder, "documents").select(
        F.concat(F.lit("p"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("partition"),
        F.col("source").alias("group"), F.sha2("text", 256).alias("source_sha256"))
    return evaluate.partition_leaks(rows)


@query
def j7_bin_join(spark, folder):
    ref, cur = score_halves(spark, folder)
    lo, hi, _ = drift._range(ref, "score")
    one = ref.groupBy(drift.bin_number(F.col("score"), lo, hi, 10).alias("bin")).agg(F.count(F.lit(1)).alias("b"))
    two = cur.groupBy(drift.bin_number(F.col("score"), lo, hi, 10).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    return one.join(two, "bin", "full").na.fill(0, ["b", "c"])


# ---- detection layers ----

@query
def d1_rules(spark, folder):
    return rules_layer(flows(spark, folder), LIMITS).select(
        "flow_id", "capture_id", F.round("rules.raw_score", 6).alias("raw_score"),
        F.round("rules.calibrated_probability", 6).alias("probability"), F.col("rules.threat_class_guess").alias("threat_class"))


@query
def d2_baseline(spark, folder):
    t = baseline_table(flows(spark, folder).filter("dst_port = 80"))
    names = ["inter_arrival_mean", "packet_size_mean", "entropy", "byte_ratio", "ttl", "fanout_count"]
    return t.select(*[F.round(f"{n}_{kind}", 6).alias(f"{short}{i}") for i, n in enumerate(names, 1)
                      for kind, short in (("mean", "m"), ("std", "s"))])


@query
def d3_zscore(spark, folder):
    return scored(spark, folder).select("flow_id", "capture_id", F.round("stats.raw_score", 6).alias("raw_score"),
                                        F.round("stats.calibrated_probability", 6).alias("probability"))


@query
def d4_forest_fit(spark, folder):
    f = staged(flows(spark, folder).filter("dst_port = 80"))
    forest = fit_forest(f, trees=100)
    # The offset is the 5 % quantile of the training scores: that share is more anomalous.
    return forest_layer(f, forest).agg(
        F.count(F.lit(1)).alias("n"), F.lit(len(forest.feature)).alias("trees"),
        (F.abs(F.count_if(F.col("isoforest.raw_score") > 0.5) - 0.05 * F.count(F.lit(1))) <= 1).alias("share_below_offset"))


@query
def d5_forest_score(spark, folder):
    """A forest of two given trees: what it does with a flow can be written down."""
    at = FEATURE_NAMES.index
    wide = np.ones(WIDTH[1])
    forest = Forest(
        np.array([[at("entropy")], [at("pkt_size_mean")]]), np.array([[4.0], [100.0]]), np.array([[1.0, 2.0], [1.5, 3.0]]),
        wide * 0, wide, norm=2.0, offset=-0.5, spread=0.4, midpoint=0.6)
    scored_flows = forest_layer(flows(spark, folder), forest).withColumns(
        {"raw": F.col("isoforest.raw_score"), "p": F.col("isoforest.calibrated_probability")})
    return scored_flows.select("flow_id", "capture_id", *r6("raw", "p"))


@query
def d6_classifier_fit(spark, folder):
    """Rows of each class, and whether the fitted model finds them more often than the class is frequent."""
    f = labelled_flows(spark, folder)
    n_all = f.count()
    marked = classifier_layer(f, fit_classifier(f, trees=20)).select(
        F.col("label").alias("class"), F.coalesce("xgb.threat_class_guess", F.lit(BENIGN)).alias("said"))
    return marked.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("class") == F.col("said")).cast("double")) > F.count(F.lit(1)) / n_all).alias("learned"))


@query
def d6_boosted_fit(spark, folder):
    """The first round of boosted trees of depth one on order lines: the cut of each class and its leaves."""
    names = ["l_quantity", "l_discount", "l_tax"]
    rows = table(spark, folder, "lineitem").select(
        F.array(*[F.col(c).cast("double") for c in names]).alias("features"), F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.struct("l_orderkey", "l_linenumber").alias("row_key"))
    classes = sorted(r["label"] for r in rows.select("label").distinct().collect())
    model = boosting.fit_boosted(rows, classes, boosting.Settings(rounds=1, depth=1, rows=1.0, columns=1.0))
    said = [(c, names[t.feature[0]], float(model.cuts[t.feature[0]][t.cut[0]]), float(t.value[1]), float(t.value[2]))
            for c, t in zip(classes, model.rounds[0]) if t.feature[0] >= 0]
    return spark.createDataFrame(said, "class string, feature string, cut double, left double, right double").select(
        "class", "feature", F.round("cut", 6).alias("cut"), F.round("left", 4).alias("left"), F.round("right", 4).alias("right"))


@query
def d6_boosted_layer(spark, folder):
    """Rows of each class, and whether boosted trees find them more often than the class is frequent."""
    f = staged(labelled_flows(spark, folder))
    n_all = f.count()
    model = boosting.fit_boosted_flows(f, settings=boosting.Settings(rounds=4, depth=5, rate=0.4))
    marked = boosting.boosted_layer(f, model).select(
        F.col("label").alias("class"), F.coalesce("boosted.threat_class_guess", F.lit(BENIGN)).alias("said"))
    return marked.groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), (F.avg((F.col("class") == F.col("said")).cast("double")) > F.count(F.lit(1)) / n_all).alias("learned"))


@query
def d7_classifier_predict(spark, folder):
    """The layer from given class probabilities."""
    f = flows(spark, folder)
    benign = F.pmod(F.col("bucket") * 7 + F.col("src_port") + F.col("dst_port"), F.lit(10)) / 10.0
    first = (1 - benign) * F.when(F.pmod("dst_port", F.lit(2)) == 0, 0.75).otherwise(0.25)
    chances = F.array(benign, first, 1 - benign - first)
    told = probability_layer(f, chances, [BENIGN, "volumetric_ddos", "c2_beaconing"]).withColumns(
        {"raw": F.col("xgb.raw_score"), "guess": F.col("xgb.threat_class_guess")})
    return told.select("flow_id", "capture_id", "guess", *r6("raw"))


def fitted(spark, folder):
    f = labelled_flows(spark, folder)
    return f, plans.fit_models(f, limits=LIMITS, trees=20)


@query
def d8_all_layers(spark, folder):
    f, models = fitted(spark, folder)
    unit = lambda n: F.col(f"{n}.raw_score").between(0, 1) & F.col(f"{n}.calibrated_probability").between(0, 1)
    return plans.score_layers(f, models).withColumn("rules_raw", F.col("rules.raw_score")).select(
        "flow_id", "capture_id", *r6("rules_raw"), *[unit(n).alias(f"{n}_in_range") for n in ("stats", "isoforest", "xgb")])


# ---- fusion, gate, calibration ----

@query
def f1_consensus(spark, folder):
    named = F.exists(F.array("rules", "stats", "isoforest", "xgb"), lambda s: s["threat_class_guess"].isNotNull())
    return fused(spark, folder).filter(named).select("flow_id", "capture_id", "threat_class", "corroborating_layers")


@query
def f2_corroboration(spark, folder):
    helped = F.exists("evidence", lambda e: e.contains("_corroborates="))
    return fused(spark, folder).filter(helped).select("flow_id", "capture_id", "corroborating_layers")


@query
def f3_anomaly_route(spark, folder):
    return fused(spark, folder).filter("is_anomaly_route").select(
        "flow_id", "capture_id", "threat_class", F.col("corroborating_layers").alias("layers"))


@query
def f4_confidence(spark, folder):
    return fused(spark, folder).select("flow_id", "capture_id", F.round("confidence_score", 6).alias("confidence_score"), "tier")


@query
def f5_gate(spark, folder):
    return surfaced(spark, folder).select("flow_id", "capture_id", "threat_class", "tier")


@query
def f6_calibration_fit(spark, folder):
    """Rows, right ones, and whether the penalised loss is at its minimum: every mean gradient is near 0."""
    f = staged(with_labels(fused(spark, folder)))
    right = F.col("threat_class") == F.col("label")
    made = fit_calibration(f, right)
    odds = F.lit(made.intercept)
    for weight, column in zip(made.coefficients, calibration_inputs()):
        odds = odds + column * F.lit(weight)
    off = 1 / (1 + F.exp(-odds)) - right.cast("double")
    slopes = [F.avg(off * x) + w / made.rows for w, x in zip(made.coefficients, calibration_inputs())]
    return f.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("n_right"),
        (F.greatest(F.abs(F.avg(off)), *[F.abs(s) for s in slopes]) < 1e-4).alias("at_minimum"))


@query
def f7_calibration_apply(spark, folder):
    made = Calibration((1.5, -0.5, 0.25, 0.75, -1.0), 0.125, 100)
    return apply_calibration(fused(spark, folder), made).select("flow_id", "capture_id", *r6("confidence_score"))


@query
def f8_benign_consensus(spark, folder):
    eased = fused(spark, folder).withColumn("isoforest", F.col("isoforest").withField(
        "raw_score", F.when(F.col("isoforest.raw_score") <= 0.99, 0.0).otherwise(1.0)))
    return fusion.benign_consensus(eased, min_benign=0.5, max_raw=0.5).select("flow_id", "capture_id")


# ---- alert chain ----

def chained(spark, folder) -> DataFrame:
    found = surfaced(spark, folder).select(
        F.col("capture_id").alias("chain_id"), "first_frame", "timestamp", "flow_id", "threat_class", "confidence_score", "evidence")
    placed = rank_rows(found, ["chain_id"], "first_frame", "position").withColumn("position", F.col("position") - 1)
    return staged(chain.append_chain(chain.canonical_alerts(staged(placed)).drop("first_frame")))


@query
def ch1_chain_verify(spark, folder):
    forged = chained(spark, folder).withColumn("confidence_score", F.when(F.col("position") == 5, "0.000000000001").otherwise(F.col("confidence_score")))
    return chain.verify_chains(forged)


@query
def ch2_chain_append(spark, folder):
    made = chained(spark, folder)
    ends = made.groupBy("chain_id").agg(F.max("seq").alias("last_seq"), F.min_by("prev_hash", "seq").alias("genesis"))
    return chain.verify_chains(made).drop("first_break").join(ends, "chain_id")


def sensor_alerts(spark, folder):
    """Each event as an alert of one of four sensors."""
    rows = table(spark, folder, "events").select(
        F.pmod("user_id", F.lit(4)).cast("string").alias("chain_id"), "event_id", epoch_us(F.col("ts")).cast("string").alias("timestamp"),
        F.col("event_id").cast("string").alias("flow_id"), F.col("event_type").alias("threat_class"),
        F.round(F.col("value") * 100).cast("bigint").cast("string").alias("confidence_score"), F.array("event_type", "props").alias("evidence"))
    return rank_rows(rows, ["chain_id"], "event_id", "nth").withColumn("position", F.col("nth") - 1).drop("nth", "event_id")


@query
def ch2_segmented_chain(spark, folder):
    """Heads and links of chains folded in segments of 250 entries."""
    made = chain.append_segmented(sensor_alerts(spark, folder), 250)
    return chain.segment_links(chain.segment_heads(made))


@query
def ch1_segmented_verify(spark, folder):
    """Segmented chains after one entry is forged and one segment's last entry is cut off."""
    made = staged(chain.append_segmented(sensor_alerts(spark, folder), 250))
    links = staged(chain.segment_links(chain.segment_heads(made)))
    forged = made.withColumn("confidence_score", F.when((F.col("chain_id") == "1") & (F.col("position") == 300), "0").otherwise(F.col("confidence_score")))
    cut = forged.filter(~((F.col("chain_id") == "2") & (F.col("position") == 249)))
    return chain.verify_segmented(cut, links)


@query
def ch3_retention(spark, folder):
    return chain.retained(chained(spark, folder), 25).groupBy("chain_id").agg(
        F.count(F.lit(1)).alias("kept"), F.min("seq").alias("oldest_seq"))


# ---- drift ----

@query
def dr1_psi(spark, folder):
    return drift.psi(*score_halves(spark, folder)).select(F.round("psi", 6).alias("psi"))


@query
def dr2_ks(spark, folder):
    return drift.ks(*score_halves(spark, folder)).select(F.round("ks", 6).alias("ks"))


@query
def dr3_rolling_drift(spark, folder):
    ref, _ = score_halves(spark, folder)
    rows = table(spark, folder, "events").select(
        "event_type", "event_id", int_div(epoch_us(F.col("ts")), DAY).alias("day"), F.col("value").alias("score"))
    found = drift.rolling_drift(rows, ref, key="event_type", order="event_id", batch="day", window=200)
    apart = drift.rolling_ks(rows, ref, key="event_type", order="event_id", batch="day", window=200)
    return found.join(apart, ["event_type", "day"]).select(
        "event_type", "day", "n", F.round("psi", 6).alias("psi"), F.round("ks", 6).alias("ks"), "drifted")


@query
def dr4_fixed_reference(spark, folder):
    ref, cur = score_halves(spark, folder)
    path = fresh_folder(spark)
    drift.write_reference_once(ref, path)
    drift.write_reference_once(cur, path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 3).alias("total"))


@query
def dr5_candidate_pool(spark, folder):
    return drift.newest(table(spark, folder, "events").select("event_id", "value"), "event_id", 5000)


@query
def dr6_bounded_retrain(spark, folder):
    f = labelled_flows(spark, folder).filter(F.col("label") == BENIGN)
    reference = f.filter("bucket % 2 = 0")
    served = fit_forest(reference, trees=50)
    scores = forest_layer(reference, served).select(F.col("isoforest.raw_score").alias("score"))
    pool = f.filter("bucket % 2 = 1")
    result, model = drift.bounded_retrain(pool, reference, scores, trees=50)
    told = result["accepted"] == (model is not None) == (result["reason"] == "accepted")
    again, _ = drift.bounded_retrain(pool.repartition(3), reference, scores, trees=50)
    return pool.agg(
        F.count(F.lit(1)).alias("candidates"), F.lit(told).alias("consistent"),
        F.lit(abs(again["psi"] - result["psi"]) < 1e-6).alias("repeats"))


# ---- evaluation ----

@query
def e1_confusion(spark, folder):
    return evaluate.confusion(doc_marks(spark, folder))


@query
def e1_confusion_matrix(spark, folder):
    return evaluate.confusion_matrix(doc_marks(spark, folder))


@query
def e2_class_metrics(spark, folder):
    return evaluate.class_metrics(doc_marks(spark, folder)).select(
        "class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query
def e3_macro(spark, folder):
    return evaluate.macro_metrics(doc_marks(spark, folder)).select(
        *[F.round(c, 6).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "accuracy")], "n")


@query
def e4_benign_brier(spark, folder):
    d = doc_marks(spark, folder)
    one = evaluate.benign_false_positives(d).withColumn("_one", F.lit(1))
    two = evaluate.brier(d, F.col("truth") == F.col("predicted"), F.col("confidence")).withColumn("_one", F.lit(1))
    return one.join(two, "_one").select(F.round("benign_false_positive_rate", 6).alias("fpr"), F.round("brier", 6).alias("brier"))


@query
def e4_unvalidated(spark, folder):
    return evaluate.unvalidated_classes(doc_marks(spark, folder))


@query
def e5_folds(spark, folder):
    return evaluate.stratified_folds(doc_marks(spark, folder), "truth", "doc_id").groupBy("truth", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query
def e5_cross_validation(spark, folder):
    """Classes with rows in every fold, and whether the summary of their F1 is in order."""
    f = labelled_flows(spark, folder)
    summary = evaluate.fold_summary(plans.cross_validate(f, "first_frame", trees=10))
    counts = f.groupBy(F.col("label").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return summary.join(counts, "class").select(
        "class", "n", ((F.col("min") >= 0) & (F.col("min") <= F.col("mean")) & (F.col("mean") <= F.col("max")) & (F.col("max") <= 1)).alias("in_order"),
        F.col("mean").isNotNull().alias("learned"))


@query
def e6_distinct_ratio(spark, folder):
    return evaluate.distinct_ratio(table(spark, folder, "lineitem"), ["l_quantity", "l_discount", "l_tax"]).withColumn(
        "ratio", F.round("ratio", 6))


@query
def e7_binary_anomaly(spark, folder):
    f = labelled_flows(spark, folder)
    layer = forest_layer(f, fit_forest(f.filter(F.col("label") == BENIGN), trees=50))
    return in_range(evaluate.class_metrics(plans.binary_anomaly(layer), [BENIGN, "anomalous"]))


@query
def e8_external_evaluation(spark, folder):
    """Rows of an outside CSV source, judged by a model of this engine's flows."""
    model = fit_classifier(labelled_flows(spark, folder), trees=10)
    outside = labelled.read_lenient_csv(spark, lenient_csv(spark, folder)).filter(F.col("label").isNotNull())
    marked = classifier_layer(outside, model).select(
        F.col("label").alias("truth"), F.coalesce("xgb.threat_class_guess", F.lit(BENIGN)).alias("predicted"))
    return in_range(evaluate.class_metrics(marked))


@query
def e9_scenarios(spark, folder):
    d = doc_marks(spark, folder).withColumnRenamed("truth", "scenario")
    return evaluate.scenario_report(d).withColumn("expected_label_fraction", F.round("expected_label_fraction", 6))


@query
def e10_candidate(spark, folder):
    f = labelled_flows(spark, folder).withColumns({
        "group": F.concat(F.lit("day"), F.col("bucket").cast("string")), "source_sha256": F.sha2(F.col("bucket").cast("string"), 256)})
    parts = [f.filter(F.pmod("bucket", F.lit(3)) == i) for i in range(3)]
    report, _ = plans.candidate_report(*parts, limits=LIMITS, trees=10)
    rows = [(c, m["precision"], m["recall"], m["f1"], m["support"]) for c, m in report["per_class"].items()]
    return in_range(spark.createDataFrame(rows, "class string, precision double, recall double, f1 double, support long"))


@query
def e11_percentiles(spark, folder):
    return timings.picked_percentiles(table(spark, folder, "events"), "value", [0.5, 0.95, 0.99, 1.0])


@query
def e11_latency_headroom(spark, folder):
    """Event values as milliseconds of scoring, against windows of a second."""
    found = timings.latency_report(table(spark, folder, "events"), "value", window_ms=1000.0)
    return found.select("p50_ms", "p95_ms", "p99_ms", F.round("headroom", 9).alias("headroom"))


@query
def e11_throughput(spark, folder):
    passes = table(spark, folder, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("flows"), (F.sum("value") / 1000).alias("seconds"))
    return timings.throughput_report(passes).select(*[F.round(c, 6).alias(c) for c in ("throughput", "throughput_std", "flows_per_window")])


@query
def e12_train_test(spark, folder):
    v = table(spark, folder, "embeddings").select("vec_id", F.col("label").alias("l"))
    threat = lambda cond: v.filter(cond).drop("l").withColumn("label", F.lit("recon_scanning"))
    made = sampling.train_test_table(v.filter("l < 4").drop("l"), threat("l between 4 and 6"), threat("l > 6"), "vec_id")
    return made.groupBy("part", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


# ---- whole records ----

@query
def flow_records(spark, folder):
    f = flows(spark, folder)
    flat = f.withColumns({
        **{f"size_{k}": F.col(f"packet_size_stats.{k}") for k in ("min", "max", "mean", "std")},
        "gap_mean": F.col("inter_arrival_stats.mean"), "gap_std": F.col("inter_arrival_stats.std"),
        "beacon_mean": F.col("beacon_interval_stats.mean"), "beacon_std": F.col("beacon_interval_stats.std")})
    return flat.select("flow_id", "capture_id", "ts_us", *r6(
        "size_min", "size_max", "size_mean", "size_std", "entropy", "byte_ratio", "dns_ngram_entropy", "pkt_rate", "byte_rate", "syn_fraction", "target_pkt_rate", "target_syn_fraction", "src_ip_entropy", "dns_query_len"),
        *r6s("gap_mean", "gap_std"), *r6s("beacon_mean", "beacon_std", digits=3), "ttl", "ja4", "fanout_count", "outbound_bytes", "inbound_bytes", "syn_count", "dns_record_type")


@query
def detect_summary(spark, folder):
    return fused(spark, folder).groupBy("threat_class", "tier", "is_actionable").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence_score"), 6).alias("confidence"))


# ---- streams: the files are read as a stream, available rows at once, into a table ----

@query
def t1_stream_windows(spark, folder):
    """Packets per capture and window, of the windows the stream's clock has passed."""
    schema = table(spark, folder, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    path = fresh_folder(spark)

    def keep(packets, batch_id, counts):
        packets.groupBy("capture_id", window_bucket(F.col("ts_us"), DAY).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).write.mode(
            "overwrite").parquet(f"{path}/rows/batch={batch_id}")

    windows.stream_closed_windows(packets_from_events(events), path, keep, window_us=DAY).awaitTermination()
    rows = spark.read.schema("capture_id string, bucket bigint, n bigint, batch bigint").parquet(f"{path}/rows")
    return rows.groupBy("capture_id", "bucket").agg(F.sum("n").alias("n"))


SLICES = 3
STATE_PARTITIONS = 8


def in_slices(spark, folder, start: Callable[[DataFrame], object], slice_no, *, closer: bool = True) -> None:
    """Run a stream of packets as SLICES micro-batches of data: each slice is written, then the stream goes on to it.

    The closer is a packet of a capture of its own, far ahead, that closes every window.
    """
    path = fresh_folder(spark)
    rows = packets(spark, folder).withColumn("is_syn", F.coalesce("is_syn", F.lit(False)))
    first, last = rows.agg(F.min("ts_us"), F.max("ts_us")).first()
    dealt = staged(rows.withColumn("slice", slice_no(first, last)))
    end = dealt.limit(1).withColumns({
        "capture_id": F.lit("end"), "ts_us": F.lit(last + 100 * DAY), "frame_no": F.lit(10**15), "slice": F.lit(SLICES - 1)})
    for k in range(SLICES):
        piece = dealt.filter(F.col("slice") == k)
        piece = piece.unionByName(end.select(*piece.columns)) if closer and k == SLICES - 1 else piece
        piece.drop("slice").write.mode("append").parquet(path)
        with keyed.state_settings(spark, STATE_PARTITIONS):
            query = start(spark.readStream.schema(PACKET_DDL).option("maxFilesPerTrigger", 100_000).parquet(path))
        query.awaitTermination()


def by_time(first: int, last: int):
    """Slices of equal length in time."""
    return F.least(F.lit(SLICES - 1), int_div((F.col("ts_us") - first) * SLICES, last - first + 1)).cast("int")


def appended(stream: DataFrame, path: str):
    return stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode(
        "append").trigger(availableNow=True).start()


@query
def t2_beacon_state(spark, folder):
    """Beacon intervals from keyed state, over several micro-batches."""
    path = fresh_folder(spark)
    in_slices(spark, folder, lambda p: appended(keyed.beacon_stream(
        keyed.arrival_stream(windows.stream_sightings(p, window_us=DAY)), lookback_us=10 * DAY, keep=8, window_us=DAY), path), by_time)
    return spark.read.parquet(f"{path}/rows").filter("capture_id <> 'end'").select(*state.PAIR, "bucket", *r6s("beacon_mean", "beacon_std", digits=3))


@query
def t2_fanout_state(spark, folder):
    """Horizon fan-out from two levels of keyed state, over several micro-batches."""
    path = fresh_folder(spark)
    in_slices(spark, folder, lambda p: keyed.stream_fanout(
        windows.stream_sightings(p, window_us=DAY), path, horizon_us=7 * DAY, window_us=DAY, parts=4), by_time)
    return spark.read.parquet(f"{path}/fanout").filter("capture_id <> 'end'").drop("batch")


@query
def t2_fingerprint_state(spark, folder):
    """Carried fingerprints from keyed state, over several micro-batches."""
    path = fresh_folder(spark)
    in_slices(spark, folder, lambda p: appended(keyed.endpoint_fingerprint_stream(
        windows.stream_totals(p, window_us=DAY), horizon_us=3 * DAY, window_us=DAY), path), by_time)
    return spark.read.parquet(f"{path}/rows").filter("capture_id <> 'end'")


@query
def t3_state_bounds(spark, folder):
    """Three targets a source at most: what is held, and what is evicted for it."""
    path = fresh_folder(spark)
    in_slices(spark, folder, lambda p: appended(keyed.bounded_fanout_stream(
        windows.stream_sightings(p, window_us=DAY), 3, horizon_us=7 * DAY, window_us=DAY), path), by_time)
    return spark.read.parquet(f"{path}/rows").filter("capture_id <> 'end'").groupBy("capture_id", "src_ip").agg(
        F.count(F.lit(1)).alias("sightings"), F.sum("held").alias("held"), F.max("held").alias("most_held"), F.count("evicted").alias("evictions"))


@query
def t4_late_data(spark, folder):
    """Packets of closed windows and late packets, each capture by its own clock; every 20th event comes a slice late."""
    path = fresh_folder(spark)
    event = F.pmod("frame_no", F.lit(1_000_000_000))

    def delayed(first, last):
        return F.least(F.lit(SLICES - 1), by_time(first, last) + F.when(F.pmod(event, F.lit(20)) == 0, 1).otherwise(0))

    def keep(packets_, batch_id, counts):
        packets_.groupBy("capture_id", window_bucket(F.col("ts_us"), DAY).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).write.mode(
            "overwrite").parquet(f"{path}/rows/batch={batch_id}")
        spark.createDataFrame([(batch_id, counts["late_packets"])], "batch bigint, late bigint").write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")

    in_slices(spark, folder, lambda p: windows.stream_closed_windows(p, path, keep, window_us=DAY, clock="capture"), delayed, closer=False)
    closed = spark.read.schema("capture_id string, bucket bigint, n bigint, batch bigint").parquet(f"{path}/rows").groupBy("capture_id", "bucket").agg(
        F.sum("n").alias("n"))
    late = spark.read.schema("late bigint").parquet(f"{path}/late").agg(F.sum("late").alias("n"))
    return closed.unionByName(late.select(F.lit("late").alias("capture_id"), F.lit(None).cast("bigint").alias("bucket"), "n"))


@query
def t5_stream_alerts(spark, folder):
    """Flow records scored, gated and appended as a stream."""
    path = fresh_folder(spark)
    ready = scored(spark, folder)
    ready.write.parquet(path)
    out = fresh_folder(spark)
    live_flows = spark.readStream.schema(ready.schema).parquet(path)
    detection.stream_scores(live_flows, fusion.fuse, f"{out}/alerts", f"{out}/checkpoint").awaitTermination()
    alerts = spark.read.schema("flow_id string, threat_class string, confidence_score double").json(f"{out}/alerts")
    return alerts.select("flow_id", "threat_class", *r6("confidence_score"))
