"""Packet JSON, flow records, labelled files, labels, addresses and fingerprints."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from flowsift.functions import ja4 as tls
from flowsift.functions.labels import exact_label, substring_label
from flowsift.functions.net import in_networks, is_pure_syn
from flowsift.sources import files, flow_json, labelled, packet_json


def layers(**parts):
    return json.dumps({"_source": {"layers": parts}})


PACKETS = [
    layers(frame={"frame.number": "1", "frame.len": "74", "frame.time_epoch": "12.010500"}, ip={"ip.src": "10.0.0.1", "ip.dst": "10.0.0.2", "ip.ttl": "63"},
           tcp={"tcp.srcport": "5", "tcp.dstport": "443", "tcp.flags": "0x00000002", "tcp.payload": "ab:cd"}),
    layers(frame={"frame.number": "2", "frame_len": "x", "frame.time_epoch": "12.02"}, ip={"ip_src": "10.0.0.1", "ip.proto": "1"}),
    layers(frame={"frame.number": "3", "frame.time": "1970-01-01T00:00:12.5Z"}, ip={}, udp={"udp.srcport": "9", "udp.dstport": "53"},
           dns={"Queries": {"a: type TXT": {"dns.qry.name": "a.example.test", "dns.qry.type": "16"}}}, data={"data.data": "00ff"}),
    layers(frame={"frame.number": "4"}, ip={}, tcp={"tcp.flags_tree": {"tcp.flags.syn": "1", "tcp.flags.ack": "0"}},
           dns={"dns.qry.name": ["x.test", "y.test"], "dns.qry.type": ["28", "1"]}),
    layers(frame={"frame.number": "5"}, ip={}, tcp={"tcp.srcport": "1", "tcp.dstport": "2"}, tls={"tls.record": {"tls.handshake": {
        "tls.handshake.type": "1", "tls.handshake.version": "0x0303", "tls.handshake.ciphersuite": ["0x1301", "0x0a0a", "0xc02f"],
        "tls.handshake.extension.type": ["0", "16", "43"], "tls.handshake.extensions_server_name": "example.test",
        "tls.handshake.extensions_alpn_str": "h2", "tls.handshake.extensions.supported_version": ["0x0304"],
        "tls.handshake.sig_hash_alg": ["0x0403"]}}}),
]


@pytest.mark.parametrize("array", [False, True])
def test_packet_json(spark, tmp_path, array):
    path = tmp_path / "p.json"
    path.write_text("[" + ",\n".join(PACKETS) + "]" if array else "\n".join(PACKETS))
    rows = {r.frame_no: r for r in packet_json.read_packets(spark, str(path), array_files=array).collect()}
    one, two, three, four, five = (rows[i] for i in range(1, 6))
    assert (one.ts_us, one.protocol, one.frame_len, one.ttl, one.is_syn, one.payload_hex) == (12_010_500, "TCP", 74, 63, True, "abcd")
    assert (two.src_ip, two.dst_ip, two.protocol, two.frame_len, two.ttl, two.src_port) == ("10.0.0.1", "0.0.0.0", "1", 0, 64, 0)
    assert (three.ts_us, three.dns_names, three.dns_type, three.payload_hex, three.dst_port) == (12_500_000, ["a.example.test"], "TXT", "00ff", 53)
    assert (four.is_syn, four.dns_names, four.dns_type) == (True, ["x.test", "y.test"], "AAAA")
    import hashlib
    b = hashlib.sha256(b"1301,c02f").hexdigest()[:12]
    c = hashlib.sha256(b"002b_0403").hexdigest()[:12]
    assert five.ja4 == f"t13d0203h2_{b}_{c}"
    assert one.ja4 is None


def test_syn_flags(spark):
    df = spark.createDataFrame([("0x0002",), ("0x0012",), ("2",), ("zz",), (None,)], "f string")
    assert [r[0] for r in df.select(is_pure_syn(F.col("f"))).collect()] == [True, False, True, False, False]


def test_networks(spark):
    df = spark.createDataFrame([("10.1.2.3",), ("11.0.0.1",), ("10.0.0.256",), ("2001:db8::5",), ("x",), (None,)], "ip string")
    got = [r[0] for r in df.select(in_networks(F.col("ip"), ["10.0.0.0/8", "2001:db8::/32"])).collect()]
    assert got == [True, False, False, True, False, False]
    assert not any(r[0] for r in df.select(in_networks(F.col("ip"), [])).collect())


def test_ja4_predicates(spark):
    df = spark.createDataFrame([("t13i050200_e133e205ac38_000000000000",), ("t13",), (None,)], "j string")
    got = df.select(tls.is_malicious(F.col("j")), tls.lacks_sni(F.col("j")), tls.lacks_alpn(F.col("j"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True), (False, False, False), (False, False, False)]


def good(**change):
    row = dict(flow_id="f", timestamp="2024-01-01T00:00:00", src_port=1, dst_port=2, protocol="TCP",
               packet_size_stats=dict(min=1.0, max=1.0, mean=1.0, std=0.0), inter_arrival_stats=dict(mean=0.1, std=0.0),
               entropy=1.0, byte_ratio=0.5, ttl=64)
    row.update(change)
    return json.dumps(row)


def test_flow_records_are_split(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text("\n".join([good(), good(syn_fraction=1.2), good(ttl=None), "{oops", "", good(outbound_bytes=-1), good(pkt_rate="fast")]))
    valid, rejected = flow_json.split_valid(flow_json.read_flow_lines(spark, str(path)))
    assert valid.count() == 1 and valid.first().pkt_rate == 0.0 and valid.first().outbound_bytes is None
    reasons = sorted(r.violations[0] for r in rejected.collect())
    assert reasons == ["malformed", "malformed", "outbound_bytes: below 0", "syn_fraction: above 1", "ttl: required"]


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in [" DDoS ", "Bot", "PortScan", "Heartbleed"]], "l string")
    assert [r[0] for r in df.select(exact_label(F.col("l"), "cicids2017")).collect()] == ["volumetric_ddos", "UNMATCHED", "recon_scanning", "UNMATCHED"]
    df = spark.createDataFrame([(x,) for x in ["BENIGN", "DoS Hulk", "Bot", "FTP-Patator", "Web Attack XSS", "DNS", "Port-Scan"]], "l string")
    assert [r[0] for r in df.select(substring_label(F.col("l"))).collect()] == [
        "benign", "volumetric_ddos", "c2_beaconing", None, "data_exfiltration", "dga_dns_tunneling", "recon_scanning"]


def test_labelled_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        " Destination Port, Protocol, Fwd IAT Mean, Bwd IAT Mean, Label\n 9999, 17, 100.0, 5, UDP\n 443, 6,, 5, Benign\n 1, 6, 1, 1, Odd\n")
    (tmp_path / "b.csv").write_text("query,qtype,label\nx.test,A,benign\n")
    seen = labelled.read_labelled_csv(spark, str(tmp_path), "cicddos2019", provenance=True)
    rows = sorted(labelled.matched(seen).collect(), key=lambda r: (r.path, r.row))
    assert [(r.label, r.row) for r in rows] == [("volumetric_ddos", 2), ("benign", 3), ("benign", 2)]
    assert rows[0].measurements == {"dst_port": "9999", "protocol": "17", "fwd_iat_mean": "100.0"}
    assert rows[1].measurements["fwd_iat_mean"] is None
    assert rows[0].raw_fields[" Bwd IAT Mean"] == "5" and len(rows[0].sha256) == 64
    report = {r.path.rsplit("/")[-1]: (r.rows, r.ok, r.unmatched) for r in labelled.load_report(seen).collect()}
    assert report == {"a.csv": (3, 2, 1), "b.csv": (1, 1, 0)}
    assert [tuple(r) for r in labelled.dropped_labels(seen).collect()] == [("Odd", 1)]


def test_zeek(spark, tmp_path):
    (tmp_path / "conn.log").write_text(
        "#separator x\n#fields\tts\tid.orig_h\tid.resp_p\tproto\tduration\torig_pkts\torig_bytes\tlabel\tdetailed-label\n"
        "1.0\t10.0.0.1\t80\ttcp\t1.5\t10\t1400\tMalicious\tC&C-HeartBeat\n2.0\t10.0.0.1\t443\ttcp\t0.5\t3\t200\tbenign\t-\n")
    rows = sorted(labelled.read_zeek(spark, str(tmp_path), provenance=True).collect(), key=lambda r: r.row)
    assert [(r.label, r.row) for r in rows] == [("c2_beaconing", 3), ("UNMATCHED", 4)]
    assert rows[0].measurements == {"dst_port": "80", "protocol": "tcp", "flow_duration": "1.5", "fwd_pkts": "10", "fwd_bytes": "1400"}


@pytest.mark.parametrize("direct", [files.DIRECT, ()])
def test_file_facts_are_read_in_tasks(spark, tmp_path, direct):
    folder = tmp_path / "with space"
    folder.mkdir()
    big = b"\xef" * (3 * files.PIECE + 17)
    content = {"a.csv": b"x,y\r\n1,2\n", "b %41.csv": b"\n\nlabel\n", "c.csv": b"only", "d.csv": big, "e.csv": b"", "f.log.gz": gzip.compress(b"#a\n#fields\tts\n1\n")}
    for name, raw in content.items():
        (folder / name).write_bytes(raw)
    found = files.listed(spark, str(folder), ".csv", ".log*")
    hashes = {r["load_path"].rsplit("/", 1)[1]: r["sha256"] for r in files.file_hashes(found, direct).collect()}
    assert hashes == {n: hashlib.sha256(raw).hexdigest() for n, raw in content.items() if raw}
    heads = {r["load_path"].rsplit("/", 1)[1]: r["header"] for r in files.header_lines(found, direct=direct).collect()}
    assert heads == {"a.csv": "x,y", "b %41.csv": "", "c.csv": "only", "d.csv": None, "f.log.gz": "#a"}
    marked = {r["load_path"].rsplit("/", 1)[1]: r["header"] for r in files.header_lines(found, "#fields", direct).collect()}
    assert marked == {**dict.fromkeys(heads), "f.log.gz": "#fields\tts"}
    assert len(files.names(spark, str(folder), ".csv")) == 5
    # The path is the one a scan gives its rows.
    rows = spark.read.text(str(folder / "a.csv")).select(F.col("_metadata.file_path").alias("path")).distinct()
    assert rows.join(found, "path").count() == 1


def test_iot23_folder_of_logs_and_csv(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    log = "#separator x\n#fields\tts\tid.resp_p\tproto\tlabel\tdetailed-label\n1.0\t80\ttcp\tMalicious\tC&C-HeartBeat\n2.0\t81\ttcp\tbenign\tbenign\n"
    (tmp_path / "sub" / "conn.log.labeled").write_text(log)
    (tmp_path / "x.csv").write_text("Destination Port,Label\n53,DDoS\n54,other\n")
    seen = labelled.read_iot23(spark, str(tmp_path), provenance=True)
    got = {(r["source"]["path"].rsplit("/", 1)[1], r["row"], r["measurements"]["dst_port"]): r for r in labelled.observation_records(seen).collect()}
    assert {("conn.log.labeled", 3, "80"), ("x.csv", 2, "53")} <= set(got)
    assert not any(k[2] == "54" for k in got)
    one = got["conn.log.labeled", 3, "80"]
    assert one["source"]["sha256"] == hashlib.sha256(log.encode()).hexdigest()
    assert (one["record_type"], one["model_ready"], one["missing_features"]) == ("external_observation", False, ["entropy", "byte_ratio", "ja4"])
    assert labelled.read_iot23(spark, str(tmp_path / "sub")).count() == 2


def test_lenient_folder_skips_and_reports_files_without_label(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Destination Port,Label\n80,BENIGN\n")
    (tmp_path / "b.csv").write_text("Destination Port,Protocol\n1,6\n")
    assert labelled.read_lenient_csv(spark, str(tmp_path)).count() == 1
    assert [r["path"].rsplit("/", 1)[1] for r in labelled.unlabelled_files(spark, str(tmp_path), lenient=True).collect()] == ["b.csv"]
    (tmp_path / "a.csv").unlink()
    with pytest.raises(ValueError, match="label column"):
        labelled.read_lenient_csv(spark, str(tmp_path))


def test_lenient_csv(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(
        " Destination Port,Flow Duration,Total Fwd Packets,Total Length of Fwd Packets,Fwd Packet Length Mean,Bwd Packet Length Mean,Fwd IAT Mean,Label\n"
        "80,3000000,4,400,100,9,0,DDoS\n443,Infinity,1,NaN,,9,5000000,BENIGN\n1,1,1,1,1,1,1,unknown thing\n")
    rows = labelled.read_lenient_csv(spark, str(path)).orderBy("row_index").collect()
    assert [r.label for r in rows] == ["volumetric_ddos", "benign", None]
    assert rows[0].inter_arrival_stats.mean == pytest.approx(1.0) and rows[0].byte_ratio == pytest.approx(1.0)
    assert rows[1].inter_arrival_stats.mean == pytest.approx(5.0) and rows[1].byte_ratio == 0.0 and rows[1].ttl == 64
    assert rows[0].flow_id == "ext_x_0" and rows[0].protocol == "TCP"
    assert labelled.read_lenient_csv(spark, str(path), limit=1).count() == 1
