"""Packet source: dissected-packet JSON to packet rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsift.constants import DNS_TYPES
from flowsift.functions.ja4 import ja4
from flowsift.functions.net import is_pure_syn

# Only the fields the engine uses are parsed; DNS and TLS subtrees stay JSON text.
RAW_SCHEMA = """_source struct<layers: struct<
  frame: struct<`frame.number`: string, `frame.len`: string, `frame_len`: string,
    `frame.time_epoch`: string, `frame_time_epoch`: string, `frame.time`: string>,
  ip: struct<`ip.src`: string, `ip_src`: string, `ip.dst`: string, `ip_dst`: string,
    `ip.proto`: string, `ip_proto`: string, `ip.ttl`: string, `ip_ttl`: string>,
  tcp: struct<`tcp.srcport`: string, `tcp_srcport`: string, `tcp.dstport`: string, `tcp_dstport`: string,
    `tcp.flags`: string, `tcp_flags`: string, `tcp.flags_tree`: string, `tcp.flags.syn`: string,
    `tcp.flags.ack`: string, `tcp.payload`: string>,
  udp: struct<`udp.srcport`: string, `udp_srcport`: string, `udp.dstport`: string, `udp_dstport`: string>,
  data: struct<`data.data`: string, `data_data`: string>,
  dns: string, tls: string>>"""


def read_packets(spark: SparkSession, path, capture_id: str | None = None, array_files: bool = False) -> DataFrame:
    """Packets of JSON-lines files, or of files holding one JSON array each.

    Line files split into many tasks; an array file is read by one task, as a stream of elements.
    Without a capture_id each file is its own capture.
    """
    raw = spark.read.schema(RAW_SCHEMA).option("multiLine", array_files).json(path)
    capture = F.lit(capture_id) if capture_id is not None else F.col("_metadata.file_path")
    return packets_from_json(raw.withColumn("capture_id", capture), F.monotonically_increasing_id())


def read_packet_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same rows from a directory that keeps receiving line files; frames carry their number."""
    raw = spark.readStream.schema(RAW_SCHEMA).options(**options).json(path)
    return packets_from_json(raw.withColumn("capture_id", F.lit("live")), F.lit(None).cast("bigint"))


def _field(layer: str, *names: str) -> Column:
    """First non-empty of several spellings of a field."""
    return F.coalesce(*[F.nullif(F.col(f"_source.layers.{layer}.`{n}`"), F.lit("")) for n in names])


def _whole(text: Column, default) -> Column:
    return F.coalesce(F.when(F.trim(text).rlike("^[+-]?[0-9]+$"), F.trim(text).try_cast("int")), F.lit(default))


def _json_texts(tree: Column, field: str) -> Column:
    """All text values of a field anywhere in a JSON text, in document order, empties left out."""
    name = field.replace(".", r"\.")
    spots = F.regexp_extract_all(tree, F.lit(rf'"{name}"\s*:\s*(\[[^\]]*\]|"[^"]*")'), F.lit(1))
    values = F.flatten(F.transform(spots, lambda s: F.regexp_extract_all(s, F.lit('"([^"]*)"'), F.lit(1))))
    return F.filter(values, lambda v: v != "")


def epoch_us(frame_number_text: Column, iso: Column) -> Column:
    number = frame_number_text.try_cast("decimal(30,9)")
    return F.coalesce(
        F.floor(number * 1_000_000).cast("bigint"), F.unix_micros(F.try_to_timestamp(iso)),
        F.unix_micros(F.try_to_timestamp(frame_number_text)), F.lit(0).cast("bigint"))


def dns_names(dns: Column) -> Column:
    return _first_value_list(dns, "dns.qry.name", "dns_qry_name")


def _first_value_list(tree: Column, field: str, other: str | None = None) -> Column:
    """Values of the first occurrence of a field: the tree's own key before nested ones."""
    def listed(text):
        return F.when(F.trim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    spelled = [F.get_json_object(tree, f"$['{n}']") for n in (field, other) if n]
    top = F.coalesce(*[F.nullif(s, F.lit("")) for s in spelled])
    name = field.replace(".", r"\.")
    nested = F.regexp_extract(tree, rf'"{name}"\s*:\s*(\[[^\]]*\]|"[^"]*")', 1)
    unquoted = F.when(nested.startswith('"'), F.substring(nested, F.lit(2), F.length(nested) - 2)).otherwise(nested)
    return F.when(tree.isNull(), F.array().cast("array<string>")).when(top.isNotNull(), listed(top)).when(
        unquoted != "", listed(unquoted)).otherwise(F.array().cast("array<string>"))


def dns_type(dns: Column) -> Column:
    """Name of the query type code; codes without a name stay as they are."""
    code = F.get(_first_value_list(dns, "dns.qry.type"), F.lit(0))
    names = F.create_map(*[F.lit(x) for kv in DNS_TYPES.items() for x in kv])
    return F.coalesce(F.element_at(names, code), code)


def client_ja4(tls: Column, protocol: Column) -> Column:
    """Fingerprint of a Client Hello; one the dissector computed itself wins."""
    hello = tls.rlike(r'"tls\.handshake\.type"\s*:\s*"1"')
    first = lambda field: F.get(_json_texts(tls, field), F.lit(0))
    made = ja4(
        protocol, first("tls.handshake.version"), _json_texts(tls, "tls.handshake.extensions.supported_version"),
        _json_texts(tls, "tls.handshake.ciphersuite"), _json_texts(tls, "tls.handshake.extension.type"),
        first("tls.handshake.extensions_alpn_str"), first("tls.handshake.extensions_server_name"),
        _json_texts(tls, "tls.handshake.sig_hash_alg"))
    return F.when(hello, F.coalesce(first("tls.handshake.ja4"), made))


def packets_from_json(raw: DataFrame, fallback_frame: Column) -> DataFrame:
    layer = lambda n: F.col(f"_source.layers.{n}")
    tcp, udp = layer("tcp").isNotNull(), layer("udp").isNotNull()
    protocol = F.when(tcp, "TCP").when(udp, "UDP").otherwise(F.coalesce(_field("ip", "ip.proto", "ip_proto"), F.lit("")))

    def port(end):
        return F.when(tcp, _whole(_field("tcp", f"tcp.{end}port", f"tcp_{end}port"), 0)).when(
            udp, _whole(_field("udp", f"udp.{end}port", f"udp_{end}port"), 0)).otherwise(F.lit(0))

    tree = F.col("_source.layers.tcp.`tcp.flags_tree`")
    syn = F.when(tree.isNotNull(), F.get_json_object(tree, "$['tcp.flags.syn']")).otherwise(
        F.col("_source.layers.tcp.`tcp.flags.syn`"))
    ack = F.when(tree.isNotNull(), F.get_json_object(tree, "$['tcp.flags.ack']")).otherwise(
        F.col("_source.layers.tcp.`tcp.flags.ack`"))
    payload = F.when(layer("data").isNotNull(), F.coalesce(_field("data", "data.data", "data_data"), F.lit(""))).otherwise(
        F.coalesce(F.replace(F.col("_source.layers.tcp.`tcp.payload`"), F.lit(":"), F.lit("")), F.lit("")))
    return raw.withColumn("_protocol", protocol).select(
        "capture_id",
        F.coalesce(_field("frame", "frame.number").try_cast("bigint"), fallback_frame).alias("frame_no"),
        epoch_us(_field("frame", "frame.time_epoch", "frame_time_epoch", "frame.time"), _field("frame", "frame.time")).alias("ts_us"),
        F.coalesce(_field("ip", "ip.src", "ip_src"), F.lit("0.0.0.0")).alias("src_ip"), port("src").alias("src_port"),
        F.coalesce(_field("ip", "ip.dst", "ip_dst"), F.lit("0.0.0.0")).alias("dst_ip"), port("dst").alias("dst_port"),
        F.col("_protocol").alias("protocol"),
        _whole(_field("frame", "frame.len", "frame_len"), 0).alias("frame_len"),
        _whole(_field("ip", "ip.ttl", "ip_ttl"), 64).alias("ttl"),
        payload.alias("payload_hex"),
        dns_names(layer("dns")).alias("dns_names"), dns_type(layer("dns")).alias("dns_type"),
        (tcp & is_pure_syn(_field("tcp", "tcp.flags", "tcp_flags"), syn, ack)).alias("is_syn"),
        client_ja4(layer("tls"), F.col("_protocol")).alias("ja4"))
