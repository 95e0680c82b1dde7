"""Small packet tables for exact-value tests."""

from flowsift.schemas import PACKET_DDL


def packet(frame, ts, src="10.0.0.1", sport=40000, dst="192.0.2.1", dport=443, proto="TCP", size=100, ttl=64,
           payload="", names=(), kind=None, syn=False, ja4=None, capture="c"):
    return (capture, frame, int(round(ts * 1_000_000)), src, sport, dst, dport, proto, size, ttl, payload, list(names),
            kind, syn, ja4)


def packets(spark, rows):
    return spark.createDataFrame(rows, PACKET_DDL)


def by_flow(df):
    return [r.asDict(recursive=True) for r in df.orderBy("ts_us", "src_ip", "src_port", "dst_port").collect()]
