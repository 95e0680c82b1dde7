"""Window, address and direction columns."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def int_div(value: Column, width: int) -> Column:
    """Floor division on integers, also right below zero."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width).cast("bigint"))


def window_bucket(ts_us: Column, window_us: int) -> Column:
    """Index of the fixed capture window a packet falls into."""
    if window_us <= 0:
        raise ValueError("window length must be positive")
    return int_div(ts_us, window_us)


def flow_id(src_ip, src_port, dst_ip, dst_port, protocol, bucket) -> Column:
    """Sixteen hex digits naming a 5-tuple within one window."""
    parts = [c.cast("string") for c in (src_ip, src_port, dst_ip, dst_port, protocol, bucket)]
    return F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16)


def is_pure_syn(flags: Column, syn: Column | None = None, ack: Column | None = None) -> Column:
    """TCP SYN without ACK, from a flags value read as hex, else from the two flag bits."""
    text = F.regexp_replace(flags, "^0[xX]", "")
    # Only the low bits are read, so the last eight digits of any number of them do.
    as_hex = F.when(text.rlike("^[0-9a-fA-F]+$"), F.conv(F.right(text, F.lit(8)), 16, 10).cast("bigint"))
    from_value = (as_hex.bitwiseAND(F.lit(0x02)) != 0) & (as_hex.bitwiseAND(F.lit(0x10)) == 0)
    from_value = F.coalesce(from_value, F.lit(False))
    if syn is None:
        return F.when(flags.isNull(), F.lit(False)).otherwise(from_value)
    bits = (syn == "1") & (F.coalesce(ack, F.lit("0")) == "0")
    return F.when(flags.isNull() | (flags == ""), F.coalesce(bits, F.lit(False))).otherwise(from_value)


def ipv4_number(ip: Column) -> Column:
    """IPv4 text to its 32-bit number; NULL for anything else."""
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    folded = F.aggregate(
        F.transform(F.split(ip, "[.]"), lambda x: x.try_cast("bigint")),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc * 256 + x,
    )
    return F.when(ip.rlike(rf"^{octet}([.]{octet}){{3}}$"), folded)


def in_networks(ip: Column, cidrs: Sequence[str]) -> Column:
    """Membership in any of the CIDR blocks. No blocks, or no valid address: false.

    IPv4 blocks become masked comparisons; IPv6 blocks are tested by an Arrow-batched function.
    """
    blocks = [ipaddress.ip_network(c, strict=False) for c in cidrs]
    number = ipv4_number(ip)
    hits = [
        number.bitwiseAND(F.lit(int(b.netmask))) == F.lit(int(b.network_address))
        for b in blocks if b.version == 4
    ]
    six = [b for b in blocks if b.version == 6]
    if six:
        @F.pandas_udf("boolean")
        def in_six(values: pd.Series) -> pd.Series:
            def test(text):
                try:
                    address = ipaddress.ip_address(text)
                except ValueError:
                    return False
                return any(address in b for b in six)
            known = {v: test(v) for v in values.dropna().unique()}
            return values.map(known).fillna(False).astype(bool)
        hits.append(F.when(ip.contains(":"), in_six(ip)).otherwise(F.lit(False)))
    result = F.lit(False)
    for hit in hits:
        result = result | F.coalesce(hit, F.lit(False))
    return result


def direction(src_protected: Column, dst_protected: Column) -> Column:
    return (
        F.when(src_protected & ~dst_protected, "outbound")
        .when(dst_protected & ~src_protected, "inbound")
        .otherwise("ambiguous")
    )
