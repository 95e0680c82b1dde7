"""TLS client fingerprints as array expressions, and the tests made on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowsift.constants import MALICIOUS_JA4, TLS_VERSIONS

EMPTY_HASH = "0" * 12


def code_number(text: Column) -> Column:
    """A TLS code written as 0x-hex, decimal, or bare hex; NULL when it is none of these. Of longer numbers the low bits."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.rlike("^0x[0-9a-f]+$"), F.conv(F.right(F.substr(t, F.lit(3)), F.lit(15)), 16, 10).cast("bigint"))
        .when(t.rlike("^[+-]?[0-9]+$"), F.coalesce(
            t.try_cast("bigint"), F.pmod(t.try_cast("decimal(38,0)"), F.lit(1 << 60)).cast("bigint")))
        .when(t.rlike("^[0-9a-f]+$"), F.conv(F.right(t, F.lit(15)), 16, 10).cast("bigint"))
    )


def is_grease(code: Column) -> Column:
    same = F.shiftright(code, 8).bitwiseAND(F.lit(0xF0)) == code.bitwiseAND(F.lit(0xF0))
    return (code.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A) & same


def usable_codes(codes: Column) -> Column:
    """Numeric codes of an array<string>, unreadable and GREASE values left out."""
    numbers = F.transform(F.coalesce(codes, F.array().cast("array<string>")), code_number)
    return F.filter(numbers, lambda c: c.isNotNull() & ~is_grease(c))


def hex4(code: Column) -> Column:
    return F.lower(F.lpad(F.hex(code.bitwiseAND(F.lit(0xFFFF))), 4, "0"))


def _two_digits(n: Column) -> Column:
    return F.lpad(F.least(n, F.lit(99)).cast("string"), 2, "0")


def tls_version(record_version: Column, supported: Column) -> Column:
    offered = usable_codes(supported)
    best = None
    for code in sorted((c for c in TLS_VERSIONS if c >= 0x0300), reverse=True):
        hit = F.array_contains(offered, F.lit(code).cast("bigint"))
        best = F.when(hit, TLS_VERSIONS[code]) if best is None else best.when(hit, TLS_VERSIONS[code])
    named = F.element_at(
        F.create_map(*[F.lit(x) for c, v in TLS_VERSIONS.items() for x in (c, v)]),
        code_number(record_version).cast("int"))
    text = F.lower(record_version)
    spelled = (
        F.when(text.contains("1.3"), "13").when(text.contains("1.2"), "12")
        .when(text.contains("1.1"), "11").when(text.contains("1.0"), "10")
    )
    return F.coalesce(best, named, spelled, F.lit("00"))


def sni_flag(server_name: Column) -> Column:
    """'d' for a domain name, 'i' for a bare address or nothing."""
    name = F.trim(server_name)
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    v4 = name.rlike(rf"^{octet}([.]{octet}){{3}}$")
    v6 = name.rlike("^[0-9a-fA-F:.]*:[0-9a-fA-F:.]*:[0-9a-fA-F:.]*(%.+)?$")
    named = name.contains(".") | name.rlike(r"\p{L}")
    return F.when(name.isNull() | (name == "") | v4 | v6, "i").when(named, "d").otherwise("i")


def alpn_chars(alpn: Column) -> Column:
    first = F.trim(F.element_at(F.split(alpn, ","), 1))
    ends = F.concat(F.substring(first, 1, 1), F.substring(first, -1, 1))
    return F.when(first.isNull() | (first == ""), "00").otherwise(ends)


def ja4(protocol, record_version, supported_versions, ciphers, extensions, alpn, server_name,
        signature_algorithms) -> Column:
    """Fingerprint text a_b_c; list arguments are array<string> columns."""
    cipher_codes = usable_codes(ciphers)
    extension_codes = usable_codes(extensions)
    kept = F.filter(extension_codes, lambda c: ~c.isin(0, 16))
    signatures = F.transform(usable_codes(signature_algorithms), hex4)
    head = F.concat(
        F.when(F.upper(protocol).isin("UDP", "QUIC"), "q").otherwise("t"),
        tls_version(record_version, supported_versions),
        sni_flag(server_name),
        _two_digits(F.size(cipher_codes)),
        _two_digits(F.size(extension_codes)),
        alpn_chars(alpn),
    )
    sorted_ciphers = F.array_join(F.array_sort(F.transform(cipher_codes, hex4)), ",")
    sorted_extensions = F.array_join(F.array_sort(F.transform(kept, hex4)), ",")
    tail = F.when(F.size(signatures) > 0, F.concat(F.lit("_"), F.array_join(signatures, ","))).otherwise("")

    def digest(text):
        return F.substring(F.sha2(text, 256), 1, 12)

    return F.concat_ws(
        "_",
        head,
        F.when(F.size(cipher_codes) > 0, digest(sorted_ciphers)).otherwise(EMPTY_HASH),
        F.when(F.size(kept) > 0, digest(F.concat(sorted_extensions, tail))).otherwise(EMPTY_HASH),
    )


def is_malicious(fingerprint: Column) -> Column:
    return F.coalesce(fingerprint.isin(MALICIOUS_JA4), F.lit(False))


def lacks_sni(fingerprint: Column) -> Column:
    return F.coalesce((F.length(fingerprint) >= 4) & (F.substring(fingerprint, 4, 1) == "i"), F.lit(False))


def lacks_alpn(fingerprint: Column) -> Column:
    return F.coalesce((F.length(fingerprint) >= 10) & (F.substring(fingerprint, 9, 2) == "00"), F.lit(False))
