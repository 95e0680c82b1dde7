"""The same answers in DuckDB SQL, built from shared table expressions."""

from __future__ import annotations

import re

DAY = 86_400_000_000
KEYS = "capture_id, bucket, src_ip, src_port, dst_ip, dst_port, protocol"
PAIR = "capture_id, src_ip, dst_ip, dst_port, protocol"
TUPLE = "capture_id, src_ip, src_port, dst_ip, dst_port, protocol"

PARTS: dict[str, str] = {}

PARTS["ev"] = """
SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k,
       epoch_us(ts) AS ts_us FROM events"""

PARTS["packets"] = """
SELECT CAST((user_id % 16) % 4 AS VARCHAR) AS capture_id, event_id AS frame_no, ts_us,
  '10.0.0.' || (user_id % 16 + 1) AS src_ip, CAST(user_id % 32 + 40000 AS INTEGER) AS src_port,
  '192.0.2.' || (k % 8 + 1) AS dst_ip,
  CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'error' THEN 53 WHEN 'signup' THEN 8443 ELSE 4444 END AS dst_port,
  CASE WHEN event_type = 'error' THEN 'UDP' ELSE 'TCP' END AS protocol,
  CAST(floor(value * 10) AS INTEGER) + 40 AS frame_len,
  CASE k % 3 WHEN 0 THEN 64 WHEN 1 THEN 128 ELSE 255 END AS ttl,
  md5(CAST(event_id AS VARCHAR)) || md5(CAST(user_id AS VARCHAR)) || md5(CAST(k AS VARCHAR)) AS payload_hex,
  CASE WHEN event_type = 'error' THEN CASE WHEN k >= 50 THEN md5(CAST(event_id AS VARCHAR)) ELSE 'www' || k END || '.example.test' END AS dns_name,
  CASE WHEN event_type = 'error' THEN ['A', 'AAAA', 'TXT', 'MX'][k % 4 + 1] END AS dns_type,
  event_type = 'signup' AS is_syn,
  CASE WHEN event_type = 'click' AND k % 3 = 0 THEN ['t13i050200_e133e205ac38_000000000000',
    't13i1516h2_8daaf6152771_b186095e22b6', 't13d151600_8daaf6152771_b186095e22b6',
    't13d1516h2_8daaf6152771_b186095e22b6'][k % 4 + 1] END AS ja4
FROM ev
UNION ALL
SELECT CAST((user_id % 16) % 4 AS VARCHAR), event_id + 1000000000, ts_us + 10,
  '192.0.2.' || (k % 8 + 1),
  CASE event_type WHEN 'click' THEN 443 WHEN 'view' THEN 80 WHEN 'error' THEN 53 WHEN 'signup' THEN 8443 ELSE 4444 END,
  '10.0.0.' || (user_id % 16 + 1), CAST(user_id % 32 + 40000 AS INTEGER),
  CASE WHEN event_type = 'error' THEN 'UDP' ELSE 'TCP' END, 60,
  CASE k % 3 WHEN 0 THEN 64 WHEN 1 THEN 128 ELSE 255 END, '', NULL, NULL, FALSE, NULL
FROM ev WHERE k % 5 = 0"""

PARTS["pw"] = f"SELECT *, ts_us // {DAY} AS bucket FROM packets"

PARTS["totals"] = f"""
SELECT {KEYS}, count(*) AS n_packets, count(*) FILTER (frame_len > 0) AS n_sized,
  CAST(coalesce(sum(frame_len) FILTER (frame_len > 0), 0) AS BIGINT) AS total_bytes,
  min(frame_len) FILTER (frame_len > 0) AS size_min, max(frame_len) FILTER (frame_len > 0) AS size_max,
  avg(frame_len) FILTER (frame_len > 0) AS size_mean,
  coalesce(stddev_samp(frame_len) FILTER (frame_len > 0), 0) AS size_std,
  count(*) FILTER (is_syn) AS syn_count, CAST(sum(length(payload_hex) // 2) AS BIGINT) AS payload_bytes,
  min(frame_no) AS first_frame, arg_min(ts_us, frame_no) AS first_ts_us, arg_min(ttl, frame_no) AS ttl,
  arg_max(ja4, frame_no) FILTER (ja4 IS NOT NULL) AS own_ja4
FROM pw GROUP BY ALL"""

PARTS["kept"] = """
SELECT t.*, r.total_bytes AS reverse_bytes, coalesce(t.own_ja4, r.own_ja4) AS hello_ja4
FROM totals t LEFT JOIN totals r ON t.capture_id = r.capture_id AND t.bucket = r.bucket AND t.src_ip = r.dst_ip
  AND t.src_port = r.dst_port AND t.dst_ip = r.src_ip AND t.dst_port = r.src_port AND t.protocol = r.protocol
WHERE t.n_sized > 0"""

PARTS["gap_rows"] = f"""
SELECT {KEYS}, ts_us - lag(ts_us) OVER (PARTITION BY {KEYS} ORDER BY frame_no) AS gap FROM pw"""
PARTS["gaps"] = f"""
SELECT {KEYS}, coalesce(avg(gap) FILTER (gap > 0) / 1e6, 0) AS gap_mean,
  coalesce(stddev_samp(gap) FILTER (gap > 0) / 1e6, 0) AS gap_std FROM gap_rows GROUP BY ALL"""

PARTS["byte_counts"] = f"""
SELECT {KEYS}, token, count(*) AS c FROM (
  SELECT {KEYS}, unnest(regexp_extract_all(payload_hex, '..')) AS token FROM pw WHERE payload_hex <> '') GROUP BY ALL"""
PARTS["payload"] = f"""
SELECT {KEYS}, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS entropy FROM byte_counts GROUP BY ALL"""

PARTS["dns_joined"] = f"""
SELECT {KEYS}, string_agg(lower(replace(dns_name, '.', '')), '' ORDER BY frame_no) AS text,
  avg(length(replace(dns_name, '.', '')) / (length(dns_name) - length(replace(dns_name, '.', '')) + 1)) AS dns_query_len
FROM pw WHERE dns_name IS NOT NULL GROUP BY ALL"""
PARTS["gram_counts"] = f"""
SELECT {KEYS}, substr(text, i, 2) AS token, count(*) AS c FROM (
  SELECT {KEYS}, text, unnest(range(1, length(text))) AS i FROM dns_joined) GROUP BY ALL"""
PARTS["grams"] = f"""
SELECT {KEYS}, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS ngram FROM gram_counts GROUP BY ALL"""
PARTS["dns"] = f"""
SELECT d.{KEYS.replace(', ', ', d.')}, CASE WHEN length(d.text) >= 3 THEN g.ngram END AS dns_ngram_entropy, d.dns_query_len
FROM dns_joined d LEFT JOIN grams g USING ({KEYS})"""

PARTS["modal"] = f"""
SELECT {KEYS}, dns_type AS dns_record_type FROM (
  SELECT {KEYS}, dns_type, row_number() OVER (PARTITION BY {KEYS} ORDER BY count(*) DESC, min(frame_no)) AS nth
  FROM pw WHERE dns_type IS NOT NULL GROUP BY {KEYS}, dns_type) WHERE nth = 1"""

PARTS["fan"] = """
SELECT capture_id, bucket, src_ip, count(DISTINCT (dst_ip, dst_port)) AS window_fanout FROM pw GROUP BY ALL"""

PARTS["per_source"] = """
SELECT capture_id, bucket, dst_ip, dst_port, protocol, src_ip, count(*) AS c, count(*) FILTER (is_syn) AS syns
FROM pw GROUP BY ALL"""
PARTS["target"] = f"""
SELECT capture_id, bucket, dst_ip, dst_port, protocol, sum(c) / ({DAY} / 1e6) AS target_pkt_rate,
  sum(syns) / sum(c) AS target_syn_fraction, greatest(log2(sum(c)) - sum(c * log2(c)) / sum(c), 0) AS src_ip_entropy
FROM per_source GROUP BY ALL"""

PARTS["arrivals"] = f"""
SELECT {PAIR}, bucket, arg_min(first_ts_us, first_frame) AS ts FROM kept GROUP BY ALL"""


def beacons(lookback: int, keep: int) -> str:
    return f"""
SELECT {PAIR}, bucket, avg(gap) / 1e6 AS beacon_mean, stddev_samp(gap) / 1e6 AS beacon_std FROM (
  SELECT {PAIR}, bucket, t - lag(t) OVER (PARTITION BY {PAIR}, bucket ORDER BY t) AS gap,
         count(*) OVER (PARTITION BY {PAIR}, bucket) AS n
  FROM (SELECT {PAIR}, bucket, ts, unnest(times) AS t FROM (
    SELECT {PAIR}, bucket, ts, list(ts) OVER (PARTITION BY {PAIR} ORDER BY ts ROWS BETWEEN {keep - 1} PRECEDING AND CURRENT ROW) AS times
    FROM arrivals)) WHERE t >= ts - {lookback})
WHERE n >= 4 AND gap > 0 GROUP BY ALL HAVING count(*) >= 3"""


PARTS["beacon"] = beacons(30 * DAY, 64)


def fanouts(horizon: int) -> str:
    return f"""
SELECT q.capture_id, q.src_ip, q.t AS first_ts_us, count(DISTINCT (s.dst_ip, s.dst_port)) AS horizon_fanout
FROM (SELECT DISTINCT capture_id, src_ip, first_ts_us AS t FROM kept) q JOIN kept s
  ON q.capture_id = s.capture_id AND q.src_ip = s.src_ip AND s.first_ts_us BETWEEN q.t - {horizon} AND q.t
GROUP BY ALL"""


PARTS["hfan"] = fanouts(7 * DAY)


def prints(horizon: int) -> str:
    return f"""
SELECT {TUPLE}, bucket, CASE WHEN first_ts_us - hello_ts BETWEEN 0 AND {horizon} THEN hello END AS ja4 FROM (
  SELECT {TUPLE}, bucket, first_ts_us,
    last_value(hello_ja4 IGNORE NULLS) OVER w AS hello,
    last_value(CASE WHEN hello_ja4 IS NOT NULL THEN first_ts_us END IGNORE NULLS) OVER w AS hello_ts
  FROM kept WINDOW w AS (PARTITION BY {TUPLE} ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


PARTS["fprint"] = prints(7 * DAY)

PARTS["flows"] = f"""
SELECT k.capture_id, k.bucket, k.src_ip, k.src_port, k.dst_ip, k.dst_port, k.protocol, k.first_ts_us AS ts_us,
  substr(sha256(concat_ws(':', k.src_ip, k.src_port, k.dst_ip, k.dst_port, k.protocol, k.bucket)), 1, 16) AS flow_id,
  k.first_frame, k.size_min, k.size_max, k.size_mean, k.size_std, g.gap_mean, g.gap_std, coalesce(p.entropy, 0) AS entropy,
  least(1, k.payload_bytes / k.total_bytes) AS byte_ratio, k.ttl, f.ja4, b.beacon_mean, b.beacon_std,
  d.dns_ngram_entropy, greatest(h.horizon_fanout, w.window_fanout, 1) AS fanout_count,
  CASE WHEN k.src_ip LIKE '10.%' AND k.dst_ip NOT LIKE '10.%' THEN k.total_bytes
       WHEN k.dst_ip LIKE '10.%' AND k.src_ip NOT LIKE '10.%' THEN k.reverse_bytes END AS outbound_bytes,
  CASE WHEN k.dst_ip LIKE '10.%' AND k.src_ip NOT LIKE '10.%' THEN k.total_bytes
       WHEN k.src_ip LIKE '10.%' AND k.dst_ip NOT LIKE '10.%' THEN k.reverse_bytes END AS inbound_bytes,
  k.n_packets / ({DAY} / 1e6) AS pkt_rate, k.total_bytes / ({DAY} / 1e6) AS byte_rate,
  k.syn_count, k.syn_count / k.n_packets AS syn_fraction, t.target_pkt_rate, t.target_syn_fraction, t.src_ip_entropy,
  d.dns_query_len, m.dns_record_type
FROM kept k
LEFT JOIN gaps g USING ({KEYS}) LEFT JOIN payload p USING ({KEYS}) LEFT JOIN dns d USING ({KEYS})
LEFT JOIN modal m USING ({KEYS}) LEFT JOIN fprint f USING ({KEYS})
LEFT JOIN target t USING (capture_id, bucket, dst_ip, dst_port, protocol)
LEFT JOIN fan w USING (capture_id, bucket, src_ip)
LEFT JOIN hfan h USING (capture_id, src_ip, first_ts_us)
LEFT JOIN beacon b USING ({PAIR}, bucket)"""

IOC = """('t13d1200h1_5b20,21,35_00',
 't13d1618h0_002f,00-02-01_1301-1302-1303-1201-1200_000b-000a-0009-0008_0016,_45,1',
 't13i050200_e133e205ac38_000000000000', 't13i040200_002f1301c02f_000000000000',
 't12i040400_002fc02fc030_000000000000', 't13i050100_e133e205ac38_b9a491fefe05')"""
SUSPICIOUS = "(4444, 5555, 6666, 6667, 6668, 6669, 7777, 8888, 9999, 27373, 27374, 31337)"

# Thresholds as in queries.LIMITS: the reference values scaled to one-day windows.
PARTS["rule_hits"] = f"""
SELECT *,
  coalesce(coalesce(target_pkt_rate, pkt_rate) >= 0.00003 AND coalesce(target_syn_fraction, syn_fraction) >= 0.8, FALSE) AS r1,
  coalesce(coalesce(target_pkt_rate, pkt_rate) >= 0.00005 AND src_ip_entropy >= 1.01, FALSE) AS r2,
  gap_mean < 0.002 AS r3,
  gap_mean < 0.002 AND fanout_count < 15 AND size_mean >= 700 AS r4,
  coalesce(beacon_mean > 0 AND beacon_std / beacon_mean <= 0.6 AND beacon_mean BETWEEN 5 AND 260000, FALSE) AS r5,
  coalesce(dns_ngram_entropy >= 4.51 AND dst_port IN (53, 853, 5353, 5355), FALSE) AS r6,
  dst_port > 8000 AND dst_port <> 8080 AS r7,
  fanout_count >= 15 AS r8,
  fanout_count >= 15 AND size_mean < 200 AS r9,
  dst_port IN {SUSPICIOUS} AS r10,
  dst_port IN {SUSPICIOUS} AND entropy > 5.43 AS r11,
  coalesce(ja4 IN {IOC}, FALSE) AS r12,
  coalesce(ja4 NOT IN {IOC} AND substr(ja4, 4, 1) = 'i' AND entropy > 5.33, FALSE) AS r13,
  coalesce(ja4 NOT IN {IOC} AND NOT (substr(ja4, 4, 1) = 'i' AND entropy > 5.33) AND substr(ja4, 9, 2) = '00'
    AND (dst_port IN {SUSPICIOUS} OR entropy > 5.41), FALSE) AS r14,
  entropy > 5.47 AS r15,
  outbound_bytes IS NOT NULL AND inbound_bytes IS NOT NULL AND coalesce(outbound_bytes / greatest(outbound_bytes + inbound_bytes, 1) > 0.9 AND outbound_bytes > 4000, FALSE) AS r16
FROM flows"""


def _w(*pairs: tuple[str, float]) -> str:
    return " + ".join(f"CASE WHEN {r} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for r, w in pairs)


PARTS["rule_votes"] = f"""
SELECT *, least({_w(('r1', .55), ('r2', .55), ('r3', .2), ('r4', .25), ('r5', .35), ('r6', .45), ('r7', .15), ('r8', .45),
    ('r9', .15), ('r10', .2), ('r11', .15), ('r12', .4), ('r13', .3), ('r14', .2), ('r15', .1), ('r16', .3))}, 1) AS rules_raw,
  {_w(('r1', .55), ('r2', .55), ('r4', .45))} AS v_ddos, {_w(('r5', .5))} AS v_c2, {_w(('r6', .45))} AS v_dga,
  {_w(('r8', .45), ('r9', .15))} AS v_recon, {_w(('r11', .35), ('r12', .4), ('r13', .3), ('r14', .2))} AS v_mal,
  {_w(('r16', .3))} AS v_exfil,
  concat_ws(' ', CASE WHEN r1 THEN 'syn_flood_rate' END, CASE WHEN r2 THEN 'distributed_target_rate source_entropy' END,
    CASE WHEN r3 THEN 'extremely_low_inter_arrival_time' END, CASE WHEN r4 THEN 'sustained_high_volume_on_single_target' END,
    CASE WHEN r5 THEN 'regular_beacon_interval' END, CASE WHEN r6 THEN 'high_dns_ngram_entropy' END,
    CASE WHEN r7 THEN 'unusual_destination_port' END, CASE WHEN r8 THEN 'high_target_fanout' END,
    CASE WHEN r9 THEN 'low_volume_probe_traffic' END, CASE WHEN r10 THEN 'suspicious_destination_port' END,
    CASE WHEN r11 THEN 'high_entropy_payload' END, CASE WHEN r12 THEN 'malicious_ja4_fingerprint' END,
    CASE WHEN r13 THEN 'ja4_missing_sni_encrypted' END, CASE WHEN r14 THEN 'ja4_anomalous_no_alpn' END,
    CASE WHEN r15 THEN 'very_high_entropy_payload' END, CASE WHEN r16 THEN 'directional_exfil_outbound' END) AS rules_text
FROM rule_hits"""
PARTS["rules"] = """
SELECT *, 1 / (1 + exp(-5 * (rules_raw - 0.25))) AS rules_p,
  CASE WHEN top <= 0 THEN NULL WHEN v_c2 = top THEN 'c2_beaconing' WHEN v_exfil = top THEN 'data_exfiltration'
    WHEN v_dga = top THEN 'dga_dns_tunneling' WHEN v_mal = top THEN 'encrypted_malware'
    WHEN v_recon = top THEN 'recon_scanning' ELSE 'volumetric_ddos' END AS rules_guess
FROM (SELECT *, greatest(v_ddos, v_c2, v_dga, v_recon, v_mal, v_exfil) AS top FROM rule_votes)"""

PARTS["baseline"] = """
SELECT avg(gap_mean) AS m1, stddev_pop(gap_mean) AS s1, avg(size_mean) AS m2, stddev_pop(size_mean) AS s2,
  avg(entropy) AS m3, stddev_pop(entropy) AS s3, avg(byte_ratio) AS m4, stddev_pop(byte_ratio) AS s4,
  avg(ttl) AS m5, stddev_pop(ttl) AS s5, avg(fanout_count) AS m6, stddev_pop(fanout_count) AS s6
FROM flows WHERE dst_port = 80"""
PARTS["zrows"] = """
SELECT r.*, abs((gap_mean - m1) / CASE WHEN s1 > 0 THEN s1 ELSE 1 END) AS z1, abs((size_mean - m2) / CASE WHEN s2 > 0 THEN s2 ELSE 1 END) AS z2,
  abs((entropy - m3) / CASE WHEN s3 > 0 THEN s3 ELSE 1 END) AS z3, abs((byte_ratio - m4) / CASE WHEN s4 > 0 THEN s4 ELSE 1 END) AS z4,
  abs((ttl - m5) / CASE WHEN s5 > 0 THEN s5 ELSE 1 END) AS z5, abs((fanout_count - m6) / CASE WHEN s6 > 0 THEN s6 ELSE 1 END) AS z6
FROM rules r CROSS JOIN baseline"""
PARTS["stats"] = """
SELECT *, 1 / (1 + exp(-5 * (stats_raw - 0.25))) AS stats_p,
  concat_ws(' ', CASE WHEN z1 > 2 THEN 'unusual_inter_arrival_time' END, CASE WHEN z2 > 2 THEN 'unusual_packet_size' END,
    CASE WHEN z3 > 2 THEN 'unusual_entropy' END, CASE WHEN z4 > 2 THEN 'unusual_byte_ratio' END,
    CASE WHEN z5 > 2 THEN 'unusual_ttl' END, CASE WHEN z6 > 2 THEN 'unusual_fanout' END) AS stats_text
FROM (SELECT *, least(((z1 + z2 + z3 + z4 + z5 + z6) / 6 * 0.5 + greatest(z1, z2, z3, z4, z5, z6) * 0.5) / 5, 1) AS stats_raw FROM zrows)"""

# Stand-ins for the two fitted layers, as externally supplied scores.
PARTS["given"] = """
SELECT *, least(1, entropy / 6) AS iso_raw, 1 / (1 + exp(-5 * (least(1, entropy / 6) - 0.6))) AS iso_p,
  1 - ((bucket * 7 + src_port + dst_port) % 10) / 10.0::DOUBLE AS xgb_p,
  CASE dst_port WHEN 80 THEN 'volumetric_ddos' WHEN 443 THEN 'c2_beaconing' WHEN 53 THEN 'dga_dns_tunneling'
    WHEN 8443 THEN 'recon_scanning' WHEN 4444 THEN 'encrypted_malware' ELSE 'data_exfiltration' END AS xgb_top
FROM stats"""
PARTS["four"] = """
SELECT *, CASE WHEN 1 - xgb_p < 0.5 THEN xgb_top END AS xgb_guess,
  (CASE WHEN rules_guess IS NULL AND rules_p >= 0.75 THEN 1 ELSE 0 END) + (CASE WHEN stats_p >= 0.75 THEN 1 ELSE 0 END)
  + (CASE WHEN iso_p >= 0.75 THEN 1 ELSE 0 END) + (CASE WHEN NOT (1 - xgb_p < 0.5) AND xgb_p >= 0.75 THEN 1 ELSE 0 END) AS n_strong,
  lower(concat_ws(' ', rules_text, stats_text, xgb_top || '=0')) AS said
FROM given"""
PARTS["fused"] = """
SELECT *, (rules_p + stats_p + iso_p + xgb_p) / 4 AS confidence_score,
  CASE WHEN kind <> 'anomaly' THEN CASE WHEN agreeing >= 2 THEN 'high' WHEN agreeing = 1 THEN 'advisory' ELSE 'uncorroborated' END ELSE 'advisory' END AS tier,
  kind <> 'none' AND (rules_p + stats_p + iso_p + xgb_p) / 4 >= CASE WHEN kind = 'named' AND (agreeing >= 2) THEN 0.5 ELSE 0.70 END AS is_actionable
FROM (SELECT *,
  CASE kind
    WHEN 'named' THEN CASE WHEN rules_guess IS NULL THEN xgb_guess WHEN xgb_guess IS NULL OR rules_guess = xgb_guess THEN rules_guess
      WHEN xgb_p > rules_p THEN xgb_guess ELSE rules_guess END
    WHEN 'anomaly' THEN CASE
      WHEN contains(said, 'fanout') OR contains(said, 'port') OR contains(said, 'scan') OR contains(said, 'targets') THEN 'recon_scanning'
      WHEN contains(said, 'byte') OR contains(said, 'exfil') OR contains(said, 'upload') OR contains(said, 'outbound') THEN 'data_exfiltration'
      WHEN contains(said, 'dns') OR contains(said, 'tunnel') OR contains(said, 'entropy') OR contains(said, 'query') THEN 'dga_dns_tunneling'
      WHEN contains(said, 'rate') OR contains(said, 'packet_count') OR contains(said, 'pps') OR contains(said, 'flood') THEN 'volumetric_ddos'
      ELSE 'recon_scanning' END
    ELSE 'volumetric_ddos' END AS threat_class,
  CASE kind WHEN 'anomaly' THEN n_strong WHEN 'none' THEN 0
    ELSE CASE WHEN rules_guess = xgb_guess THEN 2 + n_strong WHEN rules_guess IS NOT NULL AND xgb_guess IS NOT NULL THEN 1 ELSE 1 + n_strong END END AS agreeing
  FROM (SELECT *, CASE WHEN rules_guess IS NOT NULL OR xgb_guess IS NOT NULL THEN 'named' WHEN n_strong > 0 THEN 'anomaly' ELSE 'none' END AS kind FROM four))"""

PARTS["doc_marks"] = """
SELECT d.doc_id,
  CASE WHEN l.toxic = 1 THEN 'data_exfiltration' WHEN l.quality = 1 THEN 'benign' ELSE 'recon_scanning' END AS truth,
  CASE WHEN d.n_chars < 600 THEN 'recon_scanning' WHEN d.n_chars < 4000 THEN 'benign' WHEN d.n_chars < 20000 THEN 'data_exfiltration'
    ELSE 'c2_beaconing' END AS predicted,
  1 / (1 + d.n_chars / 1000.0::DOUBLE) AS confidence, d.lang, d.source
FROM documents d JOIN labels l USING (doc_id)"""
PARTS["mark_classes"] = """
SELECT * FROM (VALUES ('benign'), ('volumetric_ddos'), ('c2_beaconing'), ('dga_dns_tunneling'), ('encrypted_malware'),
  ('recon_scanning'), ('data_exfiltration')) AS c(class)"""
PARTS["mark_counts"] = """
SELECT class, (SELECT count(*) FROM doc_marks WHERE truth = class AND predicted = class) AS tp,
  (SELECT count(*) FROM doc_marks WHERE truth = class) AS support, (SELECT count(*) FROM doc_marks WHERE predicted = class) AS claimed
FROM mark_classes"""
PARTS["mark_metrics"] = """
SELECT class, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support
FROM (SELECT class, CASE WHEN claimed > 0 THEN tp / claimed ELSE 0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, support FROM mark_counts)"""

TRUTH = """CASE dst_port WHEN 53 THEN 'dga_dns_tunneling' WHEN 443 THEN 'c2_beaconing' WHEN 8443 THEN 'recon_scanning'
  WHEN 4444 THEN 'encrypted_malware' ELSE 'benign' END"""
LENIENT_LABELS = """SELECT event_id, CASE event_type WHEN 'click' THEN 'benign' WHEN 'view' THEN 'volumetric_ddos' WHEN 'error' THEN 'recon_scanning'
  WHEN 'signup' THEN 'c2_beaconing' END AS class FROM events"""

PARTS["half"] = "SELECT min(epoch_us(ts)) + 15 * 86400000000 AS cut FROM events"
PARTS["ref_scores"] = "SELECT value AS score FROM events, half WHERE epoch_us(ts) < cut"
PARTS["cur_scores"] = "SELECT value * 1.2 AS score FROM events, half WHERE epoch_us(ts) >= cut"

PARTS["hello"] = """
SELECT vec_id, ['0x1301', '0x1302', '0xc02f', '4865', '0x0a0a'][1 + vec_id % 5] AS c1,
  printf('0x%04x', CAST(4096 + vec_id % 512 AS BIGINT)) AS c2, CAST(49195 + label AS VARCHAR) AS c3,
  CAST(vec_id % 20 AS VARCHAR) AS e1, CAST(label AS VARCHAR) AS e2, '16' AS e3, '0x2a2a' AS e4,
  CASE vec_id % 4 WHEN 0 THEN 'h2' WHEN 1 THEN 'http/1.1' WHEN 2 THEN '' END AS alpn,
  CASE vec_id % 3 WHEN 0 THEN 'host' || vec_id || '.example.test' WHEN 1 THEN '10.0.0.' || vec_id % 256 END AS sni,
  CASE WHEN vec_id % 2 = 0 THEN ['0x0304', '0x0303', '0x3a3a'] ELSE [] END AS versions,
  ['0x0301', '0x0302', '0x0303', '0x0304', '0x0300', '0x0002', '0x9999'][1 + vec_id % 7] AS version,
  CASE WHEN vec_id % 6 = 0 THEN [] ELSE ['0x0403', '0x0804', '0x0a0a'] END AS sigs,
  CASE WHEN vec_id % 5 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol FROM embeddings"""


def sql(body: str, **extra: str) -> str:
    """Prefix a query with the table expressions it uses, in order of need."""
    parts = {**PARTS, **extra}
    order: list[str] = []

    def need(text: str) -> None:
        for name in parts:
            if name not in order and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need(parts[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({parts[n].strip()})" for n in order) + "\n" + body


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def r6s(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n} + 0.00000013::DOUBLE, {digits}) + 0.0 AS {n}" for n in names)


FLOW_OUT = f"""SELECT flow_id, capture_id, ts_us, {r6s('gap_mean', 'gap_std')}, {r6s('beacon_mean', 'beacon_std', digits=3)}, {r6('size_min', 'size_max', 'size_mean', 'size_std', 'entropy', 'byte_ratio',
    'dns_ngram_entropy', 'pkt_rate', 'byte_rate', 'syn_fraction', 'target_pkt_rate',
    'target_syn_fraction', 'src_ip_entropy', 'dns_query_len')}, ttl, ja4, fanout_count, outbound_bytes, inbound_bytes, syn_count, dns_record_type FROM flows"""

HELLO_JA4 = """
SELECT vec_id, head || '_' || b || '_' || c AS ja4,
  head || '_' || b || '_' || c LIKE '___i%' AS no_sni, substr(head, 9, 2) = '00' AS no_alpn
FROM (SELECT vec_id, CASE WHEN protocol = 'UDP' THEN 'q' ELSE 't' END
    || CASE WHEN vec_id % 2 = 0 THEN '13' ELSE CASE version WHEN '0x0304' THEN '13' WHEN '0x0303' THEN '12' WHEN '0x0302' THEN '11'
       WHEN '0x0301' THEN '10' WHEN '0x0300' THEN 's3' WHEN '0x0002' THEN 's2' ELSE '00' END END
    || CASE WHEN vec_id % 3 = 0 THEN 'd' ELSE 'i' END || lpad(CAST(len(cs) AS VARCHAR), 2, '0') || '03'
    || CASE vec_id % 4 WHEN 0 THEN 'h2' WHEN 1 THEN 'h1' ELSE '00' END AS head,
    substr(sha256(array_to_string(list_sort(cs), ',')), 1, 12) AS b,
    CASE WHEN len(es) = 0 THEN '000000000000' ELSE substr(sha256(array_to_string(list_sort(es), ',') || CASE WHEN len(sigs) > 0 THEN '_0403,0804' ELSE '' END), 1, 12) END AS c
  FROM (SELECT *, list_filter([CASE c1 WHEN '4865' THEN '1301' WHEN '0x0a0a' THEN NULL ELSE substr(c1, 3) END,
      substr(c2, 3), printf('%04x', CAST(c3 AS BIGINT))], lambda x: x IS NOT NULL) AS cs,
    list_transform(list_filter([CAST(e1 AS BIGINT), CAST(e2 AS BIGINT)], lambda x: x NOT IN (0, 16)), lambda x: printf('%04x', x)) AS es FROM hello))"""

ORACLES: dict[str, str] = {}


def _fill() -> None:
    o = ORACLES
    o["flagship_verdicts"] = sql("""SELECT coalesce(rules_guess, 'none') AS verdict, count(*) AS flows,
      round(avg(rules_raw), 6) AS mean_score FROM rules GROUP BY ALL""")
    o["s1_packet_json"] = sql("""SELECT frame_no, ts_us, src_ip, src_port, dst_ip, dst_port, protocol, frame_len, ttl,
      payload_hex, coalesce(dns_name, '') AS dns_name, dns_type, is_syn, ja4 FROM packets""")
    o["s2_flow_records"] = """SELECT CASE WHEN event_id % 50 = 0 THEN 'malformed' WHEN event_id % 50 = 1 THEN 'ttl: required'
        WHEN event_id % 50 = 2 THEN 'syn_fraction: above 1' WHEN event_id % 50 = 3 THEN 'pkt_rate: below 0' ELSE 'valid' END AS outcome,
        count(*) AS n FROM events GROUP BY ALL"""
    o["s3_stream_quarantine"] = "WITH o AS (" + o["s2_flow_records"] + """) SELECT * FROM o
        UNION ALL SELECT 'counted valid', CAST(sum(n) FILTER (outcome = 'valid') AS BIGINT) FROM o
        UNION ALL SELECT 'counted rejected', CAST(sum(n) FILTER (outcome <> 'valid') AS BIGINT) FROM o"""
    o["s3_validation"] = sql("""SELECT count(*) AS records, count(*) FILTER (dst_port = 53) AS rejected,
      count(*) FILTER (dst_port <> 53) AS accepted FROM flows""")
    o["s4_labelled_csv"] = """SELECT label, n_measures, count(*) AS n, CAST(sum(port) AS BIGINT) AS ports FROM (
        SELECT CASE event_type WHEN 'click' THEN 'benign' WHEN 'view' THEN 'volumetric_ddos' WHEN 'error' THEN 'recon_scanning' ELSE 'UNMATCHED' END AS label,
          4 AS n_measures, user_id % 100 + 1 AS port FROM events) GROUP BY ALL"""
    o["s5_lenient_csv"] = """SELECT coalesce(label, 'none') AS label, count(*) AS n, round(avg(gap), 6) AS gap_mean, round(avg(ratio), 6) AS byte_ratio FROM (
        SELECT CASE event_type WHEN 'click' THEN 'benign' WHEN 'view' THEN 'volumetric_ddos' WHEN 'error' THEN 'recon_scanning' WHEN 'signup' THEN 'c2_beaconing' END AS label,
          CASE WHEN g > 1000 THEN g / 1e6 ELSE g END AS gap, CASE WHEN bytes <> 0 THEN least(1, bytes / greatest(1, pkts * greatest(mean, 1))) ELSE 0 END AS ratio
        FROM (SELECT event_type, pkts, bytes, mean, CASE WHEN iat <= 0 AND pkts > 1 AND dur > 0 THEN dur / greatest(1, pkts - 1) ELSE iat END AS g
          FROM (SELECT event_type, CAST(user_id % 9 AS DOUBLE) AS pkts, CAST(user_id % 7 * 100 AS DOUBLE) AS bytes,
            CASE WHEN event_id % 11 = 0 THEN 0 ELSE CAST(event_id % 300 AS DOUBLE) END AS mean,
            CASE WHEN event_id % 13 = 0 THEN 0 ELSE CAST(event_id % 5 * 700 AS DOUBLE) END AS iat, CAST(event_id % 1000 * 100 AS DOUBLE) AS dur FROM events)))
      GROUP BY ALL"""
    o["s6_zeek_log"] = """SELECT label, count(*) AS n, CAST(sum(port) AS BIGINT) AS ports FROM (
        SELECT CASE event_type WHEN 'click' THEN 'benign' WHEN 'view' THEN 'c2_beaconing' WHEN 'error' THEN 'recon_scanning' ELSE 'UNMATCHED' END AS label,
          user_id % 100 + 1 AS port FROM events) GROUP BY ALL"""
    o["s7_provenance"] = """SELECT count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(sum(event_id % 97) AS BIGINT) AS check, count(*) AS hashed FROM events WHERE event_type IN ('click', 'view', 'error')"""
    o["s6_iot23_folder"] = """SELECT CASE event_type WHEN 'click' THEN 'benign' WHEN 'view' THEN 'c2_beaconing' WHEN 'error' THEN 'recon_scanning' ELSE 'volumetric_ddos' END AS label,
      'external_observation' AS record_type, event_id % 3 <> 0 AS csv, count(*) AS n, CAST(sum(user_id % 100 + 1) AS BIGINT) AS ports, CAST(sum(event_id) AS BIGINT) AS ids,
      'entropy,byte_ratio,ja4' AS missing FROM events WHERE event_type IS DISTINCT FROM 'signup' GROUP BY ALL"""
    o["s8_sinks"] = sql("SELECT count(*) AS n, round(sum(size_mean), 3) AS size_mean, CAST(sum(fanout_count) AS BIGINT) AS fanout FROM flows")

    o["p1_window_bucket"] = sql(f"SELECT bucket, count(*) AS n, min(ts_us) AS first_ts, max(ts_us) AS last_ts FROM (SELECT ts_us // 120000 AS bucket, ts_us FROM packets) GROUP BY ALL")
    o["p2_flow_id"] = sql("""SELECT frame_no, substr(sha256(concat_ws(':', src_ip, src_port, dst_ip, dst_port, protocol, bucket)), 1, 16) AS flow_id FROM pw""")
    o["p3_pure_syn"] = """SELECT l_orderkey, l_linenumber, flags, (CASE WHEN flags LIKE '0x%' THEN (v & 2) <> 0 AND (v & 16) = 0 ELSE FALSE END) AS is_syn FROM (
        SELECT l_orderkey, l_linenumber, v, CASE WHEN l_linenumber = 7 THEN 'zz' ELSE '0x' || printf('%04x', v) END AS flags
        FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS v FROM lineitem))"""
    o["p4_dns_fields"] = sql("SELECT frame_no, dns_name, dns_type FROM packets WHERE dns_name IS NOT NULL")
    o["p5_networks"] = sql("""SELECT src_ip, count(*) AS n, bool_or(src_ip LIKE '10.%') AS in_wide,
      bool_or(src_ip IN ('10.0.0.4', '10.0.0.5', '10.0.0.6', '10.0.0.7')) AS in_narrow FROM packets GROUP BY ALL""")
    o["p6_direction"] = sql("""SELECT CASE WHEN src_ip LIKE '10.%' AND dst_ip NOT LIKE '10.%' THEN 'outbound'
      WHEN dst_ip LIKE '10.%' AND src_ip NOT LIKE '10.%' THEN 'inbound' ELSE 'ambiguous' END AS direction, count(*) AS n, CAST(sum(frame_len) AS BIGINT) AS bytes FROM packets GROUP BY ALL""")
    o["p7_ja4"] = sql(HELLO_JA4)
    o["p8_ja4_tests"] = sql(f"""SELECT ja4, ja4 IN {IOC} AS malicious, substr(ja4, 4, 1) = 'i' AS no_sni, substr(ja4, 9, 2) = '00' AS no_alpn, count(*) AS n
      FROM packets WHERE ja4 IS NOT NULL GROUP BY ALL""")
    o["p9_features"] = sql(f"""SELECT flow_id, capture_id, {r6s('gap_mean', 'gap_std')}, {r6('size_mean', 'size_std', 'size_min', 'size_max', 'entropy', 'byte_ratio')},
      CAST(ttl AS DOUBLE) AS ttl, CAST(fanout_count AS DOUBLE) AS fanout_count, round(coalesce(dns_ngram_entropy, 0), 6) AS dns_ngram_entropy,
      CAST(beacon_mean IS NOT NULL AS INTEGER)::DOUBLE AS has_beacon, CAST(ja4 IS NOT NULL AS INTEGER)::DOUBLE AS has_ja4,
      CAST(coalesce(ja4 IN {IOC}, FALSE) AS INTEGER)::DOUBLE AS malicious, CAST(coalesce(substr(ja4, 4, 1) = 'i', FALSE) AS INTEGER)::DOUBLE AS no_sni,
      CAST(coalesce(substr(ja4, 9, 2) = '00', FALSE) AS INTEGER)::DOUBLE AS no_alpn, round(ln(1 + coalesce(outbound_bytes, 0)), 6) AS out_log,
      CAST(outbound_bytes IS NOT NULL AS INTEGER)::DOUBLE AS out_seen, CAST(coalesce(dns_record_type = 'TXT', FALSE) AS INTEGER)::DOUBLE AS is_txt,
      round(coalesce(dns_query_len, -1), 6) AS query_len FROM flows""")
    o["p10_exact_labels"] = """SELECT raw, CASE raw WHEN 'view' THEN 'UNMATCHED' WHEN 'Benign' THEN 'benign' WHEN ' DDoS ' THEN 'volumetric_ddos'
        WHEN 'PortScan' THEN 'recon_scanning' ELSE 'UNMATCHED' END AS threat_class, count(*) AS n FROM (
        SELECT CASE event_type WHEN 'click' THEN 'Benign' WHEN 'error' THEN ' DDoS ' WHEN 'signup' THEN 'PortScan' ELSE event_type END AS raw FROM events) GROUP BY ALL"""
    o["p11_substring_labels"] = """SELECT raw, CASE raw WHEN 'BENIGN' THEN 'benign' WHEN 'DoS Hulk' THEN 'volumetric_ddos' WHEN 'Bot' THEN 'c2_beaconing'
        WHEN 'FTP-Patator' THEN NULL ELSE 'recon_scanning' END AS threat_class, count(*) AS n FROM (
        SELECT CASE event_type WHEN 'click' THEN 'BENIGN' WHEN 'error' THEN 'DoS Hulk' WHEN 'signup' THEN 'Bot' WHEN 'view' THEN 'FTP-Patator' ELSE 'Port_Scan' END AS raw FROM events) GROUP BY ALL"""
    o["p12_severity"] = sql("""SELECT threat_class, CASE WHEN threat_class IN ('recon_scanning', 'dga_dns_tunneling') THEN 'medium' ELSE 'high' END AS severity,
      CASE WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.5 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n FROM fused GROUP BY ALL""")
    o["p13_squash"] = "SELECT event_id, round(1 / (1 + exp(-5 * (value / 500 - 0.25))), 6) AS p FROM events"
    o["p15_stride_sample"] = """SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) e
      JOIN (SELECT CAST(floor(i * ((SELECT count(*) FROM events) / 333.0::DOUBLE)) AS BIGINT) AS pos FROM range(333) t(i)) p USING (pos)"""
    o["p16_replicate"] = """SELECT e.label || '_bench' || i AS copy_id, e.vec_id FROM (SELECT CAST(vec_id AS VARCHAR) AS label, vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) e
      JOIN (SELECT i, i % (SELECT count(*) FROM embeddings) AS pos FROM range((SELECT CAST(count(*) * 5 // 2 AS BIGINT) FROM embeddings)) t(i)) r USING (pos)"""

    o["a1_flow_assembly"] = sql(f"SELECT {KEYS}, n_packets, n_sized FROM totals")
    o["a2_size_stats"] = sql(f"SELECT {KEYS}, {r6('size_min', 'size_max', 'size_mean', 'size_std')} FROM totals")
    o["a3_inter_arrival"] = sql(f"SELECT {KEYS}, {r6s('gap_mean', 'gap_std')} FROM gaps")
    o["a4_payload_entropy"] = sql(f"SELECT {KEYS}, {r6('entropy')} FROM payload")
    o["a4_document_entropy"] = """SELECT doc_id, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 AS entropy FROM (
        SELECT doc_id, token, count(*) AS c FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS token FROM documents) GROUP BY ALL) GROUP BY ALL"""
    o["a5_payload_fraction"] = sql(f"SELECT {KEYS}, round(least(1, payload_bytes / total_bytes), 6) AS byte_ratio FROM totals WHERE n_sized > 0")
    o["a6_window_fanout"] = sql("SELECT * FROM fan")
    o["a7_source_entropy"] = sql(f"SELECT capture_id, bucket, dst_ip, dst_port, protocol, {r6('src_ip_entropy')} FROM target")
    o["a8_target_rate"] = sql("SELECT capture_id, bucket, dst_ip, dst_port, protocol, round(target_pkt_rate, 9) AS target_pkt_rate FROM target")
    o["a9_target_syn"] = sql(f"SELECT capture_id, bucket, dst_ip, dst_port, protocol, {r6('target_syn_fraction')} FROM target")
    o["a10_rates"] = sql(f"SELECT {KEYS}, round(n_packets / ({DAY} / 1e6), 9) AS pkt_rate, round(total_bytes / ({DAY} / 1e6), 9) AS byte_rate FROM totals")
    o["a11_syn"] = sql(f"SELECT {KEYS}, syn_count, round(syn_count / n_packets, 6) AS syn_fraction FROM totals")
    o["a12_dns_entropy"] = sql(f"SELECT {KEYS}, {r6('dns_ngram_entropy')} FROM dns")
    o["a12_host_entropy"] = """SELECT host, round(log2(sum(c)) - sum(c * log2(c)) / sum(c), 6) + 0.0 AS ngram FROM (
        SELECT host, substr(text, i, 2) AS token, count(*) AS c FROM (SELECT host, text, unnest(range(1, length(text))) AS i FROM (
          SELECT host, lower(replace(host, '.', '')) AS text FROM (SELECT regexp_extract(url, '^https?://([^/:?]+)', 1) AS host FROM pages))) GROUP BY ALL) GROUP BY ALL"""
    o["a13_dns_label_length"] = sql(f"SELECT {KEYS}, {r6('dns_query_len')} FROM dns")
    o["a14_modal_dns_type"] = sql(f"SELECT {KEYS}, dns_record_type FROM modal")
    o["a15_first_packet"] = sql(f"SELECT {KEYS}, first_frame, first_ts_us, ttl FROM totals")
    o["a16_class_shares"] = sql("""SELECT c.threat_class, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM fused WHERE is_actionable), 6) AS share
      FROM (VALUES ('volumetric_ddos'), ('c2_beaconing'), ('dga_dns_tunneling'), ('encrypted_malware'), ('recon_scanning'), ('data_exfiltration')) c(threat_class)
      LEFT JOIN (SELECT threat_class, count(*) AS n FROM fused WHERE is_actionable GROUP BY ALL) USING (threat_class)""")
    o["a16_timeline"] = sql("""SELECT epoch_us(date_trunc('minute', make_timestamp(ts_us))) AS minute_us, count(*) AS n FROM fused WHERE is_actionable
      GROUP BY ALL ORDER BY 1 DESC LIMIT 10""")
    o["a16_latest"] = sql("SELECT flow_id, capture_id, ts_us, threat_class FROM fused WHERE is_actionable ORDER BY ts_us DESC, flow_id DESC LIMIT 500")
    o["a17_run_counters"] = sql("""SELECT count(DISTINCT (capture_id, bucket)) AS windows_processed, count(*) AS flows_scored,
      count(*) FILTER (is_actionable) AS alerts_emitted, count(*) FILTER (NOT is_actionable) AS alerts_suppressed FROM fused""")
    o["a18_label_counts"] = sql("SELECT lang AS partition, truth AS label, count(*) AS n FROM doc_marks GROUP BY ALL")
    o["a19_load_report"] = """SELECT count(*) AS rows, count(*) FILTER (event_type IN ('click', 'view', 'error')) AS ok,
      count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) AS unmatched FROM events"""

    o["a19_layouts"] = """SELECT CAST(event_id % 3 AS VARCHAR) AS layout, count(*) FILTER (event_id % 3 < 2) AS rows,
      count(*) FILTER (event_id % 3 < 2 AND event_type IN ('click', 'view', 'error')) AS ok,
      count(*) FILTER (event_id % 3 < 2 AND event_type NOT IN ('click', 'view', 'error')) AS unmatched,
      count(*) FILTER (event_id % 3 = 1) AS invalid, event_id % 3 = 2 AS unlabelled FROM events GROUP BY event_id % 3"""

    o["w1_beacon_interval"] = sql(f"""SELECT {PAIR}, bucket, {r6s('beacon_mean', 'beacon_std', digits=3)} FROM arrivals LEFT JOIN w1 USING ({PAIR}, bucket)""", w1=beacons(10 * DAY, 8))
    o["w2_horizon_fanout"] = sql("SELECT * FROM hfan")
    o["w3_carried_ja4"] = sql(f"SELECT {TUPLE}, bucket, ja4 FROM w3", w3=prints(3 * DAY))
    arrival = "SELECT *, 2 * (f - f % 64 + 63 - f % 64) + (frame_no >= 1000000000)::INT AS arrival FROM (SELECT *, frame_no % 1000000000 AS f, ts_us // 3600000000 AS bucket FROM packets)"
    o["w4_late_packets"] = sql("""SELECT capture_id, bucket, count(*) AS n, count(*) FILTER (late) AS late FROM (
      SELECT capture_id, bucket, coalesce(bucket < max(bucket) OVER (PARTITION BY capture_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late
      FROM arrived) GROUP BY ALL""", arrived=arrival)
    fate = f"""SELECT *, CASE WHEN late THEN 'late' WHEN nth > 60 THEN 'dropped' ELSE 'kept' END AS fate FROM (
      SELECT *, row_number() OVER (PARTITION BY capture_id, bucket, late ORDER BY arrival) AS nth FROM (
        SELECT * REPLACE (CASE WHEN frame_no % 11 <> 0 THEN ttl END AS ttl, ts_us // {DAY} AS bucket),
          coalesce(ts_us // {DAY} < max(ts_us // {DAY}) OVER (PARTITION BY capture_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS late
        FROM arrived))"""
    in_time = f"""SELECT {KEYS}, min(frame_no) AS first_frame, arg_min_null(ts_us, frame_no) AS ts_us, count(*) FILTER (is_syn) AS syn_count,
      arg_min_null(ttl, frame_no) AS ttl, count(*) AS packets, CAST(sum(frame_len) AS BIGINT) AS bytes FROM fated WHERE fate = 'kept' GROUP BY ALL"""
    o["w4_flows_without_late"] = sql("SELECT * FROM in_time", arrived=arrival, fated=fate, in_time=in_time)
    o["a17_packet_counters"] = sql("""SELECT capture_id, p.* EXCLUDE capture_id, windows, flows, invalid_flows FROM (
        SELECT capture_id, count(*) AS packets, count(*) FILTER (fate = 'kept') AS kept, count(*) FILTER (fate = 'late') AS late_packets,
          count(*) FILTER (fate = 'dropped') AS packets_dropped, 0::BIGINT AS untimed_packets FROM fated GROUP BY ALL) p LEFT JOIN (
        SELECT capture_id, count(DISTINCT bucket) AS windows, count(*) AS flows, count(*) FILTER (ttl IS NULL) AS invalid_flows
        FROM in_time GROUP BY ALL) f USING (capture_id)""", arrived=arrival, fated=fate, in_time=in_time)
    o["w5_packet_cap"] = sql("""SELECT capture_id, bucket, count(*) FILTER (nth <= 40) AS kept, count(*) FILTER (nth > 40) AS dropped FROM (
      SELECT capture_id, bucket, row_number() OVER (PARTITION BY capture_id, bucket ORDER BY frame_no) AS nth FROM pw) GROUP BY ALL""")

    o["j1_reverse_flow"] = sql(f"SELECT {KEYS}, total_bytes, reverse_bytes FROM kept")
    o["j2_flow_context"] = sql(f"SELECT k.{KEYS.replace(', ', ', k.')}, w.window_fanout, round(t.target_pkt_rate, 9) AS target_pkt_rate FROM kept k LEFT JOIN fan w USING (capture_id, bucket, src_ip) LEFT JOIN target t USING (capture_id, bucket, dst_ip, dst_port, protocol)")
    o["j3_ioc_flows"] = sql(f"SELECT {KEYS}, own_ja4 FROM totals WHERE own_ja4 IN {IOC}")
    o["j4_label_join"] = """SELECT raw, dataset, CASE WHEN raw = 'benign' THEN 'benign' WHEN raw = 'dga' AND dataset = 'dns' THEN 'dga_dns_tunneling'
        WHEN raw = 'Scanning' AND dataset = 'iot23' THEN 'recon_scanning' WHEN raw = 'Tunneling ' AND dataset IN ('dns', 'iot23') THEN 'dga_dns_tunneling'
        WHEN raw = 'syn' AND dataset = 'cicddos2019' THEN 'volumetric_ddos' ELSE 'UNMATCHED' END AS threat_class, count(*) AS n FROM (
        SELECT CASE event_type WHEN 'click' THEN 'benign' WHEN 'view' THEN 'dga' WHEN 'error' THEN 'Scanning' WHEN 'signup' THEN 'Tunneling ' ELSE 'syn' END AS raw,
          ['dns', 'iot23', 'cicddos2019'][user_id % 3 + 1] AS dataset FROM events) GROUP BY ALL"""
    o["j5_layer_zip"] = sql("SELECT flow_id, capture_id, 4 AS layers, round(rules_p + stats_p + iso_p + xgb_p, 6) AS total FROM fused")
    o["j6_partition_leaks"] = """SELECT kind, value, count(DISTINCT part) AS partitions FROM (
        SELECT 'group' AS kind, source AS value, 'p' || doc_id % 3 AS part FROM documents
        UNION ALL SELECT 'source_sha256', sha256(text), 'p' || doc_id % 3 FROM documents) GROUP BY ALL HAVING count(DISTINCT part) > 1"""
    o["j7_bin_join"] = sql("""SELECT bin, count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'c') AS c FROM (
      SELECT side, greatest(0, least(9, CAST(floor((score - lo) / ((hi - lo) / 10)) AS INTEGER))) AS bin FROM (SELECT 'b' AS side, score FROM ref_scores UNION ALL SELECT 'c', score FROM cur_scores),
      (SELECT min(score) AS lo, max(score) AS hi FROM ref_scores)) GROUP BY ALL""")

    o["d1_rules"] = sql("SELECT flow_id, capture_id, round(rules_raw, 6) AS raw_score, round(rules_p, 6) AS probability, rules_guess AS threat_class FROM rules")
    o["d2_baseline"] = sql("SELECT " + ", ".join(f"round({c}, 6) AS {c}" for i in range(1, 7) for c in (f"m{i}", f"s{i}")) + " FROM baseline")
    o["d3_zscore"] = sql("SELECT flow_id, capture_id, round(stats_raw, 6) AS raw_score, round(stats_p, 6) AS probability FROM stats")
    o["f1_consensus"] = sql("SELECT flow_id, capture_id, threat_class, agreeing AS corroborating_layers FROM fused WHERE kind = 'named'")
    o["f2_corroboration"] = sql("""SELECT flow_id, capture_id, agreeing AS corroborating_layers FROM fused WHERE kind = 'named' AND n_strong > 0
      AND (rules_guess IS NULL OR xgb_guess IS NULL OR rules_guess = xgb_guess)""")
    o["f3_anomaly_route"] = sql("SELECT flow_id, capture_id, threat_class, n_strong AS layers FROM fused WHERE kind = 'anomaly'")
    o["f4_confidence"] = sql("SELECT flow_id, capture_id, round(confidence_score, 6) AS confidence_score, tier FROM fused")
    o["f5_gate"] = sql("SELECT flow_id, capture_id, threat_class, tier FROM fused WHERE is_actionable")
    o["f8_benign_consensus"] = sql("SELECT flow_id, capture_id FROM four WHERE rules_guess IS NULL AND rules_raw <= 0.5 AND stats_raw <= 0.5 AND 1 - xgb_p >= 0.5 AND NOT (1 - xgb_p < 0.5) AND iso_raw <= 0.99")
    o["t1_stream_windows"] = sql(f"SELECT capture_id, bucket, count(*) AS n FROM pw WHERE (bucket + 1) * {DAY} <= (SELECT max(ts_us) FROM pw) GROUP BY ALL")
    o["t2_beacon_state"], o["t2_fanout_state"], o["t2_fingerprint_state"] = (o[k] for k in ("w1_beacon_interval", "w2_horizon_fanout", "w3_carried_ja4"))
    o["t3_state_bounds"] = sql(f"""
SELECT capture_id, src_ip, count(*) AS sightings, sum(least(3, n))::BIGINT AS held, max(least(3, n)) AS most_held,
  count(*) FILTER (fresh AND others >= 3) AS evictions
FROM (
  SELECT q.capture_id, q.src_ip, q.k, count(DISTINCT s.target) AS n,
    count(DISTINCT s.target) FILTER (s.target <> q.target) AS others,
    coalesce(max(s.k) FILTER (s.target = q.target AND s.k < q.k), -1) AS own,
    own = -1 OR count(DISTINCT s.target) FILTER (s.target <> q.target AND s.k > q.own_k) >= 3 AS fresh
  FROM (SELECT *, coalesce(max(k) FILTER (TRUE) OVER (PARTITION BY capture_id, src_ip, target ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS own_k FROM seen) q
  JOIN seen s ON q.capture_id = s.capture_id AND q.src_ip = s.src_ip AND s.k <= q.k AND s.ts >= q.ts - {7 * DAY}
  GROUP BY q.capture_id, q.src_ip, q.k)
GROUP BY ALL""", seen="""SELECT capture_id, src_ip, dst_ip || ':' || dst_port AS target, first_ts_us AS ts,
  row_number() OVER (PARTITION BY capture_id, src_ip ORDER BY first_ts_us, first_frame) AS k FROM kept""")
    o["t4_late_data"] = sql(f"""
SELECT capture_id, bucket, count(*) AS n FROM judged WHERE NOT late AND bucket < reached GROUP BY ALL
UNION ALL SELECT 'late', NULL, count(*) FROM judged WHERE late""",
      sliced="""SELECT *, least(2, least(2, (ts_us - lo) * 3 // (hi - lo + 1)) + ((frame_no % 1000000000) % 20 = 0)::INT) AS slice
        FROM pw, (SELECT min(ts_us) AS lo, max(ts_us) AS hi FROM pw)""",
      judged=f"""SELECT s.*, coalesce(s.bucket < (SELECT max(ts_us) // {DAY} FROM sliced e WHERE e.capture_id = s.capture_id AND e.slice < s.slice), FALSE) AS late,
        max(ts_us // {DAY}) OVER (PARTITION BY capture_id) AS reached FROM sliced s""")
    o["t5_stream_alerts"] = sql("SELECT flow_id, threat_class, round(confidence_score, 6) + 0.0 AS confidence_score FROM fused WHERE is_actionable")
    o["f6_calibration_fit"] = sql(f"""SELECT count(*) AS n, count(*) FILTER (threat_class = {TRUTH}) AS n_right, TRUE AS at_minimum FROM fused""")
    o["f7_calibration_apply"] = sql("""SELECT flow_id, capture_id,
      round(1 / (1 + exp(-(0.125 + 1.5 * confidence_score - 0.5 * rules_raw + 0.25 * stats_raw + 0.75 * iso_raw - xgb_p))), 6) + 0.0 AS confidence_score FROM fused""")
    draw = lambda s: f"((('0x' || substr(md5(concat_ws(':', flow_id, copy, 0, {s})), 1, 13))::BIGINT + 0.5) / 4503599627370496)"
    o["p14_jitter"] = sql(f"""SELECT CASE WHEN copy > 0 THEN flow_id || '_j' || (copy - 1) ELSE flow_id END AS flow_id, capture_id, copy,
      round(CASE WHEN copy > 0 THEN greatest(0, size_mean * scale) ELSE size_mean END, 6) + 0.0 AS size_mean,
      round(CASE WHEN copy > 0 THEN least(8, greatest(0, entropy * scale)) ELSE entropy END, 6) + 0.0 AS entropy,
      round(CASE WHEN copy > 0 THEN least(1, greatest(0, byte_ratio * scale)) ELSE byte_ratio END, 6) + 0.0 AS byte_ratio
      FROM (SELECT *, 1 + 0.05::DOUBLE * sqrt(-2 * ln({draw(1)})) * cos({draw(2)} * 6.283185307179586::DOUBLE) AS scale
        FROM flows CROSS JOIN (SELECT unnest(range(5))::INT AS copy) WHERE dst_port = 80)""")
    o["d4_forest_fit"] = sql("SELECT count(*) AS n, 100 AS trees, TRUE AS share_below_offset FROM flows WHERE dst_port = 80")
    o["d5_forest_score"] = sql("""SELECT flow_id, capture_id, round(raw, 6) + 0.0 AS raw, round(1 / (1 + exp(-5 * (raw - 0.6))), 6) + 0.0 AS p FROM (
      SELECT *, least(1, greatest(0, ((pow(2, -((CASE WHEN entropy > 4 THEN 2 ELSE 1 END + CASE WHEN coalesce(size_mean, 0) > 100 THEN 3 ELSE 1.5 END) / 2) / 2.0) - 0.5) / 0.4 + 1) / 2)) AS raw
      FROM flows)""")
    o["d6_classifier_fit"] = sql(f"SELECT {TRUTH} AS class, count(*) AS n, TRUE AS learned FROM flows GROUP BY ALL")
    o["d6_boosted_layer"] = o["d6_classifier_fit"]
    o["d6_boosted_fit"] = """WITH d AS (SELECT l_returnflag || l_linestatus AS label, l_quantity::DOUBLE AS l_quantity, l_discount::DOUBLE AS l_discount, l_tax::DOUBLE AS l_tax FROM lineitem),
      c AS (SELECT label AS class, count(*) AS n, count(*) OVER () AS k, (SELECT count(*) FROM d) AS total FROM d GROUP BY label),
      u AS (SELECT label, feature, v, count(*) AS n FROM d UNPIVOT (v FOR feature IN (l_quantity, l_discount, l_tax)) GROUP BY ALL),
      s AS (
        SELECT c.class, feature, v, sum(u.n * o.total / (o.k * o.n) * (1 / o.k::DOUBLE - (u.label = c.class)::INT)) AS g,
          sum(u.n * o.total / (o.k * o.n) * 2 / o.k::DOUBLE * (1 - 1 / o.k::DOUBLE)) AS h
        FROM u JOIN c o ON o.class = u.label, c GROUP BY ALL),
      r AS (SELECT *, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER (PARTITION BY class, feature) AS ga, sum(h) OVER (PARTITION BY class, feature) AS ha
        FROM s WINDOW w AS (PARTITION BY class, feature ORDER BY v)),
      q AS (SELECT *, gl * gl / (hl + 1) + (ga - gl) * (ga - gl) / (ha - hl + 1) - ga * ga / (ha + 1) AS gain FROM r WHERE hl >= 1 AND ha - hl >= 1)
      SELECT class, feature, round(v, 6) AS cut, round(-0.1 * gl / (hl + 1), 4) AS left, round(-0.1 * (ga - gl) / (ha - hl + 1), 4) AS right
      FROM q QUALIFY row_number() OVER (PARTITION BY class ORDER BY gain DESC) = 1"""
    o["d7_classifier_predict"] = sql("""SELECT flow_id, capture_id, CASE WHEN benign < 0.5 THEN CASE WHEN dst_port % 2 = 0 THEN 'volumetric_ddos' ELSE 'c2_beaconing' END END AS guess,
      round(1 - benign, 6) + 0.0 AS raw FROM (SELECT *, ((bucket * 7 + src_port + dst_port) % 10) / 10.0::DOUBLE AS benign FROM flows)""")
    o["d8_all_layers"] = sql("SELECT flow_id, capture_id, round(rules_raw, 6) + 0.0 AS rules_raw, TRUE AS stats_in_range, TRUE AS isoforest_in_range, TRUE AS xgb_in_range FROM rules")
    o["e5_cross_validation"] = sql(f"SELECT {TRUTH} AS class, count(*) AS n, TRUE AS in_order, TRUE AS learned FROM flows GROUP BY ALL")
    o["e7_binary_anomaly"] = sql(f"SELECT CASE WHEN {TRUTH} = 'benign' THEN 'benign' ELSE 'anomalous' END AS class, count(*) AS support, TRUE AS in_range FROM flows GROUP BY ALL")
    o["e8_external_evaluation"] = sql("""SELECT class, count(e.event_id) AS support, TRUE AS in_range FROM mark_classes LEFT JOIN lenient e USING (class) GROUP BY ALL""",
      lenient=LENIENT_LABELS)
    o["e10_candidate"] = sql(f"""SELECT class, count(f.flow_id) AS support, TRUE AS in_range FROM mark_classes
      LEFT JOIN (SELECT {TRUTH} AS class, flow_id FROM flows WHERE bucket % 3 = 2) f USING (class) GROUP BY ALL""")
    o["dr6_bounded_retrain"] = sql(f"SELECT count(*) AS candidates, TRUE AS consistent, TRUE AS repeats FROM flows WHERE bucket % 2 = 1 AND {TRUTH} = 'benign'")

    o["ch1_chain_verify"] = sql("""SELECT capture_id AS chain_id, count(*) AS entries, FALSE AS intact, 5 AS first_break FROM fused WHERE is_actionable GROUP BY ALL""")
    o["ch2_chain_append"] = sql("""SELECT capture_id AS chain_id, count(*) AS entries, TRUE AS intact, count(*) - 1 AS last_seq, repeat('0', 64) AS genesis FROM fused WHERE is_actionable GROUP BY ALL""")
    text = lambda x: f"strlen({x}) || ':' || {x}"
    fields = ["epoch_us(ts)::VARCHAR", "event_id::VARCHAR", "event_type", "round(value * 100)::BIGINT::VARCHAR"]
    listed = f"({text('event_type')} || ',' || {text('props')})"
    body = " || '|' || ".join(text(f"({x})") for x in [*fields, listed])
    links = f"""WITH RECURSIVE a AS (
      SELECT (user_id % 4)::VARCHAR AS chain_id, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS position, sha256({body}) AS content FROM events),
    e AS (
      SELECT chain_id, position, sha256('0|' || repeat('0', 64) || '|' || content) AS hash FROM a WHERE position % 250 = 0
      UNION ALL SELECT a.chain_id, a.position, sha256((a.position % 250)::VARCHAR || '|' || e.hash || '|' || a.content)
      FROM e JOIN a ON a.chain_id = e.chain_id AND a.position = e.position + 1 WHERE a.position % 250 <> 0),
    h AS (SELECT chain_id, position // 250 AS segment, count(*) AS entries, arg_max(hash, position) AS head FROM e GROUP BY ALL),
    l AS (
      SELECT *, repeat('0', 64) AS prev_link, sha256(repeat('0', 64) || '|0|' || entries || '|' || head) AS link FROM h WHERE segment = 0
      UNION ALL SELECT h.*, l.link, sha256(l.link || '|' || h.segment || '|' || h.entries || '|' || h.head)
      FROM l JOIN h ON h.chain_id = l.chain_id AND h.segment = l.segment + 1)
    """
    o["ch2_segmented_chain"] = links + "SELECT chain_id, segment, entries, head, prev_link, link FROM l"
    o["ch1_segmented_verify"] = """SELECT (user_id % 4)::VARCHAR AS chain_id, count(*) - (user_id % 4 = 2 AND count(*) >= 250)::INT AS entries,
      NOT ((user_id % 4 = 1 AND count(*) > 300) OR (user_id % 4 = 2 AND count(*) >= 250)) AS intact,
      CASE WHEN user_id % 4 = 1 AND count(*) > 300 THEN 1 WHEN user_id % 4 = 2 AND count(*) >= 250 THEN 0 END AS first_broken_segment
      FROM events GROUP BY user_id % 4"""
    o["ch3_retention"] = sql("""SELECT capture_id AS chain_id, least(count(*), 25) AS kept, greatest(count(*) - 25, 0) AS oldest_seq FROM fused WHERE is_actionable GROUP BY ALL""")

    o["dr1_psi"] = sql("""SELECT round(sum(((c + 0.5) / (nc + 5) - (b + 0.5) / (nb + 5)) * ln(((c + 0.5) / (nc + 5)) / ((b + 0.5) / (nb + 5)))), 6) AS psi FROM (
      SELECT *, sum(b) OVER () AS nb, sum(c) OVER () AS nc FROM (SELECT bin, count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'c') AS c FROM (
        SELECT side, greatest(0, least(9, CAST(floor((score - lo) / ((hi - lo) / 10)) AS INTEGER))) AS bin FROM (SELECT 'b' AS side, score FROM ref_scores UNION ALL SELECT 'c', score FROM cur_scores),
        (SELECT min(score) AS lo, max(score) AS hi FROM ref_scores)) GROUP BY ALL))""")
    o["dr2_ks"] = sql("""SELECT round(max(abs(fb - fc)), 6) AS ks FROM (SELECT score, sum(b) OVER (ORDER BY score) / (SELECT count(*) FROM ref_scores) AS fb,
      sum(c) OVER (ORDER BY score) / (SELECT count(*) FROM cur_scores) AS fc FROM (
        SELECT score, count(*) FILTER (side = 'b') AS b, count(*) FILTER (side = 'c') AS c FROM (SELECT 'b' AS side, score FROM ref_scores UNION ALL SELECT 'c', score FROM cur_scores) GROUP BY ALL))""")
    binned = "SELECT event_type, event_id, epoch_us(ts) // 86400000000 AS day, greatest(0, least(9, CAST(floor((value - lo) / ((hi - lo) / 10)) AS INTEGER))) AS bin FROM events, (SELECT min(score) AS lo, max(score) AS hi FROM ref_scores)"
    base = "SELECT bin, count(*) AS b FROM (SELECT greatest(0, least(9, CAST(floor((score - lo) / ((hi - lo) / 10)) AS INTEGER))) AS bin FROM ref_scores, (SELECT min(score) AS lo, max(score) AS hi FROM ref_scores)) GROUP BY ALL"
    windows = "SELECT event_type, day, c, row_number() OVER (PARTITION BY event_type, day ORDER BY event_id DESC) AS back FROM (SELECT event_type, day, event_id, " + \
        "[" + ", ".join(f"count(*) FILTER (bin = {i}) OVER w" for i in range(10)) + "] AS c FROM binned WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))"
    o["dr3_rolling_drift"] = sql("""SELECT event_type, day, n, round(psi, 6) AS psi, round(ks, 6) AS ks, psi > 0.2 AS drifted FROM rolled JOIN apart USING (event_type, day)""",
      binned=binned, base=base, windows=windows,
      rolled="""SELECT event_type, day, CAST(list_sum(c) AS BIGINT) AS n, sum(((x + 0.5) / (list_sum(c) + 5) - (b + 0.5) / (nb + 5)) * ln(((x + 0.5) / (list_sum(c) + 5)) / ((b + 0.5) / (nb + 5)))) AS psi
      FROM (SELECT event_type, day, c, unnest(c) AS x, unnest(range(10)) AS bin FROM windows WHERE back = 1) JOIN (SELECT i AS bin, coalesce(b, 0) AS b FROM range(10) t(i) LEFT JOIN base ON base.bin = i) USING (bin),
      (SELECT count(*) AS nb FROM ref_scores) GROUP BY ALL""",
      nths="SELECT event_type, value, epoch_us(ts) // 86400000000 AS day, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS nth FROM events",
      tops="SELECT event_type, day, max(nth) AS top FROM nths GROUP BY ALL",
      marks="SELECT v, sum(b) OVER (ORDER BY v) AS upto, sum(b) OVER (ORDER BY v) - b AS below FROM (SELECT v, sum(b) AS b FROM (SELECT score AS v, 1 AS b FROM ref_scores UNION ALL SELECT value, 0 FROM events) GROUP BY v)",
      apart="""SELECT event_type, day, max(greatest(abs(upto / nb - pos / m), abs(below / nb - (pos - same) / m))) AS ks FROM (
        SELECT t.event_type, t.day, upto, below, count(*) OVER (PARTITION BY t.event_type, t.day ORDER BY v) AS pos,
          count(*) OVER (PARTITION BY t.event_type, t.day, v) AS same, count(*) OVER (PARTITION BY t.event_type, t.day) AS m
        FROM tops t JOIN nths s ON s.event_type = t.event_type AND s.nth <= t.top AND s.nth > t.top - 200 JOIN marks ON marks.v = s.value),
        (SELECT count(*) AS nb FROM ref_scores) GROUP BY ALL""")
    o["dr4_fixed_reference"] = sql("SELECT count(*) AS n, round(sum(score), 3) AS total FROM ref_scores")
    o["dr5_candidate_pool"] = "SELECT event_id, value FROM events ORDER BY event_id DESC LIMIT 5000"

    o["e1_confusion"] = sql("SELECT truth, predicted, count(*) AS n FROM doc_marks GROUP BY ALL")
    o["e1_confusion_matrix"] = sql("SELECT truth, " + ", ".join(f"count(*) FILTER (predicted = '{c}') AS {c}" for c in (
        "benign", "volumetric_ddos", "c2_beaconing", "dga_dns_tunneling", "encrypted_malware", "recon_scanning", "data_exfiltration")) + " FROM doc_marks GROUP BY ALL")
    o["e2_class_metrics"] = sql("SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM mark_metrics")
    o["e3_macro"] = sql("""SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
      (SELECT round(avg((truth = predicted)::INT), 6) FROM doc_marks) AS accuracy, (SELECT count(*) FROM doc_marks) AS n FROM mark_metrics WHERE support > 0""")
    o["e4_benign_brier"] = sql("""SELECT round(count(*) FILTER (truth = 'benign' AND predicted <> 'benign') / count(*) FILTER (truth = 'benign'), 6) AS fpr,
      round(avg(((truth = predicted)::INT - confidence) ** 2), 6) AS brier FROM doc_marks""")
    o["e4_unvalidated"] = sql("SELECT class FROM mark_classes WHERE class <> 'benign' AND class NOT IN (SELECT truth FROM doc_marks)")
    o["e5_folds"] = sql("""SELECT truth, CAST((nth - 1) % 5 AS INTEGER) AS fold, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (
      SELECT truth, doc_id, row_number() OVER (PARTITION BY truth ORDER BY doc_id) AS nth FROM doc_marks) GROUP BY ALL""")
    o["e6_distinct_ratio"] = """SELECT count(*) AS distinct_rows, CAST(sum(n) AS BIGINT) AS all_rows, round(count(*) / sum(n), 6) AS ratio FROM (
        SELECT l_quantity, l_discount, l_tax, count(*) AS n FROM lineitem GROUP BY ALL)"""
    o["e9_scenarios"] = sql("""SELECT scenario, predicted, n, round((SELECT count(*) FILTER (m.truth = m.predicted) / count(*) FROM doc_marks m WHERE m.truth = scenario), 6) AS expected_label_fraction
      FROM (SELECT truth AS scenario, predicted, count(*) AS n FROM doc_marks GROUP BY ALL)""")
    o["e11_percentiles"] = """SELECT fraction, value FROM (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM events) v
      JOIN (SELECT f AS fraction, CAST(round_even(f * ((SELECT count(*) FROM events) - 1), 0) AS BIGINT) AS i FROM (VALUES (0.5::DOUBLE), (0.95::DOUBLE), (0.99::DOUBLE), (1.0::DOUBLE)) t(f)) p USING (i)"""
    o["e11_latency_headroom"] = "SELECT *, round(greatest(0, 1 - p95_ms / 1000), 9) AS headroom FROM (SELECT " + ", ".join(
        f"max(value) FILTER (fraction = {p}) AS p{name}_ms" for p, name in ((0.5, 50), (0.95, 95), (0.99, 99))) + f" FROM ({o['e11_percentiles']}))"
    o["e11_throughput"] = """SELECT round(avg(r), 6) AS throughput, round(stddev_samp(r), 6) AS throughput_std, round(avg(r) * 0.12, 6) AS flows_per_window FROM (
        SELECT n / s AS r FROM (SELECT event_type, count(*) AS n, sum(value) / 1000 AS s FROM events GROUP BY ALL))"""
    o["e12_train_test"] = """SELECT part, label, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM (
        SELECT vec_id, 'benign' AS label, CASE WHEN row_number() OVER (ORDER BY vec_id) <= (SELECT count(*) FROM embeddings WHERE label < 4) // 2 THEN 'train' ELSE 'test' END AS part FROM embeddings WHERE label < 4
        UNION ALL SELECT vec_id, 'recon_scanning', 'train' FROM embeddings WHERE label BETWEEN 4 AND 6
        UNION ALL SELECT vec_id, 'recon_scanning', 'test' FROM embeddings WHERE label > 6) GROUP BY ALL"""
    o["flow_records"] = sql(FLOW_OUT)
    o["detect_summary"] = sql("""SELECT threat_class, tier, is_actionable, count(*) AS n, round(avg(confidence_score), 6) AS confidence FROM fused GROUP BY ALL""")


_fill()
