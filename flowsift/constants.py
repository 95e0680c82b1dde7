"""Fixed values that results depend on."""

# Capture window, behavioural horizons and per-key history sizes.
WINDOW_US = 120_000
HORIZON_US = 300 * 1_000_000
BEACON_LOOKBACK_US = 1200 * 1_000_000
BEACON_ARRIVALS = 64
WINDOW_PACKET_CAP = 4096

# Threat classes; "benign" leads wherever a class index is needed.
THREAT_CLASSES = [
    "volumetric_ddos",
    "c2_beaconing",
    "dga_dns_tunneling",
    "encrypted_malware",
    "recon_scanning",
    "data_exfiltration",
]
BENIGN = "benign"
ALL_CLASSES = [BENIGN] + THREAT_CLASSES
LAYERS = ["rules", "stats", "isoforest", "xgb"]

# Ports used by the rule layer.
SUSPICIOUS_PORTS = [4444, 5555, 6666, 6667, 6668, 6669, 7777, 8888, 9999, 27373, 27374, 31337]
SAFE_PORTS = [22, 23, 25, 53, 80, 110, 143, 443, 465, 587, 993, 995, 3306, 5432, 8080]
DNS_PORTS = [53, 853, 5353, 5355]

# TLS client fingerprints on the indicator list.
MALICIOUS_JA4 = [
    "t13d1200h1_5b20,21,35_00",
    "t13d1618h0_002f,00-02-01_1301-1302-1303-1201-1200_000b-000a-0009-0008_0016,_45,1",
    "t13i050200_e133e205ac38_000000000000",
    "t13i040200_002f1301c02f_000000000000",
    "t12i040400_002fc02fc030_000000000000",
    "t13i050100_e133e205ac38_b9a491fefe05",
]

# DNS query type codes with a name; any other code is kept as it is.
DNS_TYPES = {
    "1": "A",
    "2": "NS",
    "5": "CNAME",
    "6": "SOA",
    "12": "PTR",
    "15": "MX",
    "16": "TXT",
    "28": "AAAA",
    "33": "SRV",
    "255": "ANY",
}

# TLS version codes and their two-character names.
TLS_VERSIONS = {
    0x0304: "13",
    0x0303: "12",
    0x0302: "11",
    0x0301: "10",
    0x0300: "s3",
    0x0002: "s2",
}

# Exact label policy per labelled dataset. Labels absent here are UNMATCHED.
UNMATCHED = "UNMATCHED"
LABEL_POLICY = {
    "cicddos2019": {
        "benign": "benign",
        "dns": "volumetric_ddos",
        "ldap": "volumetric_ddos",
        "mssql": "volumetric_ddos",
        "netbios": "volumetric_ddos",
        "ntp": "volumetric_ddos",
        "portmap": "volumetric_ddos",
        "snmp": "volumetric_ddos",
        "syn": "volumetric_ddos",
        "tftp": "volumetric_ddos",
        "udp": "volumetric_ddos",
        "udplag": "volumetric_ddos",
        "webddos": "volumetric_ddos",
        "drdo": "volumetric_ddos",
    },
    "cicids2017": {
        "benign": "benign",
        "ddos": "volumetric_ddos",
        "dos hulk": "volumetric_ddos",
        "dos goldeneye": "volumetric_ddos",
        "dos slowloris": "volumetric_ddos",
        "dos slowhttptest": "volumetric_ddos",
        "portscan": "recon_scanning",
    },
    "iot23": {
        "benign": "benign",
        "c&c-heartbeat": "c2_beaconing",
        "ddos": "volumetric_ddos",
        "partofahorizontalportscan": "recon_scanning",
        "scanning": "recon_scanning",
        "tunelling": "dga_dns_tunneling",
        "tunneling": "dga_dns_tunneling",
    },
    "dns": {
        "benign": "benign",
        "normal": "benign",
        "dga": "dga_dns_tunneling",
        "tunneling": "dga_dns_tunneling",
        "tunnelling": "dga_dns_tunneling",
        "dns tunnel": "dga_dns_tunneling",
    },
}

# Substring label policy; the first class with a matching fragment wins.
SUBSTRING_POLICY = [
    ("benign", ["benign", "normal", "background"]),
    ("volumetric_ddos", ["ddos", "dos ", "dos-", "dos_", "hulk", "goldeneye", "slowloris", "slowhttptest", "rudy"]),
    ("c2_beaconing", ["botnet", "bot", "c&c", "cc ", "irc"]),
    ("dga_dns_tunneling", ["dns", "tunnel", "dga"]),
    ("encrypted_malware", ["infiltration", "heartbleed", "backdoor", "shellcode", "worms", "malware"]),
    ("recon_scanning", ["portscan", "port scan", "scan", "reconnaissance", "probe", "analysis"]),
    ("data_exfiltration", ["exfil", "web attack", "sql injection", "xss", "brute force", "brute-force",
                           "ftp-patator", "ssh-patator"]),
]

# Header spellings of labelled CSV files, by canonical column.
CSV_ALIASES = {
    "dst_port": ["destination port", "dst port", "dsport", "id.resp_p"],
    "protocol": ["protocol", "proto"],
    "fwd_pkts": ["total fwd packets", "tot fwd pkts", "spkts"],
    "fwd_bytes": ["total length of fwd packets", "totlen fwd pkts", "sbytes"],
    "fwd_iat_mean": ["fwd iat mean"],
    "fwd_iat_std": ["fwd iat std"],
    "flow_iat_mean": ["flow iat mean"],
    "flow_iat_std": ["flow iat std"],
    "fwd_len_mean": ["fwd packet length mean", "fwd pkt len mean"],
    "fwd_len_std": ["fwd packet length std", "fwd pkt len std"],
    "fwd_len_min": ["fwd packet length min", "fwd pkt len min"],
    "fwd_len_max": ["fwd packet length max", "fwd pkt len max"],
    "flow_duration": ["flow duration", "dur"],
    "ttl": ["sttl", "fwd ttl"],
    "syn_count": ["syn flag count", "syn flag cnt"],
    "label": ["label", "attack_cat", "attack category", "class"],
    "dns_query": ["query", "qname", "dns.qry.name"],
    "dns_type": ["qtype", "dns.qry.type", "type"],
}

# Header spellings for the lenient CSV-to-flow source (after "_" and "-" become blanks).
LENIENT_ALIASES = {
    "dst_port": ["destination port", "dst port", "dsport", "id.resp_p"],
    "protocol": ["protocol", "proto"],
    "flow_duration": ["flow duration", "dur"],
    "fwd_packets": ["total fwd packets", "tot fwd pkts", "spkts"],
    "fwd_bytes": ["total length of fwd packets", "totlen fwd pkts", "sbytes"],
    "fwd_pkt_len_mean": ["fwd packet length mean", "fwd pkt len mean", "smeansz"],
    "fwd_pkt_len_std": ["fwd packet length std", "fwd pkt len std"],
    "fwd_pkt_len_min": ["fwd packet length min", "fwd pkt len min"],
    "fwd_pkt_len_max": ["fwd packet length max", "fwd pkt len max"],
    "fwd_iat_mean": ["fwd iat mean", "flow iat mean"],
    "fwd_iat_std": ["fwd iat std", "flow iat std"],
    "ttl": ["fwd header length", "sttl"],
    "label": ["label", "attack_cat", "attack category"],
}

# Zeek conn.log fields and the canonical column each one fills.
ZEEK_FIELDS = {
    "id.resp_p": "dst_port",
    "proto": "protocol",
    "duration": "flow_duration",
    "orig_pkts": "fwd_pkts",
    "orig_bytes": "fwd_bytes",
    "label": "label",
    "detailed-label": "label",
}

# Alert gate, corroboration, drift and retraining limits.
CORROBORATED_MIN = 0.5
ADVISORY_MIN = 0.70
UNSUPERVISED_MIN = 0.75
DRIFT_PSI = 0.2
RETRAIN_PSI = 0.35
RETRAIN_MIN_ROWS = 50
RETRAIN_MAX_ROWS = 5000
DRIFT_WINDOW = 500

GENESIS_HASH = "0" * 64
CHAIN_KEEP = 100_000

# Keywords that route an unnamed anomaly to a class; the first group found wins.
ANOMALY_ROUTES = [
    ("recon_scanning", ["fanout", "port", "scan", "targets"]),
    ("data_exfiltration", ["byte", "exfil", "upload", "outbound"]),
    ("dga_dns_tunneling", ["dns", "tunnel", "entropy", "query"]),
    ("volumetric_ddos", ["rate", "packet_count", "pps", "flood"]),
]

# What an exported observation of an outside data set says of itself.
OBSERVATION_TYPE = "external_observation"
OBSERVATION_MISSING = ["entropy", "byte_ratio", "ja4"]
OBSERVATION_NOTE = "Re-extract PCAP for inference; CSV definitions differ from 120ms windows"
