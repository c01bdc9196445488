"""Values that results depend on literally: line grammars, lookup tables, cuts.

Everything in this module is data. Change an entry and results change; no
other module repeats any of these values.
"""

# ---------------------------------------------------------------------------
# FIXED VALUES: line grammars (regular expressions, numbered capture groups)
# ---------------------------------------------------------------------------

# Archived alert logs. Searched anywhere in the line.
# groups: timestamp, sig_id, signature, alert_category, priority, protocol,
#         src_ip, src_port, dst_ip, dst_port
ARCHIVE_LINE_PATTERN = (
    r"(\d{2}/\d{2}/\d{4}-\d{2}:\d{2}:\d{2}\.\d+)"
    r"\s+\[\*\*\]\s+\[\d+:(\d+):\d+\]\s+(.+?)\s+\[\*\*\]"
    r".*?\[Classification:\s*([^\]]+)\]"
    r".*?\[Priority:\s*(\d+)\]"
    r"\s+\{(\w+)\}"
    r"\s+([\d.]+):(\d+)\s+->\s+([\d.]+):(\d+)"
)
ARCHIVE_LINE_GROUPS = (
    "timestamp", "sig_id", "signature", "alert_category", "priority",
    "protocol", "src_ip", "src_port", "dst_ip", "dst_port",
)

# Live alert feed. Must match from the first non-blank character.
# groups: timestamp, signature, classification_suricata, priority, protocol,
#         src_ip, src_port, dst_ip, dst_port
LIVE_LINE_PATTERN = (
    r"(\S+)\s+\[\*\*\]\s+\[[^\]]+\]\s+(.+?)\s+\[\*\*\]\s+"
    r"\[Classification:\s*([^\]]+)\]\s+"
    r"\[Priority:\s*(\d+)\]\s+"
    r"\{([^\}]+)\}\s+"
    r"([\d.]+):(\d+)\s+->\s+([\d.]+):(\d+)"
)
LIVE_LINE_GROUPS = (
    "timestamp", "signature", "classification_suricata", "priority",
    "protocol", "src_ip", "src_port", "dst_ip", "dst_port",
)

# Spark date pattern of the alert timestamp text.
ALERT_TIMESTAMP_FORMAT = "MM/dd/yyyy-HH:mm:ss.SSSSSS"

# ---------------------------------------------------------------------------
# FIXED VALUES: attack types, tried in this order against the lower-cased
# signature; the first pattern found wins.
# ---------------------------------------------------------------------------
ATTACK_TYPE_PATTERNS = (
    (r"nmap|port.?scan|fin.?stealth|xmas|null.?scan|udp.?scan|syn.?scan|ack.?scan|window.?scan|os.?detect", "port_scan"),
    (r"hydra|brute.?force|ftp.?brute|ssh.?brute|login.?attempt|password.?spray", "brute_force"),
    (r"slowloris|http.?dos|dos|flood|syn.?flood", "dos"),
    (r"nikto|web.?scan|web.?application.?scan|sql.?inject|xss|directory.?trav", "web_scan"),
    (r"smb|netbios|rdp|exploit|shellcode|overflow|ms17", "exploit"),
    (r"trojan|malware|botnet|c2|c&c|beacon|rat\b", "malware_c2"),
    (r"icmp|ping.?sweep|arp", "info_leak"),
    (r"et.?info|et.?policy|dns", "info_leak"),
)
OTHER_ATTACK = "other"

# Kill-chain stage of each attack type.
KILL_CHAIN_STAGES = {
    "port_scan": "Reconnaissance",
    "web_scan": "Reconnaissance",
    "info_leak": "Reconnaissance",
    "brute_force": "Exploitation",
    "exploit": "Exploitation",
    "dos": "Actions on Objectives",
    "malware_c2": "Command & Control",
    "other": "Unknown",
}
UNKNOWN_STAGE = "Unknown"

# Kill-chain steps of an attacker profile: any listed type adds the step.
PROFILE_STEPS = (
    ("Reconnaissance", ("port_scan",)),
    ("Credential Attack", ("brute_force",)),
    ("Web Exploitation", ("web_scan", "web_attack")),
    ("Disruption", ("dos",)),
    ("Exploitation", ("exploit",)),
)

# Display labels of attack types.
ATTACK_LABELS = {
    "port_scan": "Port Scan",
    "brute_force": "Brute Force",
    "dos": "DoS",
    "web_scan": "Web Scan",
    "exploit": "Exploit",
    "web_attack": "Web Attack",
    "other": "Other",
}

# Verdict each test signature should receive.
EXPECTED_VERDICTS = (
    ("NMAP SYN Scan Detected", "hack"),
    ("NMAP FIN Stealth Scan", "hack"),
    ("FTP Brute Force Attempt", "hack"),
    ("HTTP DoS Attack Detected", "hack"),
    ("Slowloris DoS Attack", "hack"),
    ("Web Application Scan Detected", "hack"),
    ("SURICATA Applayer Detect protocol only one direction", "normal"),
    ("SURICATA SMB malformed request dialects", "hack"),
)

# ---------------------------------------------------------------------------
# FIXED VALUES: false-positive score
# ---------------------------------------------------------------------------
NOISE_PREFIX, NOISE_PREFIX_POINTS = "SURICATA", 40
LOW_PRIORITY, LOW_PRIORITY_POINTS = 3, 30
INFORMATIONAL_PATTERN, INFORMATIONAL_POINTS = r"(?i)ET\s*(INFO|POLICY)", 20
NO_TRAFFIC_POINTS = 10
MAX_LIKELIHOOD = 100
FALSE_POSITIVE_FROM = 60

# FIXED VALUES: cuts used by the reports
SUPPRESS_FROM = 70
AMBER_FROM = 40
CRITICAL_RISK = 8
WARNING_RISK = 5
SEVERE_RISK = 7
PASS_ACCURACY = 80
WARN_ACCURACY = 50
NEWEST_ROWS = 500
FEED_ROWS = 60
MIN_REPEAT_HACKS = 2
LINUX_MAX_TTL, WINDOWS_MAX_TTL, DEVICE_MAX_TTL = 64, 128, 255

# FIXED VALUES: what is stored when a verdict lacks a key ...
VERDICT_DEFAULTS = {
    "classification": "error",
    "attack_type": "unknown",
    "explanation": "",
    "risk_score": 5,
    "false_positive_likelihood": 50,
}
# ... and when no verdict could be obtained at all.
VERDICT_FALLBACK = {**VERDICT_DEFAULTS, "explanation": "API unreachable"}

# ---------------------------------------------------------------------------
# FIXED VALUES: column order of the labelled dataset
# ---------------------------------------------------------------------------
DATASET_COLUMNS = (
    "timestamp", "signature", "sig_id", "interface",
    "src_ip", "dst_ip", "src_port", "dst_port",
    "protocol", "priority", "alert_category",
    "app_proto", "direction",
    "flow_bytes", "flow_bytes_toserver", "flow_bytes_toclient",
    "pkts_toserver", "pkts_toclient", "flow_duration",
    "http_user_agent", "payload_printable",
    "ground_truth", "fp_likelihood",
    "attack_type", "kill_chain_stage",
)

# Shown for a key that an assessor's answer lacks.
NO_ANSWER = "—"
