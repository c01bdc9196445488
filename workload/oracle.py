"""Reference SQL (DuckDB) for every query, on the same tables.

Written against the result definitions, not against the Spark code: lines are
rendered as text and parsed again with SQL regular expressions and JSON
functions.
"""

from __future__ import annotations

from palisade import fixed_values as fixed
from workload.binding import PORTS, SIGNATURES, TTLS


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_text(v) if isinstance(v, str) else str(v) for v in values) + "]"


def _case_map(table: dict[str, str], key: str, default: str) -> str:
    whens = " ".join(f"WHEN {_text(k)} THEN {_text(v)}" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {default} END"


_ATTACK_TYPE = (
    "CASE "
    + " ".join(
        f"WHEN regexp_matches(lower(signature), {_text(pattern)}) THEN {_text(label)}"
        for pattern, label in fixed.ATTACK_TYPE_PATTERNS
    )
    + " ELSE 'other' END"
)
_STAGE = _case_map(fixed.KILL_CHAIN_STAGES, "attack_type", "'Unknown'")
_LABEL = _case_map(fixed.ATTACK_LABELS, "attack_type", "attack_type")
_NOISE = (
    "(CASE WHEN upper(signature) LIKE 'SURICATA%' THEN 40 ELSE 0 END"
    " + CASE WHEN priority = 3 THEN 30 ELSE 0 END"
    " + CASE WHEN regexp_matches(signature, '(?i)ET\\s*(INFO|POLICY)') THEN 20 ELSE 0 END)"
)
_SCORE_NO_FLOWS = f"CAST(least({_NOISE} + 10, 100) AS BIGINT)"
_SCORE_FLOWS = f"CAST(least({_NOISE} + CASE WHEN flow_bytes = 0 THEN 10 ELSE 0 END, 100) AS BIGINT)"
_TRUTH = "CASE WHEN fp_likelihood >= 60 THEN 'false_positive' ELSE 'true_positive' END"

# Common table expressions, in dependency order.
_CTES = {
    "ev": f"""
        SELECT event_id, ts, "value", k,
               strftime(ts, '%m/%d/%Y-%H:%M:%S.%f') AS "timestamp",
               {_list(SIGNATURES)}[(event_id * 7 + k) % 15 + 1] AS signature,
               9000000 + (event_id * 7 + k) % 15 AS rule_id,
               'Class ' || (k % 5) AS category,
               '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS src_ip,
               '192.168.1.' || (event_id % 8) AS dst_ip,
               1024 + event_id % 50000 AS src_port,
               CAST({_list(PORTS)}[k % 8 + 1] AS BIGINT) AS dst_port,
               CASE WHEN k % 10 = 0 THEN 'UDP' ELSE 'TCP' END AS protocol,
               1 + ((event_id // 15) + k) % 3 AS priority
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""",
    "rendered": """
        SELECT event_id AS line,
               "timestamp" || '  [**] [1:' || rule_id || ':1] ' || signature || ' [**] '
               || CASE WHEN event_id % 40 = 7 THEN '[Extra: x] ' ELSE '' END
               || '[Classification: ' || category || '] '
               || CASE WHEN event_id % 50 = 49 THEN '' ELSE '[Priority: ' || priority || '] ' END
               || '{' || protocol || '} ' || src_ip || ':' || src_port || ' -> '
               || dst_ip || ':' || dst_port AS "value"
        FROM ev""",
    "lines": """
        SELECT "value", CASE WHEN line % 2 = 0 THEN 'OPT1' ELSE 'LAN' END AS interface,
               CAST(line % 2 AS INTEGER) AS source_rank, line FROM rendered
        UNION ALL
        SELECT "value", 'LAN', 1, line FROM rendered WHERE line % 25 = 0""",
    "parsed": f"""
        SELECT g."timestamp" AS "timestamp", g.sig_id, g.signature, g.alert_category,
               CAST(g.priority AS BIGINT) AS priority, g.protocol, g.src_ip,
               CAST(g.src_port AS BIGINT) AS src_port, g.dst_ip,
               CAST(g.dst_port AS BIGINT) AS dst_port, interface, source_rank, line
        FROM (SELECT *, regexp_extract("value", {_text(fixed.ARCHIVE_LINE_PATTERN)},
                                       {_list(fixed.ARCHIVE_LINE_GROUPS)}) AS g
              FROM lines
              WHERE regexp_matches("value", {_text(fixed.ARCHIVE_LINE_PATTERN)}))""",
    "live": f"""
        SELECT g."timestamp" AS "timestamp", g.signature, g.classification_suricata,
               CAST(g.priority AS BIGINT) AS priority, g.protocol, g.src_ip,
               CAST(g.src_port AS BIGINT) AS src_port, g.dst_ip,
               CAST(g.dst_port AS BIGINT) AS dst_port, interface, source_rank, line
        FROM (SELECT *, regexp_extract(trim("value"), {_text('^' + fixed.LIVE_LINE_PATTERN)},
                                       {_list(fixed.LIVE_LINE_GROUPS)}) AS g
              FROM lines
              WHERE regexp_matches(trim("value"), {_text('^' + fixed.LIVE_LINE_PATTERN)}))""",
    "eve_lines": f"""
        SELECT event_id AS line,
               CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS source_rank,
               CASE WHEN event_id % 90 = 0 THEN substr(doc, 1, 40) ELSE doc END AS "value"
        FROM (SELECT event_id, CAST(json_object(
                'timestamp', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+0000'),
                'flow_id', event_id,
                'event_type', CASE WHEN event_id % 30 != 0 THEN 'alert' ELSE 'flow' END,
                'src_ip', src_ip, 'src_port', src_port, 'dest_ip',
                CASE WHEN event_id % 3 = 0 THEN dst_ip ELSE '192.168.9.' || (event_id % 8) END,
                'dest_port', dst_port, 'proto', protocol,
                'app_proto', CASE WHEN k % 4 != 0 THEN 'http' END,
                'direction', CASE WHEN k % 2 = 0 THEN 'to_server' ELSE 'to_client' END,
                'payload_printable', CASE
                    WHEN event_id % 21 = 0 THEN 'payload' || chr(13) || chr(10) || 'second'
                        || chr(10) || 'third' || chr(13) || event_id
                    WHEN event_id % 7 = 0 THEN 'payload ' || event_id END,
                'ttl', {_list(TTLS)}[k % 6 + 1],
                'alert', CASE WHEN event_id % 30 != 0 THEN json_object('signature_id', rule_id) END,
                'flow', json_object(
                    'start', strftime(ts - to_seconds(k), '%Y-%m-%dT%H:%M:%S.%f+0000'),
                    'bytes_toserver', CASE WHEN k % 5 = 0 THEN 0 ELSE event_id % 1000 END,
                    'bytes_toclient', CASE WHEN k % 3 = 0 THEN 0 END,
                    'pkts_toserver', event_id % 17, 'pkts_toclient', k % 7),
                'http', CASE WHEN k % 4 = 1 THEN json_object('http_user_agent', 'agent/' || (k % 3)) END
              ) AS VARCHAR) AS doc FROM ev)""",
    "flows": """
        SELECT d->>'$.flow_id' AS flow_id, d->>'$.src_ip' AS src_ip,
               CAST(d->>'$.src_port' AS BIGINT) AS src_port, d->>'$.dest_ip' AS dst_ip,
               CAST(d->>'$.dest_port' AS BIGINT) AS dst_port, d->>'$.proto' AS protocol,
               d->>'$.app_proto' AS app_proto, d->>'$.direction' AS direction,
               CAST(d->>'$.flow.bytes_toserver' AS BIGINT) AS flow_bytes_toserver,
               CAST(d->>'$.flow.bytes_toclient' AS BIGINT) AS flow_bytes_toclient,
               coalesce(CAST(d->>'$.flow.bytes_toserver' AS BIGINT), 0)
                 + coalesce(CAST(d->>'$.flow.bytes_toclient' AS BIGINT), 0) AS flow_bytes,
               CAST(d->>'$.flow.pkts_toserver' AS BIGINT) AS pkts_toserver,
               CAST(d->>'$.flow.pkts_toclient' AS BIGINT) AS pkts_toclient,
               round(abs(date_diff('microsecond',
                   CAST(substr(d->>'$.flow.start', 1, 26) AS TIMESTAMP),
                   CAST(substr(d->>'$.timestamp', 1, 26) AS TIMESTAMP))) / 1000000.0, 4)
                 AS flow_duration,
               d->>'$.http.http_user_agent' AS http_user_agent,
               d->>'$.payload_printable' AS payload_printable, source_rank, line
        FROM (SELECT CAST("value" AS JSON) AS d, source_rank, line
              FROM (SELECT * FROM eve_lines WHERE json_valid("value")))
        WHERE d->>'$.event_type' = 'alert'""",
    "summary": "SELECT src_ip, dst_ip, dst_port, protocol, " + ", ".join(
        f"min_by({c}, source_rank * 1000000000000 + line) FILTER (WHERE {c} IS NOT NULL) AS {c}"
        for c in (
            "app_proto", "direction", "flow_bytes", "flow_bytes_toserver",
            "flow_bytes_toclient", "pkts_toserver", "pkts_toclient", "flow_duration",
            "http_user_agent", "payload_printable",
        )
    ) + " FROM flows GROUP BY ALL",
    "ttl_records": """
        SELECT d->>'$.src_ip' AS src_ip, CAST(d->>'$.ttl' AS BIGINT) AS ttl, source_rank, line
        FROM (SELECT CAST("value" AS JSON) AS d, source_rank, line
              FROM (SELECT * FROM eve_lines WHERE json_valid("value")))
        WHERE d->>'$.alert' IS NOT NULL AND d->>'$.ttl' IS NOT NULL""",
    "ttls": """
        SELECT src_ip, max_by(ttl, source_rank * 1000000000000 + line) AS ttl
        FROM ttl_records GROUP BY src_ip""",
    "first_copy": """
        SELECT * EXCLUDE (copy_no) FROM (
            SELECT *, row_number() OVER (
                PARTITION BY "timestamp", signature, src_ip, dst_ip, dst_port
                ORDER BY source_rank, line) AS copy_no
            FROM parsed) WHERE copy_no = 1""",
    "labelled": f"""
        SELECT *, {_TRUTH} AS ground_truth, {_STAGE} AS kill_chain_stage
        FROM (SELECT *, {_ATTACK_TYPE} AS attack_type, {_SCORE_FLOWS} AS fp_likelihood
              FROM first_copy LEFT JOIN summary USING (src_ip, dst_ip, dst_port, protocol))""",
    "dataset": "SELECT " + ", ".join(f'"{c}"' for c in fixed.DATASET_COLUMNS) + " FROM labelled",
    "alerts": f"""
        SELECT event_id AS id, "timestamp", signature, src_ip, dst_ip, src_port, dst_port,
               protocol, priority, category AS classification_suricata,
               CASE WHEN k = 98 THEN NULL WHEN k = 99 THEN 'error' WHEN "value" >= 150 THEN 'hack' ELSE 'normal' END
                 AS llm_classification,
               {_ATTACK_TYPE} AS attack_type,
               'Event ' || event_id || ' looks like ' || {_ATTACK_TYPE} AS explanation,
               CAST(least(10, floor("value" / 20)) AS BIGINT) AS risk_score,
               {_SCORE_NO_FLOWS} AS false_positive_likelihood,
               CAST(CASE WHEN event_id % 3 = 0 THEN {_list(TTLS)}[k % 6 + 1] ELSE 0 END AS BIGINT) AS ttl,
               ts AS created_at
        FROM ev WHERE event_id % 50 != 49""",
    "newest": "SELECT * FROM alerts ORDER BY created_at DESC, id DESC LIMIT 500",
    "hacks": "SELECT * FROM alerts WHERE llm_classification = 'hack'",
    "repeats": """
        SELECT src_ip, count(*) AS attack_count FROM hacks GROUP BY src_ip HAVING count(*) >= 2""",
    "earlier": """
        SELECT src_ip FROM hacks WHERE created_at < TIMESTAMP '2024-01-16'
        GROUP BY src_ip HAVING count(*) >= 2""",
    "facts": """
        SELECT src_ip, count(*) FILTER (WHERE llm_classification = 'hack') AS attack_count,
               min(created_at) AS first_seen, max(created_at) AS last_seen,
               list_aggregate(list_transform(list_sort(list(DISTINCT dst_port)
                 FILTER (WHERE dst_port > 0)), lambda x: CAST(x AS VARCHAR)), 'string_agg', ', ') AS ports,
               list_aggregate(list_transform(list_sort(list(DISTINCT dst_port)
                 FILTER (WHERE dst_port > 0 AND llm_classification = 'hack')),
                 lambda x: CAST(x AS VARCHAR)), 'string_agg', ', ') AS hack_ports,
               min(created_at) FILTER (WHERE llm_classification = 'hack') AS first_hack,
               max(created_at) FILTER (WHERE llm_classification = 'hack') AS last_hack,
               max(coalesce(risk_score, 0)) FILTER (WHERE llm_classification = 'hack') AS max_risk
        FROM alerts GROUP BY src_ip""",
    "types": """
        SELECT src_ip,
               max(attack_type = 'port_scan') AS scan, max(attack_type = 'brute_force') AS brute,
               max(attack_type IN ('web_scan', 'web_attack')) AS web,
               max(attack_type = 'dos') AS dos, max(attack_type = 'exploit') AS exploit,
               max(risk_score) AS max_risk, count(*) AS attack_count
        FROM hacks GROUP BY src_ip""",
    "steps": """
        SELECT src_ip, max_risk, attack_count, dos,
               list_filter([CASE WHEN scan THEN 'Reconnaissance' END,
                            CASE WHEN brute THEN 'Credential Attack' END,
                            CASE WHEN web THEN 'Web Exploitation' END,
                            CASE WHEN dos THEN 'Disruption' END,
                            CASE WHEN exploit THEN 'Exploitation' END],
                           lambda x: x IS NOT NULL) AS steps
        FROM types""",
}
_USES = {
    "ev": (), "rendered": ("ev",), "lines": ("rendered",), "parsed": ("lines",),
    "live": ("lines",), "eve_lines": ("ev",), "flows": ("eve_lines",),
    "summary": ("flows",), "ttl_records": ("eve_lines",), "ttls": ("ttl_records",),
    "first_copy": ("parsed",), "labelled": ("first_copy", "summary"),
    "dataset": ("labelled",), "alerts": ("ev",), "newest": ("alerts",),
    "hacks": ("alerts",), "repeats": ("hacks",), "earlier": ("hacks",),
    "facts": ("alerts",), "types": ("hacks",), "steps": ("types",),
}


def _with(body: str, *names: str) -> str:
    """``body`` behind the named expressions and everything they use."""
    needed: set[str] = set()

    def need(name: str) -> None:
        needed.add(name)
        for used in _USES[name]:
            need(used)

    for name in names:
        need(name)
    ctes = ",\n".join(f"{n} AS ({_CTES[n]})" for n in _CTES if n in needed)
    return f"WITH {ctes}\n{body}"


_MOMENT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_TIMED = f"SELECT * REPLACE ({_MOMENT.format('created_at')} AS created_at) FROM newest"
_FILTERED = (
    "false_positive_likelihood < 70 AND llm_classification IN ('hack', 'normal')"
    f" AND attack_type IN ({', '.join(_text(t) for t in fixed.ATTACK_LABELS)})"
)
_KPIS = """
    SELECT count(*) AS total,
           count(*) FILTER (WHERE llm_classification = 'hack') AS hacks,
           count(*) FILTER (WHERE risk_score >= 8) AS critical,
           count(*) FILTER (WHERE false_positive_likelihood >= 70) AS suppressed,
           CAST(round_even(count(*) FILTER (WHERE llm_classification = 'hack')
                / greatest(count(*), 1) * 100, 0) AS BIGINT) AS hack_percent,
           CAST(round_even(count(*) FILTER (WHERE false_positive_likelihood >= 70)
                / greatest(count(*), 1) * 100, 0) AS BIGINT) AS suppressed_percent
    FROM {}"""
_SUPPRESSION = """
    SELECT round_even(count(*) FILTER (WHERE false_positive_likelihood >= 70)
             / greatest(count(*), 1) * 100, 1) AS suppression_rate,
           count(*) FILTER (WHERE false_positive_likelihood >= 70) AS suppressed,
           count(*) FILTER (WHERE llm_classification = 'hack'
                            AND false_positive_likelihood < 70) AS confirmed,
           count(*) FILTER (WHERE NOT false_positive_likelihood >= 70) AS shown
    FROM {}"""
_FEED = f"""
    SELECT id, substr("timestamp", 1, 19) AS "time",
           CASE WHEN length(signature) > 48 THEN substr(signature, 1, 48) || '…' ELSE signature END AS signature,
           src_ip || ' → ' || dst_ip AS route, llm_classification, {_LABEL} AS attack_label, risk_score,
           CASE WHEN risk_score >= 8 THEN 'critical' WHEN risk_score >= 5 THEN 'warning' ELSE 'safe' END AS risk_class,
           CASE WHEN risk_score >= 8 THEN 'red' WHEN risk_score >= 5 THEN 'amber' ELSE 'green' END AS risk_color,
           risk_score * 6 AS bar_width,
           CASE WHEN false_positive_likelihood >= 70 THEN 'red'
                WHEN false_positive_likelihood >= 40 THEN 'amber' ELSE 'green' END AS fp_band,
           CASE WHEN risk_score >= 7 THEN 'severe' ELSE 'notice' END AS severity,
           substr(signature, 1, 55) AS title, explanation, protocol, src_port, dst_port, priority,
           false_positive_likelihood
    FROM {{}} WHERE {_FILTERED}"""
_EXPECTED = "(VALUES " + ", ".join(
    f"({_text(s)}, {_text(v)})" for s, v in fixed.EXPECTED_VERDICTS
) + ") AS e(signature, expected)"
_ACCURACY = f"""
    SELECT *, CASE WHEN accuracy >= 80 THEN 'pass' WHEN accuracy >= 50 THEN 'warn' ELSE 'fail' END AS status
    FROM (SELECT e.signature, e.expected, count(a.id) AS alerts,
                 count(a.id) FILTER (WHERE a.llm_classification = e.expected) AS correct,
                 CAST(round_even(count(a.id) FILTER (WHERE a.llm_classification = e.expected)
                      / greatest(count(a.id), 1) * 100, 0) AS BIGINT) AS accuracy
          FROM {_EXPECTED} LEFT JOIN {{}} a ON a.signature = e.signature
          GROUP BY e.signature, e.expected)"""
_OS = (
    "CASE WHEN ttl = 0 THEN 'Unknown' WHEN ttl <= 64 THEN 'Linux/Unix'"
    " WHEN ttl <= 128 THEN 'Windows' WHEN ttl <= 255 THEN 'Network Device' ELSE 'Unknown' END"
)
_OBJECTIVE = (
    "CASE WHEN len(steps) >= 3 THEN 'Systematic multi-stage attack following cyber kill chain'"
    " WHEN dos THEN 'Service disruption / denial of service'"
    " ELSE 'Reconnaissance and information gathering' END"
)
_SKILL = "CASE WHEN len(steps) >= 3 THEN 'INTERMEDIATE' ELSE 'SCRIPT KIDDIE' END"
_RESPONSE = "'Block ' || src_ip || ' at firewall level. Review all targeted ports.'"
_STEPS_TEXT = (
    "CASE WHEN len(steps) = 0 THEN 'Undetermined'"
    " ELSE list_aggregate(steps, 'string_agg', ' → ') END"
)
_THREAT = "CASE WHEN max_risk >= 8 THEN 'CRITICAL' ELSE 'HIGH' END"


def _first_seen(column: str, table: str) -> str:
    """Distinct values per source in first-seen order, as a list."""
    return (
        f"(SELECT src_ip, list(v ORDER BY created_at, id) AS {column}s FROM"
        f" (SELECT src_ip, {column} AS v, created_at, id, row_number() OVER"
        f"   (PARTITION BY src_ip, {column} ORDER BY created_at, id) AS n FROM {table})"
        f" WHERE n = 1 GROUP BY src_ip)"
    )


def _profile(table: str) -> str:
    return f"""
    SELECT src_ip, total, attack_types, signatures, ports, h.max_risk, time_start, time_end,
           s.steps AS steps, s.dos AS dos
    FROM (SELECT src_ip, count(*) AS total, max(risk_score) AS max_risk,
                 arg_min("timestamp", created_at) AS time_start,
                 arg_max("timestamp", created_at) AS time_end,
                 list_sort(list(DISTINCT dst_port)) AS ports
          FROM {table} GROUP BY src_ip) h
    JOIN {_first_seen('attack_type', table)} t USING (src_ip)
    JOIN {_first_seen('signature', table)} g USING (src_ip)
    JOIN steps s USING (src_ip)"""


def _joined(column: str, separator: str = ", ") -> str:
    return f"list_aggregate(list_transform({column}, lambda x: CAST(x AS VARCHAR)), 'string_agg', {_text(separator)})"


def _flat_profile(table: str) -> str:
    return f"""
    SELECT src_ip, total, {_joined('attack_types')} AS attack_types,
           {_joined('signatures')} AS signatures, {_joined('ports')} AS ports, max_risk,
           time_start, time_end,
           coalesce(list_aggregate(steps, 'string_agg', ', '), '') AS kill_chain,
           {_THREAT} AS threat_level
    FROM ({_profile(table)})"""


_SEEN_HACKS = (
    "(SELECT * FROM hacks WHERE src_ip IN"
    " (SELECT src_ip FROM newest WHERE llm_classification = 'hack'))"
)
_STEPS_OF_ATTACKERS = "SELECT f.*, s.steps, s.dos FROM facts f JOIN steps s USING (src_ip)"
_SCORED_LIVE = f"""
    SELECT *, {_ATTACK_TYPE} AS attack_type, {_SCORE_NO_FLOWS} AS false_positive_likelihood,
           signature || ' from ' || src_ip || ' to ' || dst_ip || ':' || dst_port AS explanation
    FROM {{}}"""
_VERDICTS = """
    CASE WHEN false_positive_likelihood >= 60 OR attack_type = 'other' THEN 'normal' ELSE 'hack' END
      AS llm_classification,
    attack_type, explanation,
    CAST(CASE priority WHEN 1 THEN 9 WHEN 2 THEN 7 ELSE 4 END
         - CASE WHEN false_positive_likelihood >= 60 THEN 3 ELSE 0 END AS BIGINT) AS risk_score,
    false_positive_likelihood"""
_LIVE_ONCE = "(SELECT DISTINCT ON (line) * FROM live)"
_INGESTED = f"""
    SELECT "timestamp", signature, src_ip, dst_ip, src_port, dst_port, protocol, priority,
           classification_suricata, {_VERDICTS}, coalesce(t.ttl, 0) AS ttl
    FROM ({_SCORED_LIVE.format(_LIVE_ONCE)}) s LEFT JOIN ttls t USING (src_ip)"""
_STREAM_STEPS = """
    SELECT src_ip, count(*) FILTER (WHERE hack) AS attack_count,
           list_aggregate(list_transform(list_sort(list(DISTINCT dst_port)
             FILTER (WHERE dst_port > 0)), lambda x: CAST(x AS VARCHAR)), 'string_agg', ', ') AS ports,
           coalesce(max(attack_type = 'dos') FILTER (WHERE hack), FALSE) AS dos,
           CAST(coalesce(max(attack_type = 'port_scan') FILTER (WHERE hack), FALSE) AS INT)
             + CAST(coalesce(max(attack_type = 'brute_force') FILTER (WHERE hack), FALSE) AS INT)
             + CAST(coalesce(max(attack_type = 'web_scan') FILTER (WHERE hack), FALSE) AS INT)
             + CAST(coalesce(max(attack_type = 'dos') FILTER (WHERE hack), FALSE) AS INT)
             + CAST(coalesce(max(attack_type = 'exploit') FILTER (WHERE hack), FALSE) AS INT) AS n
    FROM (SELECT *, llm_classification = 'hack' AS hack FROM ({})) GROUP BY src_ip"""

ORACLE_SQL: dict[str, str] = {
    # lines
    "parse_alert_lines_archive": _with("SELECT * FROM parsed", "parsed"),
    "parse_alert_lines_live": _with("SELECT * FROM live", "live"),
    "parse_reject_count": _with(
        """
        SELECT 'archive' AS grammar, (SELECT count(*) FROM lines) AS lines,
               (SELECT count(*) FROM parsed) AS parsed,
               (SELECT count(*) FROM lines) - (SELECT count(*) FROM parsed) AS rejected
        UNION ALL
        SELECT 'live', (SELECT count(*) FROM lines), (SELECT count(*) FROM live),
               (SELECT count(*) FROM lines) - (SELECT count(*) FROM live)""",
        "parsed", "live",
    ),
    "alerts_and_rejects": _with(
        f"""
        SELECT source_rank, line, kind, content,
               (SELECT count(*) FROM lines) AS lines,
               (SELECT count(*) FROM lines) - (SELECT count(*) FROM live) AS rejects
        FROM (SELECT source_rank, line, 'alert' AS kind, signature AS content FROM live
              UNION ALL
              SELECT source_rank, line, 'rejected', "value" FROM lines
              WHERE NOT regexp_matches(trim("value"), {_text('^' + fixed.LIVE_LINE_PATTERN)}))""",
        "lines", "live",
    ),
    "rejected_alert_lines": _with(
        f"""
        SELECT "value", interface, source_rank, line FROM lines
        WHERE NOT regexp_matches(trim("value"), {_text('^' + fixed.LIVE_LINE_PATTERN)})""",
        "lines",
    ),
    "alert_event_time": _with(
        f"""
        SELECT source_rank, line, "timestamp",
               {_MOMENT.format("strptime(\"timestamp\", '%m/%d/%Y-%H:%M:%S.%f')")} AS event_ts
        FROM parsed""",
        "parsed",
    ),
    "scan_alert_files": _with("SELECT * EXCLUDE (source_rank, line) FROM parsed", "parsed"),
    "parse_eve_alerts": _with("SELECT * EXCLUDE (flow_duration) FROM flows", "flows"),
    "flow_duration": _with("SELECT flow_id, flow_duration FROM flows", "flows"),
    "union_sources": _with(
        """
        SELECT interface, source_rank, count(*) AS alerts,
               CAST(sum(src_port) AS BIGINT) AS src_port_sum
        FROM parsed GROUP BY interface, source_rank""",
        "parsed",
    ),
    # enrichment
    "flow_summary_first_non_null": _with("SELECT * FROM summary", "summary"),
    "enrich_alerts_left_join": _with(
        "SELECT * FROM parsed LEFT JOIN summary USING (src_ip, dst_ip, dst_port, protocol)",
        "parsed", "summary",
    ),
    "ttl_latest": _with("SELECT * FROM ttls", "ttls"),
    "stream_ttl": _with("SELECT * FROM ttls", "ttls"),
    "ttl_latest_of_tail": _with(
        """
        SELECT src_ip, max_by(ttl, source_rank * 1000000000000 + line) AS ttl
        FROM ttl_records
        WHERE (source_rank, line) IN (SELECT (source_rank, line) FROM eve_lines
                                      ORDER BY source_rank DESC, line DESC LIMIT 100)
        GROUP BY src_ip""",
        "ttl_records",
    ),
    "ttl_enrich": _with(
        f"""
        SELECT source_rank, line, src_ip, ttl, {_OS} AS os
        FROM (SELECT source_rank, line, src_ip, coalesce(t.ttl, 0) AS ttl
              FROM live LEFT JOIN ttls t USING (src_ip))""",
        "live", "ttls",
    ),
    # labels
    "classify_attack_type": _with(
        f"SELECT source_rank, line, signature, {_ATTACK_TYPE} AS attack_type FROM parsed",
        "parsed",
    ),
    "kill_chain_stage": _with(
        f"""
        SELECT attack_type, {_STAGE} AS kill_chain_stage, count(*) AS alerts
        FROM (SELECT {_ATTACK_TYPE} AS attack_type FROM parsed) GROUP BY attack_type""",
        "parsed",
    ),
    "fp_likelihood": _with(
        f"""
        SELECT *, {_TRUTH} AS ground_truth
        FROM (SELECT source_rank, line, flow_bytes, {_SCORE_FLOWS} AS fp_likelihood
              FROM parsed LEFT JOIN summary USING (src_ip, dst_ip, dst_port, protocol))""",
        "parsed", "summary",
    ),
    "fp_likelihood_no_eve": _with(
        f"""
        SELECT *, {_TRUTH} AS ground_truth
        FROM (SELECT source_rank, line, {_SCORE_NO_FLOWS} AS fp_likelihood FROM parsed)""",
        "parsed",
    ),
    # dataset
    "dedup_keep_first": _with("SELECT * FROM first_copy", "first_copy"),
    "dedup_counts": _with(
        """
        SELECT 'before' AS step, count(*) AS rows FROM parsed
        UNION ALL SELECT 'after', count(*) FROM first_copy""",
        "parsed", "first_copy",
    ),
    "final_dataset": _with("SELECT * FROM dataset", "dataset"),
    "final_dataset_no_eve": _with(
        "SELECT " + ", ".join(
            f"CAST(NULL AS {'DOUBLE' if c == 'flow_duration' else 'BIGINT' if 'bytes' in c or 'pkts' in c else 'VARCHAR'}) AS {c}"
            if c in ("app_proto", "direction", "flow_bytes", "flow_bytes_toserver",
                     "flow_bytes_toclient", "pkts_toserver", "pkts_toclient",
                     "flow_duration", "http_user_agent", "payload_printable")
            else f'"{c}"' for c in fixed.DATASET_COLUMNS
        ) + f"""
        FROM (SELECT *, {_TRUTH} AS ground_truth, {_STAGE} AS kill_chain_stage
              FROM (SELECT *, {_ATTACK_TYPE} AS attack_type, {_SCORE_NO_FLOWS} AS fp_likelihood
                    FROM first_copy))""",
        "first_copy",
    ),
    "label_distribution": _with(
        " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, {d} AS \"value\", count(*) AS alerts FROM dataset GROUP BY {d}"
            for d in ("ground_truth", "attack_type", "kill_chain_stage", "interface")
        ),
        "dataset",
    ),
    "fp_histogram": _with(
        """
        SELECT b AS bin_no, (b - 1) * 10 AS above, b * 10 AS up_to,
               count(fp_likelihood) AS alerts
        FROM range(1, 11) r(b)
        LEFT JOIN dataset ON (fp_likelihood > (b - 1) * 10 OR (b = 1 AND fp_likelihood = 0))
                         AND fp_likelihood <= b * 10
        GROUP BY b""",
        "dataset",
    ),
    "enrichment_coverage": _with(
        """
        SELECT count(flow_bytes) AS flow_bytes_filled, count(flow_duration) AS flow_duration_filled,
               count(app_proto) AS app_proto_filled, count(*) AS total FROM dataset""",
        "dataset",
    ),
    "csv_roundtrip": _with("SELECT * FROM dataset", "dataset"),
    "table_roundtrip": _with("SELECT * FROM dataset", "dataset"),
    # verdicts
    "score_rule": _with(
        f"SELECT source_rank, line, {_VERDICTS} FROM ({_SCORED_LIVE.format('live')})", "live"
    ),
    "score_fallback": _with(
        """
        SELECT source_rank, line,
               CASE WHEN priority = 3 THEN 'error' ELSE 'hack' END AS llm_classification,
               CASE WHEN priority = 1 THEN NULL ELSE 'unknown' END AS attack_type,
               CASE priority WHEN 1 THEN 'seen' WHEN 2 THEN '' ELSE 'API unreachable' END AS explanation,
               CAST(CASE WHEN priority = 1 THEN 9 ELSE 5 END AS BIGINT) AS risk_score,
               CAST(CASE WHEN priority = 1 THEN 10 ELSE 50 END AS BIGINT) AS false_positive_likelihood
        FROM live""",
        "live",
    ),
    # analytics
    "newest_alerts": _with(_TIMED, "newest"),
    "newest_stored_alerts": _with(_TIMED, "newest"),
    "newest_alerts_of_parts": _with(_TIMED, "newest"),
    "newest_alerts_13": _with(
        """
        SELECT "timestamp", signature, src_ip, dst_ip, llm_classification, attack_type,
               explanation, risk_score, false_positive_likelihood, priority, protocol,
               src_port, dst_port FROM newest""",
        "newest",
    ),
    "filter_alerts": _with(
        f"""
        SELECT id, attack_type, llm_classification, risk_score, false_positive_likelihood
        FROM alerts WHERE {_FILTERED} AND risk_score >= 2""",
        "alerts",
    ),
    "filter_alerts_open": _with(
        """
        SELECT id, attack_type, llm_classification, risk_score, false_positive_likelihood
        FROM alerts WHERE risk_score >= 0""",
        "alerts",
    ),
    "kpis": _with(_KPIS.format("newest"), "newest"),
    "kpis_whole_table": _with(_KPIS.format("alerts"), "alerts"),
    "fp_suppression": _with(_SUPPRESSION.format("newest"), "newest"),
    "fp_suppression_whole_table": _with(_SUPPRESSION.format("alerts"), "alerts"),
    "verdict_counts": _with(
        """SELECT llm_classification, count(*) AS alerts FROM alerts
        WHERE llm_classification IS NOT NULL GROUP BY llm_classification""",
        "alerts",
    ),
    "attack_type_counts": _with(
        f"""
        SELECT attack_type, count(*) AS alerts, {_LABEL} AS label
        FROM alerts WHERE attack_type != 'other' GROUP BY attack_type""",
        "alerts",
    ),
    "risk_timeline": _with(
        f"SELECT {_MOMENT.format('created_at')} AS \"time\", risk_score FROM alerts", "alerts"
    ),
    "alert_feed": _with(
        _FEED.format("newest") + " ORDER BY created_at DESC, id DESC LIMIT 60", "newest"
    ),
    "alert_feed_whole_table": _with(_FEED.format("alerts"), "alerts"),
    "accuracy_report": _with(_ACCURACY.format("alerts"), "alerts"),
    "accuracy_report_newest": _with(_ACCURACY.format("newest"), "newest"),
    "accuracy_overall": _with(
        f"""
        SELECT CAST(sum(correct) AS BIGINT) AS correct, CAST(sum(alerts) AS BIGINT) AS alerts,
               CAST(round_even(sum(correct) / greatest(sum(alerts), 1) * 100, 0) AS BIGINT) AS accuracy
        FROM ({_ACCURACY.format('alerts')})""",
        "alerts",
    ),
    # attackers
    "repeat_attackers": _with("SELECT * FROM repeats", "repeats"),
    "distinct_attackers": _with("SELECT DISTINCT src_ip FROM hacks", "hacks"),
    "unprofiled_attackers": _with(
        """
        SELECT * FROM repeats r
        WHERE NOT EXISTS (SELECT 1 FROM earlier e WHERE e.src_ip = r.src_ip)""",
        "repeats", "earlier",
    ),
    "attacker_sequence": _with(
        """
        SELECT src_ip, CAST(0 AS BIGINT) AS part, count(*) AS step_count,
               string_agg(CASE WHEN coalesce(attack_type, '') = '' THEN 'unknown' ELSE attack_type END,
                          ' → ' ORDER BY created_at, id) AS attack_sequence
        FROM hacks WHERE src_ip IN (SELECT src_ip FROM repeats) GROUP BY src_ip""",
        "hacks", "repeats",
    ),
    "attack_sequence_steps": _with(
        """
        SELECT src_ip, row_number() OVER (PARTITION BY src_ip ORDER BY created_at, id) AS position,
               attack_type
        FROM hacks WHERE src_ip IN (SELECT src_ip FROM repeats)""",
        "hacks", "repeats",
    ),
    "attacker_facts": _with(
        f"""
        SELECT src_ip, attack_count, coalesce(hack_ports, '') AS hack_ports, max_risk,
               {_MOMENT.format('first_hack')} AS first_hack, {_MOMENT.format('last_hack')} AS last_hack
        FROM facts WHERE attack_count >= 2""",
        "facts",
    ),
    "stored_profile": _with(
        f"""
        SELECT src_ip, 'unknown' AS methodology, {_OBJECTIVE} AS objective,
               {_SKILL} AS skill_level, 'Block ' || src_ip AS recommended_response, attack_count,
               strftime(first_seen, '%Y-%m-%d %H:%M:%S') || ' to '
                 || strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS time_span,
               coalesce(ports, 'none') AS ports_targeted
        FROM ({_STEPS_OF_ATTACKERS})
        WHERE attack_count >= 2 AND src_ip NOT IN (SELECT src_ip FROM earlier)""",
        "facts", "steps", "earlier",
    ),
    "profile_assessor_fallback": _with(
        """
        SELECT src_ip, attack_count,
               CASE WHEN attack_count % 2 = 1 THEN 'unknown' ELSE 'mixed' END AS methodology,
               'unknown' AS objective,
               CASE WHEN attack_count % 2 = 1 THEN 'unknown' END AS skill_level,
               'Block ' || src_ip AS recommended_response
        FROM repeats""",
        "repeats",
    ),
    "attacker_profile": _with(_flat_profile(_SEEN_HACKS), "hacks", "newest", "steps"),
    "attacker_profile_whole_table": _with(_flat_profile("hacks"), "hacks", "steps"),
    "attacker_profile_rollup": _with(_flat_profile("hacks"), "hacks", "steps"),
    "attacker_os": _with(
        f"""
        SELECT src_ip, ttl, {_OS} AS os
        FROM (SELECT src_ip, coalesce(arg_max(ttl, created_at) FILTER (WHERE ttl > 0), 0) AS ttl
              FROM alerts GROUP BY src_ip)""",
        "alerts",
    ),
    "view_kpis": _with(_KPIS.format("newest"), "newest"),
    "feed_count": _with(
        f"SELECT count(*) AS alerts FROM newest WHERE {_FILTERED} AND risk_score >= 2", "newest"
    ),
    "feed_count_whole_table": _with(
        f"SELECT count(*) AS alerts FROM alerts WHERE {_FILTERED} AND risk_score >= 2", "alerts"
    ),
    "attacker_card_os": _with(
        f"""
        SELECT src_ip, total, ttl, {_OS} AS os
        FROM (SELECT src_ip, count(*) FILTER (WHERE llm_classification = 'hack') AS total,
                     coalesce(arg_max(ttl, created_at) FILTER (WHERE ttl > 0), 0) AS ttl
              FROM alerts WHERE src_ip IN
                (SELECT src_ip FROM newest WHERE llm_classification = 'hack') GROUP BY src_ip)""",
        "alerts", "newest",
    ),
    "view_assessment": _with(
        f"""
        SELECT src_ip, CASE WHEN assessed THEN total || ' alerts' END AS methodology,
               CASE WHEN assessed THEN '—' ELSE {_OBJECTIVE} END AS objective,
               CASE WHEN assessed THEN 'SCRIPT_KIDDIE' ELSE {_SKILL} END AS skill_level,
               CASE WHEN assessed THEN '—' ELSE {_RESPONSE} END AS response,
               CAST(NULL AS VARCHAR) AS assessed_threat_level, assessed
        FROM (SELECT *, src_ip NOT LIKE '%7' AS assessed FROM steps
              JOIN (SELECT src_ip, count(*) AS total FROM hacks GROUP BY src_ip) USING (src_ip))""",
        "hacks", "steps",
    ),
    "profile_assessment": _with(
        f"""
        SELECT src_ip, {_THREAT} AS threat_level, {_STEPS_TEXT} AS kill_chain,
               {_OBJECTIVE} AS objective, {_SKILL} AS skill_level, {_RESPONSE} AS response
        FROM steps""",
        "steps",
    ),
    "profile_card": _with(
        f"""
        SELECT src_ip, total, max_risk, {_THREAT} AS threat_level, time_start, time_end,
               {_joined('attack_types', ' → ')} AS attack_sequence,
               list_aggregate(list_transform(signatures[1:6], lambda x: substr(x, 1, 40)),
                              'string_agg', ' · ') AS signatures,
               {_joined('ports[1:10]')} AS ports, {_STEPS_TEXT} AS kill_chain,
               {_OBJECTIVE} AS objective, {_SKILL} AS skill_level, {_RESPONSE} AS response
        FROM ({_profile('hacks')})""",
        "hacks", "steps",
    ),
    # stored tables
    "add_column_default": _with(
        """
        SELECT id, CASE WHEN created_at < TIMESTAMP '2024-01-16' THEN 0 ELSE ttl END AS ttl
        FROM alerts""",
        "alerts",
    ),
    "clear_table": _with(
        "SELECT count(*) AS rows_before, CAST(0 AS BIGINT) AS rows_left FROM alerts", "alerts"
    ),
    # streams
    "stream_dedup": _with(
        'SELECT DISTINCT "value", md5("value") AS line_hash FROM lines', "lines"
    ),
    "stream_ingest": _with(_INGESTED, "live", "ttls"),
    "stream_ingest_batches": _with(_INGESTED, "live", "ttls"),
    "stream_ingest_merged": _with(_INGESTED, "live", "ttls"),
    "stream_profile_sequence": _with(
        f"""
        SELECT src_ip, count(*) AS attack_count,
               string_agg(attack_type, ' → ' ORDER BY "timestamp", md5("value")) AS attack_sequence
        FROM (SELECT *, {_VERDICTS.replace('attack_type, explanation,', '')}
              FROM ({_SCORED_LIVE.format(_LIVE_ONCE)}) JOIN rendered USING (line))
        WHERE llm_classification = 'hack' GROUP BY src_ip HAVING count(*) >= 2""",
        "live", "rendered",
    ),
    "stream_profile_parts": _with(
        f"""
        SELECT src_ip, count(*) AS attack_count,
               sha256(string_agg(attack_type, ' → ' ORDER BY "timestamp", md5("value"))) AS sequence_sha256,
               count(*) AS steps, 'Block ' || src_ip AS recommended_response
        FROM (SELECT *, {_VERDICTS.replace('attack_type, explanation,', '')}
              FROM ({_SCORED_LIVE.format(_LIVE_ONCE)}) JOIN rendered USING (line))
        WHERE llm_classification = 'hack' GROUP BY src_ip HAVING count(*) >= 2""",
        "live", "rendered",
    ),
    "stream_new_per_batch": _with("SELECT count(DISTINCT line) AS alerts FROM live", "live"),
    "stream_profiles": _with(
        f"""
        SELECT src_ip, 'unknown' AS methodology,
               CASE WHEN n >= 3 THEN 'Systematic multi-stage attack following cyber kill chain'
                    WHEN dos THEN 'Service disruption / denial of service'
                    ELSE 'Reconnaissance and information gathering' END AS objective,
               CASE WHEN n >= 3 THEN 'INTERMEDIATE' ELSE 'SCRIPT KIDDIE' END AS skill_level,
               'Block ' || src_ip AS recommended_response, attack_count,
               coalesce(ports, 'none') AS ports_targeted
        FROM ({_STREAM_STEPS.format(_INGESTED)}) WHERE attack_count >= 2""",
        "live", "ttls",
    ),
    "stream_kpis": _with(
        _KPIS.format(f"(SELECT {_VERDICTS} FROM ({_SCORED_LIVE.format(_LIVE_ONCE)}))"), "live"
    ),
}

ORACLE_SQL["attacker_os_rollup"] = ORACLE_SQL["attacker_os"]
