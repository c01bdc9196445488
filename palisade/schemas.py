"""Schemas of the inputs and of the two stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

from palisade.fixed_values import DATASET_COLUMNS

# Position of a row in its source. Comparing two of these structs tells which
# line came first: sources in union order, then files by name, then the block
# inside the file, then the line inside the block.
SOURCE_ORDER = T.StructType([
    T.StructField("rank", T.IntegerType()),
    T.StructField("file", T.StringType()),
    T.StructField("block", T.LongType()),
    T.StructField("line", T.LongType()),
])

# One flow-log record. Ports arrive as JSON numbers or strings, so they are
# read as text and cast afterwards.
EVE_RECORD = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("flow_id", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("src_port", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("dest_port", T.StringType()),
    T.StructField("proto", T.StringType()),
    T.StructField("app_proto", T.StringType()),
    T.StructField("direction", T.StringType()),
    T.StructField("payload_printable", T.StringType()),
    T.StructField("flow", T.StructType([
        T.StructField("start", T.StringType()),
        T.StructField("bytes_toserver", T.LongType()),
        T.StructField("bytes_toclient", T.LongType()),
        T.StructField("pkts_toserver", T.LongType()),
        T.StructField("pkts_toclient", T.LongType()),
    ])),
    T.StructField("http", T.StructType([
        T.StructField("http_user_agent", T.StringType()),
    ])),
])

# The part of a flow-log record the TTL scan needs. Any value can be read as text.
EVE_TTL_RECORD = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("ttl", T.LongType()),
    T.StructField("alert", T.StringType()),
])

_LONG_DATASET_COLUMNS = {
    "src_port", "dst_port", "priority", "flow_bytes", "flow_bytes_toserver",
    "flow_bytes_toclient", "pkts_toserver", "pkts_toclient", "fp_likelihood",
}


def _dataset_type(name: str) -> T.DataType:
    if name == "flow_duration":
        return T.DoubleType()
    return T.LongType() if name in _LONG_DATASET_COLUMNS else T.StringType()


DATASET = T.StructType(
    [T.StructField(name, _dataset_type(name)) for name in DATASET_COLUMNS]
)

# Verdict columns a scorer adds to each alert, under their stored names.
VERDICT = T.StructType([
    T.StructField("llm_classification", T.StringType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("explanation", T.StringType()),
    T.StructField("risk_score", T.LongType()),
    T.StructField("false_positive_likelihood", T.LongType()),
])

# Stored alerts.
ALERTS = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.LongType()),
    T.StructField("dst_port", T.LongType()),
    T.StructField("protocol", T.StringType()),
    T.StructField("priority", T.LongType()),
    T.StructField("classification_suricata", T.StringType()),
    *VERDICT.fields,
    T.StructField("ttl", T.LongType()),
    T.StructField("created_at", T.TimestampType()),
])

# Columns of the compact recent-alerts listing, in order.
RECENT_COLUMNS = (
    "timestamp", "signature", "src_ip", "dst_ip", "llm_classification",
    "attack_type", "explanation", "risk_score", "false_positive_likelihood",
    "priority", "protocol", "src_port", "dst_port",
)

# Assessment columns a profile assessor adds to each attacker.
ASSESSMENT = T.StructType([
    T.StructField("methodology", T.StringType()),
    T.StructField("objective", T.StringType()),
    T.StructField("skill_level", T.StringType()),
    T.StructField("recommended_response", T.StringType()),
])

# Stored attacker profiles; src_ip is unique.
PROFILES = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    *ASSESSMENT.fields,
    T.StructField("attack_count", T.LongType()),
    T.StructField("time_span", T.StringType()),
    T.StructField("ports_targeted", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

_POSITION = T.StructType([
    T.StructField("created_at", T.TimestampType()),
    T.StructField("id", T.LongType()),
])
_SEEN = T.StructType([T.StructField("at", _POSITION), T.StructField("timestamp", T.StringType())])

# Roll-up of the alerts of a batch, mergeable with that of other batches.
ROLLUP = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_port", T.LongType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("signature", T.StringType()),
    T.StructField("hacks", T.LongType()),
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("first_hack", T.TimestampType()),
    T.StructField("last_hack", T.TimestampType()),
    T.StructField("max_risk", T.LongType()),
    T.StructField("top_risk", T.LongType()),
    T.StructField("oldest", _SEEN),
    T.StructField("newest", _SEEN),
    T.StructField("newest_ttl", T.StructType([
        T.StructField("at", _POSITION), T.StructField("ttl", T.LongType()),
    ])),
])

# TTL last reported for each source, with the place of the report.
TTLS = T.StructType([
    T.StructField("src_ip", T.StringType()),
    T.StructField("ttl", T.LongType()),
    T.StructField("source_order", SOURCE_ORDER),
])

# Key figures, one row.
KPIS = T.StructType([
    T.StructField(name, T.LongType())
    for name in ("total", "hacks", "critical", "suppressed", "hack_percent", "suppressed_percent")
])
