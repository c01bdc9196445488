"""Flow summary per connection, flow join, TTL per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.operators.joins import join_lookup

FLOW_KEY = ["src_ip", "dst_ip", "dst_port", "protocol"]
FLOW_COLUMNS = [
    "app_proto", "direction", "flow_bytes", "flow_bytes_toserver",
    "flow_bytes_toclient", "pkts_toserver", "pkts_toclient", "flow_duration",
    "http_user_agent", "payload_printable",
]


def union_sources(*sources: DataFrame) -> DataFrame:
    """All rows of all sources; order between them is in ``source_order``."""
    first, *rest = sources
    for source in rest:
        first = first.unionByName(source)
    return first


def flow_summary(flows: DataFrame) -> DataFrame:
    """Per connection the first non-null value of each column in source order.

    The columns of one result row may come from different flow records. Plain
    aggregates combine before the shuffle, so a connection that owns a large
    share of the records still sends one row per map task.
    """
    firsts = [
        F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("source_order"))).alias(c)
        for c in FLOW_COLUMNS
    ]
    return flows.groupBy(*FLOW_KEY).agg(*firsts)


def join_flows(alerts: DataFrame, summary: DataFrame) -> DataFrame:
    """Alerts with the flow columns of their connection, null where unknown."""
    return join_lookup(alerts, summary, FLOW_KEY)


def latest_ttl(ttl_records: DataFrame) -> DataFrame:
    """The TTL last reported for each source."""
    return ttl_records.groupBy("src_ip").agg(
        F.max_by("ttl", "source_order").alias("ttl")
    )


def newest_ttl(ttl_records: DataFrame) -> DataFrame:
    """The last report of each source with its place.

    What is left can stand for the records it was made from: the newest of
    several batches' newest reports are the newest of all their records.
    """
    return ttl_records.groupBy("src_ip").agg(
        F.max_by("ttl", "source_order").alias("ttl"),
        F.max("source_order").alias("source_order"),
    )


def join_ttl(alerts: DataFrame, ttl_by_source: DataFrame) -> DataFrame:
    """Alerts with ``ttl``: 0 for a source never seen, its last value otherwise."""
    known = ttl_by_source.withColumn("_known", F.lit(True))
    joined = join_lookup(alerts, known, ["src_ip"])
    return joined.withColumn(
        "ttl", F.when(F.col("_known"), F.col("ttl")).otherwise(F.lit(0))
    ).drop("_known")
