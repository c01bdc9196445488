"""The ``events`` table seen as alert lines, flow-log lines and stored alerts.

Everything is a projection of ``events`` (static or streaming), so the work of
every query grows with that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions import labels
from palisade.schemas import ALERTS, SOURCE_ORDER

SIGNATURES = (
    "NMAP SYN Scan Detected",
    "NMAP FIN Stealth Scan",
    "FTP Brute Force Attempt",
    "HTTP DoS Attack Detected",
    "Slowloris DoS Attack",
    "Web Application Scan Detected",
    "SURICATA Applayer Detect protocol only one direction",
    "SURICATA SMB malformed request dialects",
    "SURICATA HTTP Host header invalid",
    "ET INFO Session Traversal Utilities",
    "ET POLICY Cleartext Password",
    "ICMP Ping Sweep",
    "Botnet Beacon Checkin",
    "Shellcode Overflow Attempt",
    "Unclassified Event",
)
PORTS = (22, 80, 443, 445, 21, 8080, 3389, 0)
TTLS = (0, 64, 128, 255, 48, 32)
ROW_GROUP_BYTES = 1 << 20  # of a landed file; a row group is never divided


def _pick(values, index: Column) -> Column:
    return F.array(*(F.lit(v) for v in values))[index.cast("int")]


def wide_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the fields of alerts, spread over all cores."""
    return _spread_with_fields(spark.read.parquet(f"{sf_dir}/events.parquet"))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    table = spark.readStream.schema(schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(sf_dir)
    return _spread_with_fields(table)


def events_stream_of_files(
    spark: SparkSession, sf_dir: str, folder: str, files: int
) -> DataFrame:
    """The same stream from several files below ``folder``, one file per micro-batch.

    The files have many row groups, so that several tasks read the one file of
    a batch; one of a single row group is read by one task, whatever its size.
    """
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table.repartition(files).write.option("parquet.block.size", ROW_GROUP_BYTES).parquet(folder)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
    return _spread_with_fields(stream.parquet(folder))


def _spread_with_fields(table: DataFrame) -> DataFrame:
    """The narrow rows are moved, so that all cores share making and parsing lines.

    A file, and with it a micro-batch, may be a few splits only.
    """
    return _with_fields(table.repartition(table.sparkSession.sparkContext.defaultParallelism))


def _with_fields(table: DataFrame) -> DataFrame:
    number = F.get_json_object("props", "$.k").try_cast("bigint")
    with_k = table.select("event_id", "ts", "user_id", "value", number.alias("k"))
    event_id, k = F.col("event_id"), F.col("k")
    signature_index = (event_id * 7 + k) % len(SIGNATURES)
    user = F.col("user_id")
    return with_k.select(
        "event_id", "ts", "value", "k",
        F.date_format("ts", "MM/dd/yyyy-HH:mm:ss.SSSSSS").alias("timestamp"),
        _pick(SIGNATURES, signature_index).alias("signature"),
        (signature_index + 9_000_000).alias("rule_id"),
        F.concat(F.lit("Class "), k % 5).alias("category"),
        F.concat_ws(
            ".", F.lit("10.0"), F.floor(user / 256).cast("string"), (user % 256).cast("string")
        ).alias("src_ip"),
        F.concat(F.lit("192.168.1."), event_id % 8).alias("dst_ip"),
        (event_id % 50_000 + 1024).alias("src_port"),
        _pick(PORTS, k % 8).cast("bigint").alias("dst_port"),
        F.when(k % 10 == 0, F.lit("UDP")).otherwise(F.lit("TCP")).alias("protocol"),
        ((F.floor(event_id / 15) + k) % 3 + 1).alias("priority"),
    )


def _order(rank: Column, line: Column) -> Column:
    return F.struct(
        rank.alias("rank"), F.lit("").alias("file"), F.lit(0).alias("block"), line.alias("line")
    ).cast(SOURCE_ORDER)


def alert_lines(events: DataFrame) -> DataFrame:
    """``value``, ``interface``, ``source_order``; every 25th line comes twice."""
    event_id = F.col("event_id")
    priority = F.when(event_id % 50 == 49, F.lit("")).otherwise(
        F.concat(F.lit("[Priority: "), "priority", F.lit("] "))
    )
    extra = F.when(event_id % 40 == 7, F.lit("[Extra: x] ")).otherwise(F.lit(""))
    value = F.concat(
        "timestamp", F.lit("  [**] [1:"), "rule_id", F.lit(":1] "), "signature",
        F.lit(" [**] "), extra, F.lit("[Classification: "), "category", F.lit("] "),
        priority, F.lit("{"), "protocol", F.lit("} "),
        "src_ip", F.lit(":"), "src_port", F.lit(" -> "), "dst_ip", F.lit(":"), "dst_port",
    )
    own = F.struct(
        F.when(event_id % 2 == 0, F.lit("OPT1")).otherwise(F.lit("LAN")).alias("interface"),
        (event_id % 2).cast("int").alias("rank"),
    )
    again = F.struct(F.lit("LAN").alias("interface"), F.lit(1).alias("rank"))
    copies = F.when(event_id % 25 == 0, F.array(own, again)).otherwise(F.array(own))
    return events.select(
        value.alias("value"), "event_id", F.explode(copies).alias("copy")
    ).select(
        "value", F.col("copy.interface").alias("interface"),
        _order(F.col("copy.rank"), event_id).alias("source_order"),
    )


def flow_lines(events: DataFrame) -> DataFrame:
    """``value``, ``source_order``: one JSON record for every event.

    Two in three go to addresses that no alert names, so alerts of those
    events find no flow of their own.
    """
    event_id, k = F.col("event_id"), F.col("k")
    iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+0000'"
    is_alert = event_id % 30 != 0

    record = F.struct(
        F.date_format("ts", iso).alias("timestamp"),
        event_id.alias("flow_id"),
        F.when(is_alert, F.lit("alert")).otherwise(F.lit("flow")).alias("event_type"),
        "src_ip", "src_port",
        F.when(event_id % 3 == 0, F.col("dst_ip"))
        .otherwise(F.concat(F.lit("192.168.9."), event_id % 8)).alias("dest_ip"),
        F.col("dst_port").alias("dest_port"), F.col("protocol").alias("proto"),
        F.when(k % 4 != 0, F.lit("http")).alias("app_proto"),
        F.when(k % 2 == 0, F.lit("to_server")).otherwise(F.lit("to_client")).alias("direction"),
        F.when(event_id % 21 == 0, F.concat(F.lit("payload\r\nsecond\nthird\r"), event_id))
        .when(event_id % 7 == 0, F.concat(F.lit("payload "), event_id)).alias("payload_printable"),
        _pick(TTLS, k % 6).alias("ttl"),
        F.when(is_alert, F.struct(F.col("rule_id").alias("signature_id"))).alias("alert"),
        F.struct(
            F.date_format(
                F.timestamp_add("SECOND", -k, F.col("ts")), iso
            ).alias("start"),
            F.when(k % 5 == 0, F.lit(0)).otherwise(event_id % 1000).alias("bytes_toserver"),
            F.when(k % 3 == 0, F.lit(0)).alias("bytes_toclient"),
            (event_id % 17).alias("pkts_toserver"),
            (k % 7).alias("pkts_toclient"),
        ).alias("flow"),
        F.when(
            k % 4 == 1, F.struct(F.concat(F.lit("agent/"), k % 3).alias("http_user_agent"))
        ).alias("http"),
    )
    text = F.to_json(record)
    cut = F.when(event_id % 90 == 0, F.substring(text, 1, 40)).otherwise(text)
    rank = F.when(event_id % 2 == 0, F.lit(1)).otherwise(F.lit(0))
    return events.select(
        cut.alias("value"), _order(rank, event_id).alias("source_order")
    )


def stored_alerts(events: DataFrame) -> DataFrame:
    """The stored alerts table: events whose archive line parses."""
    event_id, k = F.col("event_id"), F.col("k")
    attack = labels.attack_type(F.col("signature"))
    columns = {
        "id": event_id,
        "classification_suricata": F.col("category"),
        "llm_classification": F.when(k == 98, F.lit(None)).when(k == 99, F.lit("error"))
        .when(F.col("value") >= 150, F.lit("hack")).otherwise(F.lit("normal")),
        "attack_type": attack,
        "explanation": F.concat(F.lit("Event "), event_id, F.lit(" looks like "), attack),
        "risk_score": F.least(F.lit(10), F.floor(F.col("value") / 20)),
        "false_positive_likelihood": labels.fp_likelihood(
            F.col("signature"), F.col("priority"), None
        ),
        "ttl": F.when(event_id % 3 == 0, _pick(TTLS, k % 6)).otherwise(F.lit(0)),
        "created_at": F.col("ts"),
    }
    parses = events.filter(event_id % 50 != 49)
    return parses.select(*(
        (columns.get(f.name, F.col(f.name)).alias(f.name)
         if f.name == "created_at"
         else columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name))
        for f in ALERTS.fields
    ))
