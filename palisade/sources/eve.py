"""Flow-log lines (one JSON object per line) to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.schemas import EVE_RECORD, EVE_TTL_RECORD
from palisade.sources.lines import keep_wanted

_STRICT = {"allowSingleQuotes": "false"}


def _records(line: Column, schema: T.StructType, **options: str) -> Column:
    """The line wrapped as a JSON array, so only one whole object yields size 1.

    Parsing the bare line would accept trailing text and would turn a
    truncated object into a row of nulls.
    """
    wrapped = F.concat(F.lit("["), line, F.lit("]"))
    return F.from_json(wrapped, T.ArrayType(schema), {**_STRICT, **options})


def _one_object(records: Column) -> Column:
    return (F.size(records) == 1) & records[0].isNotNull()


def flow_seconds(timestamp: Column, start: Column) -> Column:
    """Distance of the two ISO texts in seconds, 4 decimals; null if unusable."""

    def moment(text: Column) -> Column:
        plain = F.substring(text, 1, 26)
        for zone in ("+0000", "Z"):
            plain = F.replace(plain, F.lit(zone), F.lit(""))
        dated = F.when(plain.rlike(r"^\d{4}-\d{2}-\d{2}"), plain)
        return dated.try_cast("timestamp_ntz")

    micros = F.timestamp_diff("MICROSECOND", moment(start), moment(timestamp))
    return F.round(F.abs(micros) / F.lit(1_000_000.0), 4)


def parse_flow_lines(lines: DataFrame) -> DataFrame:
    """Flow columns of every well-formed ``alert`` record.

    ``lines`` is static or streaming with a text column ``value``; its other
    columns are kept. Blank lines, broken JSON, anything but a single object
    and other event types are dropped.
    """
    parsed = keep_wanted(
        lines,
        _records(F.col("value"), EVE_RECORD),
        lambda records: _one_object(records)
        & (records[0]["event_type"] == F.lit("alert")),
        "records",
    )
    record = F.col("records")[0]
    flow, http = record["flow"], record["http"]
    to_server, to_client = flow["bytes_toserver"], flow["bytes_toclient"]
    zero = F.lit(0).cast("bigint")
    carried = [c for c in lines.columns if c != "value"]
    return parsed.select(
        F.coalesce(record["flow_id"], F.lit("")).alias("flow_id"),
        record["src_ip"].alias("src_ip"),
        record["src_port"].try_cast("bigint").alias("src_port"),
        record["dest_ip"].alias("dst_ip"),
        record["dest_port"].try_cast("bigint").alias("dst_port"),
        record["proto"].alias("protocol"),
        record["app_proto"].alias("app_proto"),
        record["direction"].alias("direction"),
        to_server.alias("flow_bytes_toserver"),
        to_client.alias("flow_bytes_toclient"),
        (F.coalesce(to_server, zero) + F.coalesce(to_client, zero)).alias("flow_bytes"),
        flow["pkts_toserver"].alias("pkts_toserver"),
        flow["pkts_toclient"].alias("pkts_toclient"),
        flow_seconds(record["timestamp"], flow["start"]).alias("flow_duration"),
        http["http_user_agent"].alias("http_user_agent"),
        record["payload_printable"].alias("payload_printable"),
        *carried,
    )


def parse_ttl_lines(lines: DataFrame) -> DataFrame:
    """``src_ip``, ``ttl`` of records that carry both an alert and a TTL key.

    A key that is present with a null value counts as present, which only the
    key list of the object can tell; it is made where a value is null. The text
    test in front spares the JSON parse for lines that cannot qualify.
    """
    value = F.col("value")
    likely = F.contains(value, F.lit('"ttl"')) & F.contains(value, F.lit('"alert"'))
    parsed = F.when(
        likely,
        F.struct(
            # as strict as the key list, which takes no NaN or Infinity
            _records(value, EVE_TTL_RECORD, allowNonNumericNumbers="false").alias("records"),
            value.alias("text"),
        ),
    )

    def wanted(line: Column) -> Column:
        records, keys = line["records"], F.json_object_keys(line["text"])

        def present(key: str) -> Column:
            return records[0][key].isNotNull() | F.array_contains(keys, key)

        return (
            _one_object(records)
            & (F.coalesce(records[0]["src_ip"], F.lit("")) != F.lit(""))
            & present("alert")
            & present("ttl")
        )

    kept = keep_wanted(lines, parsed, wanted, "parsed")
    record = F.col("parsed.records")[0]
    carried = [c for c in lines.columns if c != "value"]
    return kept.select(record["src_ip"].alias("src_ip"), record["ttl"].alias("ttl"), *carried)
