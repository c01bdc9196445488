from datetime import datetime

import pytest
from pyspark.sql import functions as F

from data import LINE, lines_frame
from palisade.sources.alert_log import (
    count_lines,
    count_lines_by,
    event_time,
    parse_alert_lines,
    rejected_lines,
    store_alert_lines,
)
from palisade.sources.eve import flow_seconds, parse_flow_lines, parse_ttl_lines
from palisade.sources.lines import read_lines, read_lines_if_present


def test_archive_line_groups(spark):
    row = parse_alert_lines(lines_frame(spark, [LINE]), interface="LAN").first()
    assert row.asDict() == {
        "timestamp": "03/14/2027-21:07:45.310992", "sig_id": "9000777",
        "signature": "NMAP SYN Scan Detected",
        "alert_category": "Probe Of Open Services", "priority": 2,
        "protocol": "TCP", "src_ip": "172.20.4.9", "src_port": 51311,
        "dst_ip": "172.20.8.30", "dst_port": 8080, "interface": "LAN",
        "source_order": (0, "f", 0, 0),
    }


@pytest.mark.parametrize(
    "line, archive, live",
    [
        (LINE, True, True),
        ("  " + LINE, True, True),
        ("prefix " + LINE, True, False),
        (LINE + " trailing", True, True),
        (LINE.replace("[**] [Class", "[**] [Extra: x] [Class"), True, False),
        (LINE.replace("[Priority: 2] ", ""), False, False),
        (LINE.replace("172.20.4.9:51311", "fe80::1:51311"), False, False),
        (LINE.replace(":51311", ""), False, False),
        (LINE.replace("{TCP}", "{IPv6-ICMP}"), False, True),
        (LINE.replace("[1:9000777:1]", "[rule]"), False, True),
        (LINE.replace("03/14/2027-21:07:45.310992", "yesterday"), False, True),
        ("", False, False),
        ("   ", False, False),
    ],
)
def test_which_lines_fit(spark, line, archive, live):
    lines = lines_frame(spark, [line])
    assert parse_alert_lines(lines).count() == int(archive)
    assert parse_alert_lines(lines, grammar="live").count() == int(live)
    assert count_lines(lines).first()["rejected"] == int(not archive)


def test_leftmost_match_and_shortest_signature(spark):
    line = LINE + " " + LINE.replace("NMAP SYN Scan", "Second")
    row = parse_alert_lines(lines_frame(spark, [line])).first()
    assert row["signature"] == "NMAP SYN Scan Detected"


def test_line_holding_the_separator(spark):
    line = LINE.replace("SYN Scan", "SYN\u0001Scan")
    for grammar in ("archive", "live"):
        row = parse_alert_lines(lines_frame(spark, [line]), grammar=grammar).first()
        assert row["signature"] == "NMAP SYN\u0001Scan Detected"
        assert row["dst_port"] == 8080
    assert parse_alert_lines(lines_frame(spark, ["\u0001" * 9])).count() == 0


def test_number_too_large_becomes_null(spark):
    line = LINE.replace(":8080", ":" + "9" * 30)
    assert parse_alert_lines(lines_frame(spark, [line])).first()["dst_port"] is None


def test_event_time(spark):
    frame = spark.createDataFrame(
        [("03/14/2027-21:07:45.310992",), ("junk",), ("03/14/2027-21:07:45.310992999",)], "t string")
    got = [r[0] for r in frame.select(event_time(F.col("t"))).collect()]
    assert got == [datetime(2027, 3, 14, 21, 7, 45, 310992), None,
                   datetime(2027, 3, 14, 21, 7, 45, 310992)]


def test_regex_runs_once_per_line(spark):
    """The plan holds one rewrite of the line, not one per column or filter."""
    parsed = parse_alert_lines(lines_frame(spark, [LINE])).filter(F.col("priority") == 2)
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


EVE = (
    '{"timestamp":"2026-05-29T08:29:12.002018+0000","event_type":"alert","src_ip":"1.1.1.1",'
    '"dest_ip":"2.2.2.2","dest_port":80,"proto":"TCP","flow_id":7,'
    '"flow":{"start":"2026-05-29T08:29:10.002018+0000","bytes_toserver":5}}'
)


@pytest.mark.parametrize(
    "line, kept",
    [
        (EVE, True),
        (EVE.replace('"alert"', '"flow"'), False),
        (EVE.replace('"event_type":"alert",', ""), False),
        ("", False),
        ("   ", False),
        (EVE[:60], False),
        (EVE + " trailing", False),
        (EVE + EVE, False),
        (EVE + "," + EVE, False),
        (EVE.replace('"', "'"), False),
        ("[" + EVE + "]", False),
        ("[1]", False),
        ("1", False),
        ("null", False),
    ],
)
def test_which_flow_lines_count(spark, line, kept):
    assert parse_flow_lines(lines_frame(spark, [line])).count() == int(kept)


def test_flow_columns(spark):
    row = parse_flow_lines(lines_frame(spark, [EVE])).first()
    assert (row["flow_id"], row["dst_port"], row["flow_duration"]) == ("7", 80, 2.0)
    assert (row["flow_bytes"], row["flow_bytes_toclient"]) == (5, None)
    assert row["http_user_agent"] is None


def test_flow_variants(spark):
    text_port = EVE.replace('"dest_port":80', '"dest_port":"80"')
    no_port = EVE.replace('"dest_port":80,', "")
    null_flow = EVE[: EVE.index('"flow":{')] + '"flow":null}'
    agent = EVE[:-1] + ',"http":{"http_user_agent":"curl"}}'
    got = parse_flow_lines(lines_frame(spark, [text_port, no_port, null_flow, agent]))
    rows = got.orderBy("source_order").collect()
    assert [r["dst_port"] for r in rows] == [80, None, 80, 80]
    assert [r["flow_bytes"] for r in rows] == [5, 5, 0, 5]
    assert rows[2]["flow_duration"] is None
    assert rows[3]["http_user_agent"] == "curl"


@pytest.mark.parametrize(
    "a, b, seconds",
    [
        ("2026-05-29T08:00:01.5", "2026-05-29T08:00:01.5", 0.0),
        ("2026-05-29T08:00:00", "2026-05-29T08:00:02.25", 2.25),
        ("2026-05-29T08:00:03Z", "2026-05-29T08:00:01Z", 2.0),
        ("2026-05-29T08:00:03.000001+0000", "2026-05-29T08:00:01+0000", 2.0),
        ("2026-05-29T08:00:03.123456+0000", "2026-05-29T08:00:01.000000+0000", 2.1235),
        ("junk", "2026-05-29T08:00:01", None),
        (None, "2026-05-29T08:00:01", None),
        ("2026-05-29T08:00:01", "", None),
    ],
)
def test_flow_seconds(spark, a, b, seconds):
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    assert frame.select(flow_seconds(F.col("a"), F.col("b"))).first()[0] == seconds


def test_ttl_lines_need_both_keys(spark):
    lines = [
        '{"src_ip":"a","alert":{},"ttl":64}',
        '{"src_ip":"b","alert":null,"ttl":null}',
        '{"src_ip":"c","ttl":64}',
        '{"src_ip":"d","alert":{}}',
        '{"src_ip":"","alert":{},"ttl":64}',
        '{"alert":{},"ttl":64}',
        '{"src_ip":"e","alert":{"ttl":1},"x":"\\"ttl\\""}',
        '{"src_ip":"f","alert":{},"ttl":64',
    ]
    got = parse_ttl_lines(lines_frame(spark, lines)).select("src_ip", "ttl").collect()
    assert sorted(map(tuple, got)) == [("a", 64), ("b", None)]


def test_files_keep_line_order(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"a{n}\n" for n in range(5000)))
    (tmp_path / "b.log").write_text("b0\r\nb1\n")
    lines = read_lines(spark, str(tmp_path))
    got = [r[0] for r in lines.orderBy("source_order").select("value").collect()]
    assert got == [f"a{n}" for n in range(5000)] + ["b0", "b1"]


def test_order_across_splits(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"{n}\n" for n in range(20000)))
    previous = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        lines = read_lines(spark, str(tmp_path / "a.log"))
        assert lines.rdd.getNumPartitions() > 4
        got = [int(r[0]) for r in lines.orderBy("source_order").select("value").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", previous)
    assert got == list(range(20000))


def test_missing_source(spark, tmp_path):
    assert read_lines_if_present(spark, str(tmp_path / "none.log")) is None


@pytest.mark.parametrize("values", [
    [LINE, "noise", "", LINE + " trailing", "   "], [LINE], ["noise"], [],
])
def test_one_scan_leaves_alerts_rejects_and_counts(spark, tmp_path, rows, values):
    lines = lines_frame(spark, values)
    found = store_alert_lines(lines, str(tmp_path / "t"), interface="LAN")
    assert found.alerts.columns == parse_alert_lines(lines, interface="LAN").columns
    assert rows(found.alerts) == rows(parse_alert_lines(lines, interface="LAN"))
    assert rows(found.rejected, *lines.columns) == rows(rejected_lines(lines))
    assert (found.lines, found.rejects) == (len(values), rejected_lines(lines).count())


def test_all_grammars_are_counted_in_one_scan(spark, tmp_path, rows):
    (tmp_path / "a.log").write_text("\n".join([LINE, "x " + LINE, "noise"]) + "\n")
    counts = count_lines_by(read_lines(spark, str(tmp_path)))
    assert rows(counts) == [("archive", 3, 2, 1), ("live", 3, 1, 2)]
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_keys_of_a_ttl_line_are_listed_only_where_a_value_is_null(spark):
    lines = [
        '{"src_ip": "a", "ttl": 1, "alert": {"x": [1]}}', '{"src_ip": "b", "ttl": null, "alert": "x"}',
        '{"src_ip": "c", "ttl": 3, "alert": null}', '{"src_ip": "d", "flow": {"ttl": 4}, "alert": 5}',
        '{"src_ip": "e", "ttl": 5, "flow": {"alert": 1}}', '{"src_ip": "f", "ttl": "6", "alert": {}}',
        '{"src_ip": "g", "ttl": 7, "alert": {}, "x": NaN}', '{"src_ip": "h", "ttl": 8, "ttl": null, "alert": {}}',
        '{"src_ip": "i", "ttl": 9, "alert": {"x": 1}', '{"src_ip": "j", "ttl": 10.5, "alert": []}',
        '{"src_ip": "k", "ttl": 11, "alert": {"x": Infinity}}', "{'src_ip': 'l', \"ttl\": 12, \"alert\": {}}",
    ]
    parsed = parse_ttl_lines(lines_frame(spark, lines))
    assert {r["src_ip"]: r["ttl"] for r in parsed.collect()} == {
        "a": 1, "b": None, "c": 3, "f": None, "h": None, "j": None}
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    keys = "jsonObjectKeys("
    assert plan.count(keys) == plan.count(f"OR array_contains(static_invoke(JsonExpressionUtils.{keys}") == 2, plan
