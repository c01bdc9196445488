from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from data import alerts_frame, shuffled
from palisade import schemas
from palisade.operators import profile, report
from palisade.plans import analytics
from palisade.plans.analytics import analyst_view
from palisade.sources import tables


def test_newest_breaks_ties_by_id(spark):
    same = datetime(2026, 5, 29, 8, 0, 0)
    alerts = shuffled(alerts_frame(spark, [{"created_at": same}] * 6))
    assert [r["id"] for r in report.newest_alerts(alerts, 4).collect()] == [5, 4, 3, 2]
    assert [r["id"] for r in report.newest_stored_alerts(alerts, 4).collect()] == [5, 4, 3, 2]
    assert report.newest_alerts(alerts, None).count() == 6
    assert report.newest_stored_alerts(alerts, 100).count() == 6
    assert report.recent_listing(alerts).columns == list(schemas.RECENT_COLUMNS)


def test_newest_from_a_stored_table_reads_one_column_first(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alerts_frame(spark, [{}] * 50).write.parquet(path)
    frame = report.newest_stored_alerts(spark.read.parquet(path), 5)
    assert len(frame.collect()) == 5
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<created_at:timestamp>" in plan
    assert "GreaterThanOrEqual(created_at,ScalarSubquery" in plan


def test_figures_of_nothing(spark):
    none = alerts_frame(spark, [])
    assert set(report.kpis(none).first().asDict().values()) == {0}
    assert report.fp_suppression(none).first().asDict() == {
        "suppression_rate": 0.0, "suppressed": 0, "confirmed": 0, "shown": 0}
    assert report.accuracy_report(none).count() == 8


def test_figures(spark):
    alerts = alerts_frame(spark, [
        {"risk_score": 8, "false_positive_likelihood": 69},
        {"risk_score": 7, "false_positive_likelihood": 70, "llm_classification": "normal"},
        *[{"llm_classification": "normal"}] * 6,
    ])
    assert report.kpis(alerts).first().asDict() == {
        "total": 8, "hacks": 1, "critical": 1, "suppressed": 1,
        "hack_percent": 12, "suppressed_percent": 12}
    assert report.fp_suppression(alerts).first().asDict() == {
        "suppression_rate": 12.5, "suppressed": 1, "confirmed": 1, "shown": 7}


def test_filters(spark, rows):
    alerts = alerts_frame(spark, [
        {"attack_type": "dos"}, {"attack_type": "info_leak"},
        {"llm_classification": "error"}, {"false_positive_likelihood": 70},
        {"risk_score": 1}, {"attack_type": "other", "risk_score": 10},
    ])
    assert rows(report.filter_alerts(alerts), "id") == [(0,), (4,), (5,)]
    assert rows(report.filter_alerts(alerts, min_risk=5), "id") == [(0,), (5,)]
    everything = report.filter_alerts(
        alerts, hide_false_positives=False, verdicts=(), attack_types=())
    assert everything.count() == 6


def test_accuracy(spark):
    alerts = alerts_frame(spark, [
        *[{"signature": "NMAP SYN Scan Detected"}] * 4,
        {"signature": "NMAP SYN Scan Detected", "llm_classification": "normal"},
        {"signature": "FTP Brute Force Attempt", "llm_classification": None},
        {"signature": "unlisted"},
    ])
    got = {r["signature"]: r for r in report.accuracy_report(alerts).collect()}
    assert len(got) == 8
    scan, ftp = got["NMAP SYN Scan Detected"], got["FTP Brute Force Attempt"]
    assert (scan["alerts"], scan["correct"], scan["accuracy"], scan["status"]) == (5, 4, 80, "pass")
    assert (ftp["alerts"], ftp["correct"], ftp["accuracy"], ftp["status"]) == (1, 0, 0, "fail")
    overall = report.accuracy_overall(report.accuracy_report(alerts)).first()
    assert overall.asDict() == {"correct": 4, "alerts": 6, "accuracy": 67}


def test_counts_and_timeline(spark):
    alerts = alerts_frame(spark, [
        {"attack_type": "dos"}, {"attack_type": "dos"}, {"attack_type": "other"},
        {"attack_type": "malware_c2", "llm_classification": "normal"}])
    assert [tuple(r) for r in report.attack_type_counts(alerts).collect()] == [
        ("dos", 2, "DoS"), ("malware_c2", 1, "malware_c2")]
    assert [tuple(r) for r in report.verdict_counts(alerts).collect()] == [("hack", 3), ("normal", 1)]
    times = [r["time"] for r in report.risk_timeline(shuffled(alerts)).collect()]
    assert times == sorted(times)


def test_feed(spark):
    alerts = alerts_frame(spark, [
        {"signature": "x" * 60, "timestamp": "05/29/2026-08:29:12.002018", "risk_score": 9,
         "false_positive_likelihood": 40, "attack_type": "web_scan"}] + [{}] * 70)
    feed = report.alert_feed(alerts)
    assert feed.count() == 60
    row = report.alert_feed(alerts.filter("id = 0")).first()
    assert (row["signature"], row["title"], row["time"]) == ("x" * 48 + "…", "x" * 55, "05/29/2026-08:29:12")
    assert (row["bar_width"], row["risk_class"], row["fp_band"], row["attack_label"]) == (
        54, "critical", "amber", "Web Scan")


def test_view_has_every_table(spark):
    view = analyst_view(alerts_frame(spark, [{}] * 3), min_risk=6)
    counts = {name: frame.count() for name, frame in view.items()}
    assert counts == {
        "kpis": 1, "verdict_counts": 1, "attack_type_counts": 1, "risk_timeline": 3,
        "attackers": 1, "fp_suppression": 1, "feed_count": 1, "alert_feed": 0, "accuracy_report": 8,
        "accuracy_overall": 1}
    whole = analyst_view(alerts_frame(spark, [{}] * 600), population_limit=None)
    assert whole["kpis"].first()["total"] == 600


# --- stored tables --------------------------------------------------------------


def test_absent_table_is_empty(spark, tmp_path):
    for schema in (schemas.ALERTS, schemas.PROFILES):
        frame = tables.read_table(spark, str(tmp_path / "none"), schema)
        assert frame.count() == 0 and frame.schema == schema


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    path, frame = str(tmp_path / "t"), alerts_frame(spark, [{}] * 3)
    for batch in (0, 1, 1, 0):
        tables.write_batch(frame, path, batch)
    stored = tables.read_table(spark, path, tables.with_batch_id(schemas.ALERTS))
    assert sorted((r[0], r[1]) for r in stored.groupBy("batch_id").count().collect()) == [(0, 3), (1, 3)]


def test_added_column(spark, rows):
    old = spark.createDataFrame([(1,)], "id bigint")
    new = spark.createDataFrame([(2, 64), (3, None)], "id bigint, ttl bigint")
    field = T.StructField("ttl", T.LongType())
    assert rows(tables.add_column(old, field, 0)) == [(1, 0)]
    assert rows(tables.add_column(new, field, 0)) == [(2, 64), (3, 0)]
    assert rows(tables.union_with_defaults([old, new], {"ttl": 0})) == [(1, 0), (2, 64), (3, 0)]


def test_cleared_table(spark, tmp_path):
    path = str(tmp_path / "t")
    alerts_frame(spark, [{}] * 3).write.parquet(path)
    assert tables.clear_table(spark, path, schemas.ALERTS) == 0
    assert tables.read_table(spark, path, schemas.ALERTS).count() == 0


@pytest.mark.parametrize("text", ['plain', 'a "quoted", b', "back\\slash", "", "a\nb", "a\r\nb", "a\rb"])
def test_csv_values_survive(spark, tmp_path, text):
    frame = spark.createDataFrame([(1, text)], "n bigint, s string")
    path = str(tmp_path / "csv")
    tables.write_csv(frame, path)
    back = tables.read_csv(spark, path, frame.schema).first()
    assert (back["s"] or "") == text


def test_a_refresh_sees_what_other_writers_added(spark, tmp_path):
    path = str(tmp_path / "alerts")
    alerts_frame(spark, [{}] * 3).write.parquet(path)
    with analytics.analyst_view(spark.read.parquet(path)) as first:
        assert first["kpis"].first()["total"] == 3
    again = analytics.analyst_view(spark.read.parquet(path))
    assert again["kpis"].first()["total"] == 3
    alerts_frame(spark, [{}] * 3).write.mode("append").parquet(path)
    view = analytics.analyst_view(spark.read.parquet(path))  # the one before is still open
    assert view["kpis"].first()["total"] == 6
    assert view["feed_count"].first()["alerts"] == 6
    card = view["attackers"].first()
    assert (card["os"], card["assessed"]) == (profile.attacker_os(spark.read.parquet(path)).first()["os"], False)
    again.close()
    view.close()


def test_feed_without_limit_is_newest_first(spark):
    alerts = alerts_frame(spark, [{}] * 5)
    assert [r["id"] for r in report.alert_feed(alerts, None).collect()] == [4, 3, 2, 1, 0]


def test_null_verdicts_are_not_counted(spark):
    alerts = alerts_frame(spark, [{}, {"llm_classification": None}])
    assert [tuple(r) for r in report.verdict_counts(alerts).collect()] == [("hack", 1)]
