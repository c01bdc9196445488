import json
import os

import pandas as pd
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from data import LINE
from palisade.operators import profile, report, score
from palisade.operators.enrich import newest_ttl
from palisade.session import STREAM_DEFAULTS
from palisade.sources import tables
from palisade.sources.alert_log import parse_alert_lines
from palisade.sources.lines import read_lines, stream_lines
from palisade.streaming import ingest


def line(n, ip="10.0.0.1", port=80, signature="NMAP SYN Scan Detected", priority=1):
    return (
        f"05/29/2026-08:29:{n % 60:02}.{n:06}  [**] [1:1:1] {signature} [**] "
        f"[Classification: c] [Priority: {priority}] {{TCP}} {ip}:{1000 + n} -> 192.168.1.1:{port}"
    )


class Feed:
    """A folder of landed files and the tables fed from it."""

    def __init__(self, spark, root):
        self.spark, self.folder = spark, root / "landing"
        self.folder.mkdir()
        self.tables = ingest.Tables.below(str(root / "store"))
        self.files = 0

    def land(self, *lines):
        self.files += 1
        file = self.folder / f"{self.files:03}.log"
        file.write_text("".join(f"{x}\n" for x in lines))
        # a second apart, so that files are taken in landing order
        os.utime(file, (1_700_000_000 + self.files,) * 2)

    def run(self, one_file_per_batch=False, **options):
        limit = 1 if one_file_per_batch else None
        lines = stream_lines(self.spark, str(self.folder), max_files_per_trigger=limit)
        ingest.start_ingest(lines, self.tables, available_now=True, **options).awaitTermination()

    def alerts(self):
        return ingest.stored_alerts(self.spark, self.tables)

    def profiles(self):
        return {r["src_ip"]: r for r in ingest.stored_profiles(self.spark, self.tables).collect()}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path)


def test_stream_equals_batch_and_survives_restart(feed, spark, rows):
    feed.land(line(1), line(2, ip="10.0.0.2"), "junk", line(1), "")
    feed.run()
    feed.land(line(3), line(2, ip="10.0.0.2"))
    feed.land(line(1), line(4, signature="Hello"))
    feed.run(one_file_per_batch=True)
    lines = read_lines(spark, str(feed.folder)).select("value").distinct()
    batch = score.score_alerts(parse_alert_lines(lines, grammar="live"))
    columns = ["timestamp", "signature", "src_ip", "llm_classification", "risk_score"]
    assert rows(feed.alerts(), *columns) == rows(batch, *columns)
    ids = [r[0] for r in feed.alerts().select("id").collect()]
    assert len(set(ids)) == len(ids) == 4
    # in-batch ids follow log time, later batches have larger ids
    by_id = [r["timestamp"] for r in feed.alerts().orderBy("id").collect()]
    assert by_id == sorted(by_id)
    feed.run()
    assert feed.alerts().count() == 4
    new = {r[0]: r[1] for r in ingest.batch_counts(spark, feed.tables).collect()}
    assert sorted(new.values()) == [1, 1, 2]


def test_profile_once_at_the_second_hack(feed):
    feed.land(line(1, port=22), line(2, ip="10.0.0.9", signature="Hello"))
    feed.run()
    assert feed.profiles() == {}
    feed.land(line(3, port=443), line(4, signature="Hello", port=8080))
    feed.run()
    first = feed.profiles()
    assert set(first) == {"10.0.0.1"}
    row = first["10.0.0.1"]
    assert (row["attack_count"], row["ports_targeted"]) == (2, "22, 443, 8080")
    assert row["recommended_response"] == "Block 10.0.0.1"
    assert " to " in row["time_span"] and row["created_at"] == row["updated_at"]
    feed.land(line(5, port=21), line(6, port=25))
    feed.run()
    assert feed.profiles() == first


def test_repeated_batch_adds_nothing(feed, spark, rows):
    feed.land(line(1), line(2), line(3, ip="10.0.0.2"))
    feed.run()
    before, profiles = rows(feed.alerts()), feed.profiles()
    stored = feed.tables.alert_table(spark).read().cache()
    (batch_id,) = {r[0] for r in stored.select("batch_id").distinct().collect()}
    again = spark.createDataFrame(stored.collect(), stored.schema).withColumn("line_hash", F.unhex(F.md5("timestamp")))
    again = again.drop("id", "batch_id")
    ingest.profile_batch(ingest.store_batch(again, batch_id, feed.tables), batch_id, feed.tables)
    spark.catalog.clearCache()
    assert rows(feed.alerts()) == before
    assert feed.profiles() == profiles


def test_ttl_scorer_and_assessor(feed, spark):
    def scorer(batch: pd.DataFrame):
        return [{"classification": "hack", "attack_type": "dos", "risk_score": 9}] * len(batch)

    def assessor(batch: pd.DataFrame):
        return [{"objective": f"{n} attacks"} for n in batch["attack_count"]]

    ttl = spark.createDataFrame([("10.0.0.1", 64)], "src_ip string, ttl bigint")
    feed.land(line(1), line(2), line(3, ip="10.0.0.2"))
    feed.run(ttl=lambda: ttl, scorer=scorer, assessor=assessor)
    got = {(r["src_ip"], r["ttl"], r["explanation"]) for r in feed.alerts().collect()}
    assert got == {("10.0.0.1", 64, ""), ("10.0.0.2", 0, "")}
    (found,) = feed.profiles().values()
    assert (found["objective"], found["skill_level"]) == ("2 attacks", "unknown")


@pytest.mark.parametrize("salts", [1, 16])
def test_hot_line_counts_once(feed, spark, rows, salts):
    for _ in range(4):
        feed.land(*[LINE] * 200, *(line(n) for n in range(20)))
    path = str(feed.folder.parent / "distinct")
    for _ in range(2):
        stream = ingest.distinct_lines(
            stream_lines(spark, str(feed.folder), max_files_per_trigger=2), salts=salts)
        stream.writeStream.format("parquet").option(
            "checkpointLocation", path + "-progress"
        ).trigger(availableNow=True).start(path).awaitTermination()
        feed.land(LINE, line(3))
    values = [r[0] for r in spark.read.parquet(path).select("value").collect()]
    assert sorted(values) == sorted([LINE, *(line(n) for n in range(20))])


def test_key_figures_of_a_stream(feed, spark):
    feed.land(line(1), line(2, signature="Hello"))
    feed.land(line(1), line(3, priority=2))
    path = str(feed.folder.parent / "kpis")
    for _ in range(2):
        stream = stream_lines(spark, str(feed.folder), max_files_per_trigger=1)
        scored = score.score_alerts(ingest.parsed_stream(stream))
        ingest.start_kpis(scored, path, path + "-progress", available_now=True).awaitTermination()
        feed.land(line(4))
    figures = ingest.current_kpis(spark, path).first()
    assert (figures["total"], figures["hacks"], figures["critical"]) == (4, 3, 3)
    lines = read_lines(spark, str(feed.folder)).select("value").distinct()
    batch = report.kpis(score.score_alerts(parse_alert_lines(lines, grammar="live")))
    assert batch.first() == figures


def test_live_and_stored_profiles_agree(feed, spark, rows):
    feed.land(*(line(n, ip=f"10.0.0.{n % 5}", port=n) for n in range(40)))
    feed.run()
    facts = profile.profile_facts(profile.port_facts(feed.alerts()))
    expected = rows(score.assess_profiles(facts), "src_ip", "attack_count", "ports_targeted", "objective")
    stored = ingest.stored_profiles(spark, feed.tables)
    assert rows(stored, "src_ip", "attack_count", "ports_targeted", "objective") == expected


def test_files_with_old_dates_are_stored(feed):
    feed.land(line(1))
    feed.run()
    feed.land(line(2), line(3))
    old = feed.folder / f"{feed.files:03}.log"
    os.utime(old, (1_700_000_000 - 30 * 86_400,) * 2)
    feed.run()
    feed.land(line(4))
    feed.run()
    assert feed.alerts().count() == 4


def test_ids_run_on_over_batches(feed):
    for n in range(3):
        feed.land(line(2 * n), line(2 * n + 1))
    feed.run(one_file_per_batch=True)
    assert sorted(r[0] for r in feed.alerts().select("id").collect()) == [1, 2, 3, 4, 5, 6]


def test_a_rerun_without_rows_clears_the_batch(spark, tmp_path):
    path = str(tmp_path / "batches")
    tables.write_batch(spark.range(3), path, 7)
    tables.write_batch(spark.range(2), path, 8)
    tables.write_batch(spark.range(0), path, 7)
    schema = tables.with_batch_id(spark.range(0).schema)
    assert {r["batch_id"] for r in tables.read_table(spark, path, schema).collect()} == {8}


def test_an_outage_costs_one_call(spark):
    calls, fallbacks = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def down(batch):
        calls.add(1)
        raise score.ScorerUnavailable

    alerts = parse_alert_lines(
        spark.createDataFrame([(line(n),) for n in range(256)], "value string").coalesce(1),
        grammar="live",
    )
    scored = score.score_alerts(alerts, down, fallbacks=fallbacks).collect()
    assert len(scored) == 256 and calls.value == 1 and fallbacks.value == 256


def test_assessor_gets_the_sequence_over_batches(feed):
    feed.land(line(1), line(2, signature="FTP Brute Force Attempt", ip="10.0.0.2"))
    feed.land(line(3, signature="Slowloris DoS Attack"), line(4, signature="NMAP SYN Scan Detected"))
    feed.run(
        one_file_per_batch=True,
        assessor=lambda batch: [{"methodology": s} for s in batch["attack_sequence"]],
    )
    assert {k: v["methodology"] for k, v in feed.profiles().items()} == {
        "10.0.0.1": "port_scan → dos → port_scan"
    }


def test_assessor_gets_a_long_sequence_whole(feed):
    feed.land(*(line(n) for n in range(10_003)), line(10_019, signature="Slowloris DoS Attack"))
    feed.run(assessor=lambda batch: [{"methodology": s} for s in batch["attack_sequence"]])
    steps = feed.profiles()["10.0.0.1"]["methodology"].split(" → ")
    assert steps == ["port_scan"] * 10_003 + ["dos"]


def test_assessor_gets_as_many_steps_as_asked_for(feed):
    feed.land(*(line(n) for n in range(5)))
    feed.run(max_sequence=3, assessor=lambda batch: [{"methodology": s} for s in batch["attack_sequence"]])
    assert feed.profiles()["10.0.0.1"]["methodology"] == " → ".join(["port_scan"] * 3)


def test_lines_may_be_forgotten_after_a_time(spark, tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    (folder / "1.log").write_text("a\nb\na\n" * 50)
    once = ingest.distinct_lines(stream_lines(spark, str(folder)), forget_after="30 days")
    query = once.writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "progress")
    ).trigger(availableNow=True).start(str(tmp_path / "out"))
    query.awaitTermination()
    assert sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def flow(ip, ttl, **other):
    return json.dumps({"src_ip": ip, "ttl": ttl, "alert": {}, **other})


def flow_feed(feed, folder, **options):
    lines = stream_lines(feed.spark, str(folder), max_files_per_trigger=1, ordered=True)
    ingest.start_flow_ingest(lines, feed.tables, available_now=True, **options).awaitTermination()


def land_flows(folder, n, lines):
    folder.mkdir(exist_ok=True)
    file = folder / f"{9 - n}.json"  # names fall as times rise
    file.write_text("".join(f"{x}\n" for x in lines))
    os.utime(file, (1_700_000_000 + n,) * 2)


@pytest.mark.parametrize("merge_every", [None, 2])
def test_ttl_of_a_flow_stream_is_the_last_one_landed(feed, spark, merge_every):
    folder = feed.folder.parent / "flows"
    land_flows(folder, 1, [flow("10.0.0.1", n) for n in range(1000)] + ["junk", "", flow("10.0.0.2", 5)])
    land_flows(folder, 2, [flow("10.0.0.1", 9), flow("10.0.0.3", None), flow("10.0.0.1", 8)])
    flow_feed(feed, folder, merge_every=merge_every)
    land_flows(folder, 3, ["{}"])
    land_flows(folder, 4, [flow("10.0.0.2", 6), flow("", 1), flow("10.0.0.2", 7)])
    land_flows(folder, 5, [flow("10.0.0.4", 1)])
    flow_feed(feed, folder, merge_every=merge_every)
    expected = {"10.0.0.1": 8, "10.0.0.2": 7, "10.0.0.3": None, "10.0.0.4": 1}
    assert dict(ingest.known_ttl(spark, feed.tables).collect()) == expected
    two = spark.createDataFrame([("10.0.0.2",), ("10.0.0.2",), ("10.9.9.9",)], "src_ip string")
    assert dict(ingest.known_ttl(spark, feed.tables, two).collect()) == {"10.0.0.2": 7}
    feed.land(line(1), line(2, ip="10.0.0.2"), line(3, ip="10.9.9.9"))
    feed.run()
    got = {r["src_ip"]: r["ttl"] for r in feed.alerts().collect()}
    assert got == {"10.0.0.1": 8, "10.0.0.2": 7, "10.9.9.9": 0}


def test_flow_lines_are_parsed_once(feed, spark):
    """A later batch leaves earlier rows alone, and a batch run again replaces its own."""
    folder = feed.folder.parent / "flows"
    for n in range(1, 5):
        land_flows(folder, n, [flow(f"10.0.0.{n}", n)] * 50 + [flow("10.0.0.9", n)])
    flow_feed(feed, folder, merge_every=None)
    table = feed.tables.ttl_table(spark)
    _, parts = table.manifest()
    assert [p.rows for p in parts] == [2] * 4
    table.write(table.read().filter("batch_id = 3").drop("batch_id"), 3)
    assert [p.rows for p in table.manifest()[1]] == [2] * 4
    table.merge(newest_ttl, fanout=3)
    assert sorted(p.rows for p in table.manifest()[1]) == [2, 4]
    assert dict(ingest.known_ttl(spark, feed.tables).collect()) == {
        **{f"10.0.0.{n}": n for n in range(1, 5)}, "10.0.0.9": 4}


def test_no_flow_lines_no_ttl(feed, spark):
    assert ingest.known_ttl(spark, feed.tables).collect() == []
    feed.land(line(1))
    feed.run()
    assert [r["ttl"] for r in feed.alerts().collect()] == [0]


def test_assessor_reads_a_long_sequence_part_by_part(feed):
    def assessor(source, texts):
        parts = list(texts)
        if source == "10.0.0.3":
            raise RuntimeError("no answer")
        return {"methodology": " → ".join(parts), "objective": len(parts), "skill_level": None}

    feed.land(*(line(n) for n in range(20_003)), line(20_039, signature="Slowloris DoS Attack"),
              *(line(n, ip="10.0.0.2") for n in range(3)), *(line(n, ip="10.0.0.3") for n in range(2)))
    feed.run(sequence_assessor=assessor)
    found = feed.profiles()
    assert found["10.0.0.1"]["methodology"].split(" → ") == ["port_scan"] * 20_003 + ["dos"]
    assert found["10.0.0.1"]["objective"] == "3" and found["10.0.0.1"]["skill_level"] is None
    assert found["10.0.0.1"]["recommended_response"] == "Block 10.0.0.1"
    assert found["10.0.0.2"]["methodology"] == " → ".join(["port_scan"] * 3)
    assert found["10.0.0.3"]["methodology"] == "unknown" and found["10.0.0.3"]["attack_count"] == 2


def test_parts_an_assessor_leaves_unread(spark, rows):
    parts = spark.range(40).selectExpr(
        "concat('s', id % 4) AS src_ip", "id div 4 AS part", "cast(id AS string) AS attack_sequence")
    first = score.assess_sequences(parts.repartition(7), lambda source, texts: {"methodology": next(texts)})
    assert rows(first, "src_ip", "methodology") == [(f"s{n}", str(n)) for n in range(4)]
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert rows(score.assess_sequences(parts.limit(0), lambda s, t: {})) == []


def test_many_sources_are_assessed_by_all_cores_in_one_pass_each(spark):
    """Small sequences of many sources: tasks are not made few, nor Python called anew for each."""
    parts = spark.range(0, 9_000, 1, 3).selectExpr(
        "concat('s', id % 3000) AS src_ip", "id div 3000 AS part", "concat(id % 3000, '.', id div 3000) AS attack_sequence")
    parts = parts.unionAll(spark.sql("SELECT cast(NULL AS string), 0L, 'n'"))

    def assessor(source, texts):
        return {"methodology": ",".join(texts), "objective": TaskContext.get().partitionId()}

    assessed = score.assess_sequences(parts, assessor)
    found = {r["src_ip"]: r for r in assessed.collect()}
    assert {k: v["methodology"] for k, v in found.items()} == {
        None: "n", **{f"s{n}": f"{n}.0,{n}.1,{n}.2" for n in range(3000)}}
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r["objective"] for r in found.values()} == {str(n) for n in range(partitions)}
    assert "FlatMapGroupsInPandas" not in assessed._jdf.queryExecution().executedPlan().toString()


def test_lines_are_counted_while_they_are_ingested(feed):
    feed.land(line(1), "junk", line(2))
    feed.land(line(1), "more junk", line(3))
    lines = stream_lines(feed.spark, str(feed.folder), max_files_per_trigger=1)
    query = ingest.start_ingest(lines, feed.tables, available_now=True)
    query.awaitTermination()
    assert ingest.line_counts(query) == {"lines": 5, "parsed": 3, "rejected": 2}


def test_a_stream_of_a_plain_session_runs_no_batch_without_data(feed, spark):
    plain = spark.newSession()
    for key in STREAM_DEFAULTS:
        plain.conf.unset(key)
    feed.spark = plain
    feed.land(line(1), line(2), line(1))
    feed.run()
    assert feed.alerts().count() == 2
    offsets = os.listdir(os.path.join(feed.tables.checkpoint, "offsets"))
    assert [name for name in offsets if name.isdigit()] == ["0"]
    assert [plain.conf.get(key, None) for key in STREAM_DEFAULTS] == [None] * len(STREAM_DEFAULTS)
