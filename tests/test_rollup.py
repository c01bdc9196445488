import threading

from pyspark.sql import functions as F

from data import alerts_frame
from palisade.operators import profile, report, rollup, score
from palisade.plans import analytics
from palisade.schemas import ROLLUP
from palisade.sources.lines import stream_lines
from palisade.sources.snapshots import SnapshotTable
from palisade.streaming import ingest
from test_stream import feed, line  # noqa: F401

MIXED = [
    {"src_ip": f"10.0.0.{n % 4}", "dst_port": (n * 7) % 5 - 1, "signature": f"s{n % 3}",
     "attack_type": ["dos", "", None, "exploit"][n % 4], "ttl": n % 3,
     "llm_classification": ["hack", "normal", "hack", None, "hack"][n % 5],
     "risk_score": None if n % 6 == 0 else n % 11}
    for n in range(90)
] + [{"src_ip": None, "dst_port": None, "signature": None}, {"created_at": None, "ttl": 9}]


def test_schema(spark):
    made = rollup.roll_up(alerts_frame(spark, [{}]))
    assert [(f.name, f.dataType.simpleString()) for f in made.schema] == [
        (f.name, f.dataType.simpleString()) for f in ROLLUP
    ]


def test_profiles_from_merged_rollups_equal_those_from_alerts(spark, rows):
    alerts = alerts_frame(spark, MIXED)
    parts = [rollup.roll_up(alerts.filter(F.col("id") % 3 == n)) for n in range(3)]
    kept = rollup.merged(parts[0].unionByName(parts[1])).unionByName(parts[2])
    assert rows(rollup.attacker_profile(kept)) == rows(profile.attacker_profile(alerts))
    assert rows(rollup.attacker_os(kept)) == rows(profile.attacker_os(alerts))
    assert rows(profile.profile_facts(kept)) == rows(profile.profile_facts(profile.port_facts(alerts)))
    some = alerts.select("src_ip").filter("src_ip = '10.0.0.2'").distinct()
    assert rows(rollup.attacker_profile(kept, some)) == rows(profile.attacker_profile(alerts, some))
    assert rollup.attacker_profile(rollup.roll_up(alerts.limit(0))).count() == 0


def test_rows_read_per_batch_stay_flat(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "r"), ROLLUP, bucket_by="src_ip", buckets=8)
    batch = alerts_frame(spark, [{"src_ip": f"10.0.0.{n % 20}", "dst_port": n % 2} for n in range(100)])
    touched = batch.filter("src_ip = '10.0.0.1'")
    read = []
    for n in range(50):
        table.write(rollup.roll_up(batch), n)
        if n % 4 == 3:
            table.merge(rollup.merged, fanout=4)
        if n % 10 == 9:
            read.append(ingest.touched_rollup(table, touched, n + 1).count())
    whole = table.read()
    assert whole.agg(F.sum("hacks")).first()[0] == 5_000
    assert max(read) <= 3 * read[0] and whole.count() < 500
    # the touched bucket only
    assert read[-1] < whole.count() / 2


def test_view_of_the_stored_tables(feed, spark, rows):  # noqa: F811
    signatures = ["NMAP SYN Scan Detected", "Slowloris DoS Attack", "Hello"]
    for file in range(6):
        feed.land(*(
            line(10 * file + n, ip=f"10.0.0.{n % 3}", port=20 + n, signature=signatures[n % 3])
            for n in range(10)
        ))
    feed.run(one_file_per_batch=True, merge_every=2)
    assert feed.alerts().count() == 60
    assert max(p.level for p in feed.tables.rollup_table(spark).manifest()[1]) >= 1
    plain = analytics.analyst_view(feed.alerts(), population_limit=20)
    kept = ingest.stored_view(spark, feed.tables, population_limit=20)
    for name, table in plain.items():
        assert rows(kept[name]) == rows(table), name
    plain.close()
    kept.close()
    profiles = rollup.attacker_profile(ingest.stored_rollup(spark, feed.tables))
    assert all("/attacker_rollup/" in file for file in profiles.inputFiles())
    new = {r[0]: r[1] for r in ingest.batch_counts(spark, feed.tables).collect()}
    assert new == {n: 10 for n in range(6)}
    ingest.maintain(spark, feed.tables, fanout=2, keep_seconds=-1)
    assert rows(ingest.stored_rollup(spark, feed.tables).agg(F.sum("hacks")))[0][0] == report.kpis(
        feed.alerts()).first()["hacks"]


def test_a_reader_never_sees_a_gap(feed, spark):  # noqa: F811
    for n in range(6):
        feed.land(line(2 * n), line(2 * n + 1, signature="Hello"))
    path = str(feed.folder.parent / "kpis")
    assert ingest.current_kpis(spark, path).count() == 0
    scored = score.score_alerts(ingest.parsed_stream(
        stream_lines(spark, str(feed.folder), max_files_per_trigger=1)))
    seen, errors, done = [], [], threading.Event()

    def watch():
        try:
            while not done.is_set():
                seen.append([tuple(r) for r in ingest.current_kpis(spark, path).collect()])
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    thread = threading.Thread(target=watch)
    thread.start()
    ingest.start_kpis(scored, path, path + "-progress", available_now=True).awaitTermination()
    done.set()
    thread.join()
    assert not errors
    figures = [s[0][:2] for s in seen if s]
    assert all(len(s) <= 1 for s in seen) and [] not in seen[len(seen) - len(figures):]
    assert figures == sorted(figures) and all(total == 2 * hacks for total, hacks in figures)
    assert ingest.current_kpis(spark, path).first()["total"] == 12
