import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from data import lines_frame, shuffled
from palisade.fixed_values import DATASET_COLUMNS
from palisade.operators import dataset as ds
from palisade.operators import enrich, report
from palisade.plans.dataset import build_dataset, run
from palisade.schemas import DATASET, SOURCE_ORDER
from palisade.sources.alert_log import parse_alert_lines
from palisade.sources.eve import parse_flow_lines
from palisade.sources.tables import write_dataset

KEY = ("1.1.1.1", "2.2.2.2", 80, "TCP")
FLOW_SCHEMA = (
    "src_ip string, dst_ip string, dst_port bigint, protocol string, app_proto string, "
    "direction string, flow_bytes bigint, flow_bytes_toserver bigint, "
    "flow_bytes_toclient bigint, pkts_toserver bigint, pkts_toclient bigint, "
    "flow_duration double, http_user_agent string, payload_printable string, "
    f"source_order {SOURCE_ORDER.simpleString()}"
)


def flow(rank, line, key=KEY, app=None, direction=None, size=0):
    return (*key, app, direction, size, None, None, None, None, None, None, None,
            (rank, "f", 0, line))


def alert_lines(spark):
    """100 lines with the counts of a known sample capture."""
    kinds = [
        ("NMAP SYN Scan Detected", 2, 80, 25),
        ("Web Application Scan Detected", 1, 80, 21),
        ("HTTP DoS Attack Detected", 2, 80, 20),
        ("SURICATA SMB malformed request dialects", 3, 445, 12),
        ("Slowloris DoS Attack", 2, 80, 10),
        ("SURICATA Applayer Detect protocol only one direction", 3, 21, 5),
        ("SURICATA HTTP Host header ambiguous", 3, 80, 3),
        ("SURICATA HTTP Host header invalid", 3, 80, 2),
        ("NMAP FIN Stealth Scan", 2, 113, 1),
        ("FTP Brute Force Attempt", 1, 21, 1),
    ]
    values = []
    for signature, priority, port, times in kinds:
        for _ in range(times):
            n = len(values)
            values.append(
                f"05/29/2026-08:{59 - n % 30}:{n % 60:02}.{n:06}  [**] [1:90{n:05}:1] {signature} "
                f"[**] [Classification: Some Class] [Priority: {priority}] {{TCP}} "
                f"192.168.10.2:{40000 + n} -> 192.168.1.100:{port}"
            )
    return lines_frame(spark, values)


def test_sample_capture(spark):
    parsed = parse_alert_lines(alert_lines(spark), interface="OPT1")
    unmatched = parse_flow_lines(lines_frame(spark, [
        '{"event_type":"alert","src_ip":"9.9.9.9","dest_ip":"8.8.8.8","dest_port":1,"proto":"TCP"}'
    ]))
    for flows, scores in ((None, {10: 78, 80: 22}), (unmatched, {0: 78, 70: 22})):
        built = build_dataset(parsed, flows).cache()
        assert built.columns == list(DATASET_COLUMNS)
        assert built.schema.simpleString() == DATASET.simpleString()
        assert dict(map(tuple, built.groupBy("fp_likelihood").count().collect())) == scores
        assert dict(map(tuple, built.groupBy("attack_type").count().collect())) == {
            "dos": 30, "port_scan": 26, "web_scan": 21, "exploit": 12, "other": 10,
            "brute_force": 1}
        assert dict(map(tuple, built.groupBy("ground_truth").count().collect())) == {
            "true_positive": 78, "false_positive": 22}
        times = [r[0] for r in built.select("timestamp").collect()]
        assert times == sorted(times) and len(times) == 100


def test_summary_takes_first_non_null_of_each_column(spark, rows):
    flows = spark.createDataFrame(
        [
            flow(1, 0, app="late", direction="late", size=7),
            flow(0, 5, app=None, direction="second", size=1),
            flow(0, 9, app="third", direction=None, size=2),
            flow(0, 1, key=("x", "y", None, "UDP")),
        ],
        FLOW_SCHEMA,
    )
    for frame in (flows, shuffled(flows), shuffled(flows, 3)):
        got = rows(enrich.flow_summary(frame), "src_ip", "app_proto", "direction",
                   "flow_bytes", "http_user_agent")
        assert got == [("1.1.1.1", "third", "second", 1, None), ("x", None, None, 0, None)]


def test_null_and_other_keys_do_not_join(spark):
    flows = spark.createDataFrame(
        [flow(0, 0, key=("1.1.1.1", "2.2.2.2", None, "TCP"), size=5),
         flow(0, 1, key=("1.1.1.1", "2.2.2.2", 80, "tcp"), size=5)], FLOW_SCHEMA)
    alerts = spark.createDataFrame(
        [("1.1.1.1", "2.2.2.2", 80, "TCP"), ("1.1.1.1", "2.2.2.2", None, "TCP")],
        "src_ip string, dst_ip string, dst_port bigint, protocol string")
    joined = enrich.join_flows(alerts, enrich.flow_summary(flows))
    assert [r["flow_bytes"] for r in joined.collect()] == [None, None]


def _copies(spark):
    schema = (
        "timestamp string, signature string, src_ip string, dst_ip string, dst_port bigint, "
        f"src_port bigint, interface string, source_order {SOURCE_ORDER.simpleString()}"
    )
    same = ("t", "s", "1.1.1.1", "2.2.2.2", 80)
    return spark.createDataFrame(
        [
            (*same, 5, "LAN", (1, "a", 0, 0)),
            (*same, 6, "OPT1", (0, "b", 0, 4)),
            (*same, 7, "OPT1", (0, "b", 0, 3)),
            (*same, 8, "OPT1", (0, "b", 9, 1)),
            ("t", "s", "1.1.1.1", "2.2.2.2", 81, 9, "LAN", (1, "a", 0, 1)),
        ],
        schema,
    )


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_first_copy_stays(spark, rows, partitions):
    got = rows(ds.drop_repeats(shuffled(_copies(spark), partitions)), "dst_port", "src_port")
    assert got == [(80, 7), (81, 9)]


def test_copies_are_thinned_before_the_shuffle(spark):
    """However hot a duplicate key is, a map task sends one row of it."""
    plan = ds.drop_repeats(_copies(spark))._jdf.queryExecution().executedPlan().toString()
    shuffle = plan.index("Exchange hashpartitioning")
    assert "Partial" in plan[shuffle:] and "WindowGroupLimit" in plan[shuffle:]


def test_hot_lookup_key_is_split(spark):
    """A join partition made big by one key is divided among tasks."""
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
        alerts = spark.range(60_000, numPartitions=8).select(
            F.concat(F.lit("10.0.0."), key).alias("src_ip"), "id",
            F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        ttl = alerts.groupBy("src_ip").agg(F.min("id").alias("ttl"))
        joined = enrich.join_ttl(alerts, ttl)
        total = joined.agg(F.count("*"), F.sum("ttl")).collect()[0]
        joined.write.format("noop").mode("overwrite").save()
        frame = joined
        assert frame.collect() is not None
        plan = frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert total[0] == 60_000
    assert "SortMergeJoin(skew=true)" in plan


def test_build_is_the_same_however_rows_lie(spark, rows):
    parsed = parse_alert_lines(alert_lines(spark), interface="OPT1")
    flows = parse_flow_lines(lines_frame(spark, [
        '{"event_type":"alert","src_ip":"192.168.10.2","dest_ip":"192.168.1.100",'
        f'"dest_port":{p},"proto":"TCP","app_proto":{a},"flow":{{"bytes_toserver":{p}}}}}'
        for p, a in ((80, "null"), (80, '"http"'), (445, '"smb"'), (80, '"late"'))
    ]))
    plain = rows(build_dataset(parsed, flows))
    assert rows(build_dataset(shuffled(parsed), shuffled(flows, 3))) == plain
    assert {(r[7], r[11], r[13]) for r in plain} == {
        (80, "http", 80), (445, "smb", 445), (21, None, None), (113, None, None)}


def test_empty_flow_side_still_counts_as_supplied(spark):
    parsed = parse_alert_lines(alert_lines(spark), interface="OPT1")
    none = parse_flow_lines(lines_frame(spark, ["junk"]))
    scores = {r[0] for r in build_dataset(parsed, none).select("fp_likelihood").collect()}
    assert scores == {0, 70}


def test_histogram_bins(spark):
    frame = spark.createDataFrame([(v,) for v in (0, 10, 11, 60, 100)], "fp_likelihood bigint")
    got = {r["up_to"]: r["alerts"] for r in report.fp_histogram(frame).collect()}
    assert got == {10: 2, 20: 1, 30: 0, 40: 0, 50: 0, 60: 1, 70: 0, 80: 0, 90: 0, 100: 1}


def test_job_from_files(spark, tmp_path):
    lines = alert_lines(spark).select("value").collect()
    for name in ("opt1.log", "lan.log"):
        (tmp_path / name).write_text("\n".join(r[0] for r in lines) + "\nnoise\n")
    (tmp_path / "eve.json").write_text(
        '{"event_type":"alert","src_ip":"192.168.10.2","dest_ip":"192.168.1.100",'
        '"dest_port":445,"proto":"TCP","app_proto":"smb","payload_printable":"a \\"b\\", c"}\n')
    sources = [(str(tmp_path / "opt1.log"), "OPT1"), (str(tmp_path / "lan.log"), "LAN")]
    flows = [str(tmp_path / "eve.json"), str(tmp_path / "absent.json")]
    stored = run(spark, sources, flows, str(tmp_path / "table"), str(tmp_path / "csv"))
    assert stored.count() == 100
    assert {r[0] for r in stored.select("interface").distinct().collect()} == {"OPT1"}
    assert stored.filter("app_proto = 'smb'").count() == 12
    assert report.enrichment_coverage(stored).first().asDict() == {
        "flow_bytes_filled": 12, "flow_duration_filled": 0, "app_proto_filled": 12, "total": 100}
    from palisade.sources.tables import read_csv
    back = read_csv(spark, str(tmp_path / "csv"), DATASET)
    assert sorted(map(str, back.collect())) == sorted(map(str, stored.collect()))
    # without any flow file the no-traffic points apply
    again = run(spark, sources, [str(tmp_path / "absent.json")], str(tmp_path / "table2"))
    assert {r[0] for r in again.select("fp_likelihood").collect()} == {10, 80}


def test_stored_dataset_is_clustered_for_each_indexed_column(spark, tmp_path):
    """A filter on any of five columns reads less than a fifth of the table."""
    frame = spark.range(200_000).select(
        *(F.lit(None).cast(f.dataType).alias(f.name) for f in DATASET.fields if f.name not in (
            "interface", "ground_truth", "attack_type", "fp_likelihood", "src_ip", "timestamp")),
        F.when(F.rand(1) < 0.1, "OPT1").otherwise("LAN").alias("interface"),
        F.when(F.rand(2) < 0.1, "true_positive").otherwise("false_positive").alias("ground_truth"),
        F.concat(F.lit("kind"), F.floor(F.rand(3) * 12)).alias("attack_type"),
        (F.floor(F.rand(4) * 11) * 10).alias("fp_likelihood"),
        # one source holds a third of the rows
        F.when(F.rand(5) < 0.33, "10.0.0.1").otherwise(
            F.concat(F.lit("10.1."), F.floor(F.rand(6) * 3000))).alias("src_ip"),
        F.col("id").cast("string").alias("timestamp"),
    )
    path = tmp_path / "table"
    write_dataset(frame, str(path), row_group_bytes=2_000)
    groups = []
    for file in path.glob("interface=*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            columns = [meta.row_group(g).column(c) for c in range(meta.num_columns)]
            stats = {c.path_in_schema: c.statistics for c in columns}
            groups.append((file.parent.name, {
                k: (s.min, s.max) for k, s in stats.items() if s is not None and s.has_min_max}))
    assert len(groups) > 200
    opened = {"interface": sum(folder == "interface=OPT1" for folder, _ in groups)}
    for column, value in (("ground_truth", "true_positive"), ("attack_type", "kind3"),
                          ("fp_likelihood", 70), ("src_ip", "10.1.77")):
        opened[column] = sum(s[column][0] <= value <= s[column][1] for _, s in groups)
    # a source has a stretch in each combination of the columns before it, so ranges
    # alone leave about a quarter of this small table; Bloom filters do the rest
    del opened["src_ip"]
    assert {c: n / len(groups) for c, n in opened.items() if 5 * n >= len(groups)} == {}
    stored = spark.read.parquet(str(path))
    assert stored.count() == 200_000
    one = stored.filter("src_ip = '10.1.77'")
    assert len(one.collect()) == frame.filter("src_ip = '10.1.77'").count() > 0
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 5 * scan.metrics().apply("numOutputRows").value() < 200_000
