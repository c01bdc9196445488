import threading

import pytest
from pyspark.sql import functions as F

from palisade.sources.snapshots import Conflict, SnapshotTable


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "t"), spark.range(0).schema, ranges=["id"])


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


def test_a_batch_replaces_itself(spark, table):
    assert ids(table.read()) == [] and table.merge() == 0 and table.vacuum() == 0
    assert ids(table.write(spark.range(3), 0)) == [0, 1, 2]
    table.write(spark.range(10, 12), 1)
    table.write(spark.range(20, 21), 1)
    assert ids(table.read()) == [0, 1, 2, 20]
    table.write(spark.range(0), 1)
    assert ids(table.read()) == [0, 1, 2]
    table.write(spark.range(5, 6), 2)
    assert ids(table.read(before=2)) == [0, 1, 2]
    assert table.highest("id", before=2) == 2 and table.highest("id", before=0) is None


def test_merges_keep_rows_batches_and_the_newest_batch(spark, table):
    for batch in range(40):
        table.write(spark.range(2 * batch, 2 * batch + 2), batch)
    assert table.merge(fanout=3) > 10
    _, parts = table.manifest()
    assert len(parts) < 12
    found = {(r["id"], r["batch_id"]) for r in table.read().collect()}
    assert found == {(i, i // 2) for i in range(80)}
    table.write(spark.range(100, 101), 39)
    assert ids(table.read()) == [*range(78), 100]
    with pytest.raises(Conflict):
        table.write(spark.range(1), 3)
    assert ids(table.read(before=10)) == list(range(20))
    assert table.merge(fanout=3) == 0


def test_a_read_goes_on_during_merge_and_vacuum(spark, table):
    for batch in range(6):
        table.write(spark.range(batch, batch + 1), batch)
    version, _ = table.manifest()
    pinned = table.read()
    table.merge(fanout=2)
    table.write(spark.range(6, 7), 6)
    table.vacuum()  # everything is young
    assert ids(pinned) == list(range(6)) and ids(table.read(version=version)) == list(range(6))
    assert table.vacuum(keep_seconds=-1, keep_versions=1) > 0
    assert ids(table.read()) == list(range(7))
    with pytest.raises(Conflict):
        table.read(version=version)


def test_writes_and_merges_side_by_side(spark, table):
    errors = []

    def merging():
        try:
            for _ in range(8):
                table.merge(fanout=2)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    thread = threading.Thread(target=merging)
    thread.start()
    for batch in range(12):
        table.write(spark.range(batch, batch + 1), batch)
        assert ids(table.read()) == list(range(batch + 1))
    thread.join()
    assert not errors and ids(table.read()) == list(range(12))


def test_only_one_publishes_a_version(spark, table):
    table.write(spark.range(1), 0)
    version, parts = table.manifest()
    assert table._publish(version + 1, parts) and not table._publish(version + 1, [])
    assert ids(table.read()) == [0]


def test_newest_opens_only_parts_that_count(spark, table):
    for batch in range(20):
        table.write(spark.range(10 * batch, 10 * batch + 10), batch)
    newest = table.newest("id", 25)
    assert ids(newest) == list(range(170, 200))
    assert ids(table.newest("id", 10_000)) == list(range(200))
    table.write(spark.sql("SELECT CAST(NULL AS BIGINT) AS id"), 20)
    assert len(newest.inputFiles()) <= 3 * 8
    assert table.newest("id", 500).count() == 201
    assert None not in [r["id"] for r in table.newest("id", 25).collect()]


def test_merged_buckets_are_pruned_and_combined(spark, tmp_path):
    rows = spark.range(200).select(F.concat(F.lit("s"), F.col("id")).alias("src_ip"), F.lit(1).cast("long").alias("n"))
    table = SnapshotTable(spark, str(tmp_path / "b"), rows.schema, bucket_by="src_ip", buckets=8)
    for batch in range(4):
        table.write(rows, batch)
    table.merge(lambda df: df.groupBy("src_ip").agg(F.sum("n").alias("n")), fanout=3)
    assert {r["n"]: r["count"] for r in table.read().groupBy("n").count().collect()} == {3: 200, 1: 200}
    wanted = rows.filter("src_ip IN ('s1', 's2')")
    buckets = table.buckets_of(wanted)
    some = table.read(buckets=buckets)
    assert {"s1", "s2"} <= {r["src_ip"] for r in some.collect()}
    assert some.count() < 200
    assert "PartitionFilters: [isnotnull(bucket" in some._jdf.queryExecution().toString() or len(buckets) < 3


def test_an_empty_table_is_known_to_be_empty(spark, table):
    rows = table.read()
    assert rows.dtypes == [("id", "bigint"), ("batch_id", "bigint")] and rows.isEmpty()
    assert "LocalRelation <empty>" in rows._jdf.queryExecution().optimizedPlan().toString()
