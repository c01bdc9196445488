from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from data import alerts_frame
from palisade import fixed_values as fixed
from palisade.operators import score
from workload import binding


@pytest.fixture
def events(spark, tmp_path):
    """A folder whose events are one file of one row group."""
    n = F.col("id")
    rows = spark.range(0, 150_000, 1, 1).select(
        n.alias("event_id"),
        F.timestamp_seconds(n + 1_700_000_000).alias("ts"), (n % 900).alias("user_id"),
        F.lit("view").alias("event_type"), F.rand(seed=1).alias("value"),
        F.format_string('{"k": %d}', n % 100).alias("props"),
    )
    rows.write.parquet(str(tmp_path / "written"))
    (written,) = (tmp_path / "written").glob("*.parquet")
    assert pq.ParquetFile(written).metadata.num_row_groups == 1
    (tmp_path / "tables").mkdir()
    (tmp_path / "tables" / "events.parquet").write_bytes(written.read_bytes())
    return str(tmp_path / "tables")


def tasks_of_batches(stream, path):
    """How many rows each task made, for every micro-batch, and the rows of all."""
    counts, frames = [], []

    def handle(batch, batch_id):
        batch.write.parquet(f"{path}/{batch_id}")
        frame = stream.sparkSession.read.schema(batch.schema).parquet(f"{path}/{batch_id}")
        frames.append(frame)
        counts.append(Counter(r["task"] for r in frame.select("task").collect()))

    made = stream.withColumn("task", F.spark_partition_id())
    made.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}-progress").trigger(
        availableNow=True).start().awaitTermination()
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionAll(frame)
    return counts, rows.drop("task")


def shared_by_all_cores(spark, counts):
    cores = spark.sparkContext.defaultParallelism
    assert all(len(c) == cores and max(c.values()) < 2 * min(c.values()) for c in counts)


def test_one_file_of_a_batch_is_shared_by_all_cores(spark, events, tmp_path):
    landing = tmp_path / "landing"
    stream = binding.events_stream_of_files(spark, events, str(landing), files=2)
    files = list(landing.glob("*.parquet"))
    assert len(files) == 2
    assert all(pq.ParquetFile(f).metadata.num_row_groups > 1 for f in files)
    counts, rows = tasks_of_batches(stream, str(tmp_path / "out"))
    assert len(counts) == 2
    shared_by_all_cores(spark, counts)
    expected = binding.wide_events(spark, events)
    assert rows.count() == 150_000
    assert rows.exceptAll(expected).isEmpty()


def test_the_events_of_a_stream_are_shared_by_all_cores(spark, events, tmp_path):
    counts, rows = tasks_of_batches(binding.events_stream(spark, events), str(tmp_path / "out"))
    assert len(counts) == 1
    shared_by_all_cores(spark, counts)
    assert rows.exceptAll(binding.wide_events(spark, events)).isEmpty()


def test_rules_match_each_pattern_once(spark):
    alerts = alerts_frame(spark, [{"signature": "ET POLICY NMAP scan"}]).drop("attack_type")
    verdicts = score.rule_verdict(alerts)
    assert not {"_attack", "_noise"} & set(verdicts.columns)
    plan = verdicts._jdf.queryExecution().optimizedPlan().toString()
    for pattern in (fixed.INFORMATIONAL_PATTERN, *(p for p, _ in fixed.ATTACK_TYPE_PATTERNS)):
        assert plan.count(f"RLIKE {pattern}") + plan.count(f", {pattern})") == 1, plan
