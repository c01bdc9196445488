"""Continuous ingest: lines to stored alerts, roll-up and profiles.

Every table is a :class:`SnapshotTable` written one part per micro-batch. A
batch that runs again after a failure replaces its own part, so nothing is
added twice. Parts of many batches are merged as the ingest goes on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palisade import fixed_values as fixed
from palisade.functions.assessment import ARROW
from palisade.operators import profile, report, rollup
from palisade.operators.enrich import join_ttl, latest_ttl, newest_ttl
from palisade.operators.numbering import with_position
from palisade.operators.score import (
    BatchFunction,
    PartsAssessor,
    assess_profiles,
    assess_sequences,
    score_alerts,
)
from palisade.plans.analytics import AnalystView, analyst_view
from palisade.schemas import ALERTS, KPIS, PROFILES, ROLLUP, TTLS
from palisade.session import stream_settings
from palisade.sources.alert_log import parse_alert_lines
from palisade.sources.eve import parse_ttl_lines
from palisade.sources.lines import number_lines
from palisade.sources.snapshots import FANOUT, SnapshotTable

POLL_INTERVAL = "10 seconds"

MERGE_EVERY = FANOUT  # batches

# metrics of a micro-batch
_NEW_LINES, _NEW_ALERTS = "new_lines", "new_alerts"


@dataclass(frozen=True)
class Tables:
    """Where one ingest keeps its tables, the batch at hand and its progress."""

    alerts: str
    rollup: str
    profiles: str
    staging: str
    checkpoint: str
    ttl: str
    flow_checkpoint: str

    @classmethod
    def below(cls, root: str) -> Tables:
        return cls(*(f"{root.rstrip('/')}/{name}" for name in (
            "alerts", "attacker_rollup", "attacker_profiles", "staging", "checkpoint",
            "ttl", "flow_checkpoint")))

    def alert_table(self, spark: SparkSession) -> SnapshotTable:
        return SnapshotTable(spark, self.alerts, ALERTS, ranges=["id", "created_at"])

    def rollup_table(self, spark: SparkSession) -> SnapshotTable:
        return SnapshotTable(spark, self.rollup, ROLLUP, bucket_by="src_ip")

    def profile_table(self, spark: SparkSession) -> SnapshotTable:
        return SnapshotTable(spark, self.profiles, PROFILES, bucket_by="src_ip")

    def ttl_table(self, spark: SparkSession) -> SnapshotTable:
        return SnapshotTable(spark, self.ttl, TTLS, bucket_by="src_ip")


def distinct_lines(
    lines: DataFrame, *, salts: int | None = None, forget_after: str | None = None
) -> DataFrame:
    """Each distinct raw line once over the life of the stream.

    The second step is the exact one; its state lives in the checkpoint and
    survives restarts. The first takes the pressure off it when one line makes
    up much of the input: copies are spread over ``salts`` keys (by default one
    for each shuffle partition) by the task that read them and thinned to one
    per key. It may forget after a minute, and the task number is the same when
    a task is tried again. ``salts=1`` leaves the first step out.

    The state holds 16 bytes and overhead for each line ever seen, over as many
    partitions as the first start had: size ``spark.sql.shuffle.partitions``
    for the lines expected. ``forget_after`` (such as ``"30 days"``) bounds it,
    for both steps; a line that comes again later than that counts as new.
    """
    if salts is None:
        salts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = lines.withColumn("line_hash", F.unhex(F.md5("value")))
    if salts > 1 or forget_after is not None:
        hashed = hashed.withColumn("_arrived", F.current_timestamp()).withWatermark(
            "_arrived", forget_after or "1 minute"
        )
    if salts > 1:
        hashed = hashed.withColumn(
            "_salt", F.pmod(F.spark_partition_id(), F.lit(salts))
        ).dropDuplicatesWithinWatermark(["line_hash", "_salt"])
    if forget_after is not None:
        once = hashed.dropDuplicatesWithinWatermark(["line_hash"])
    else:
        once = hashed.dropDuplicates(["line_hash"])
    return once.drop("_salt", "_arrived")


def parsed_stream(lines: DataFrame) -> DataFrame:
    """Distinct lines parsed as live alerts, with ``created_at``.

    ``created_at`` is the time of the micro-batch, the same if it runs again.
    """
    number = F.count(F.lit(1)).alias("rows")
    once = distinct_lines(lines).observe(_NEW_LINES, number)
    alerts = parse_alert_lines(once, grammar="live").observe(_NEW_ALERTS, number)
    return alerts.withColumn("created_at", F.current_timestamp())


def line_counts(query: StreamingQuery) -> dict[str, int]:
    """New lines, and those parsed and rejected, over the batches whose progress is kept.

    Counted while the batches ran; no line is read again. A session keeps the
    last ``spark.sql.streaming.numRecentProgressUpdates``; a listener on the
    same metrics can add up all.
    """
    lines = parsed = 0
    for progress in query.recentProgress:
        seen = progress.observedMetrics
        if _NEW_LINES in seen:
            lines += seen[_NEW_LINES].rows
            parsed += seen[_NEW_ALERTS].rows
    return {"lines": lines, "parsed": parsed, "rejected": lines - parsed}


def _numbered(batch: DataFrame, batch_id: int, tables: Tables) -> DataFrame:
    """Ids in log-time order, running on from the last id of the earlier batches."""
    last = tables.alert_table(batch.sparkSession).highest("id", before=batch_id) or 0
    placed = with_position(
        batch, ["timestamp", "line_hash"], at=f"{tables.staging}-numbered"
    )
    return placed.withColumn("id", F.col("position") + F.lit(last))


def store_batch(
    batch: DataFrame,
    batch_id: int,
    tables: Tables,
    *,
    ttl: DataFrame | None = None,
    scorer: BatchFunction | None = None,
) -> DataFrame:
    """Enrich, score and store one batch of alerts; returns the rows as stored.

    ``ttl`` holds the TTL per source; by default that is what the flow ingest
    has stored by now. An alert of any other source gets 0.
    """
    if ttl is None:
        ttl = known_ttl(batch.sparkSession, tables, batch)
    alerts = join_ttl(_numbered(batch.drop("ttl"), batch_id, tables), ttl)
    scored = score_alerts(alerts, scorer)
    rows = scored.select(*(F.col(f.name).cast(f.dataType) for f in ALERTS.fields))
    return tables.alert_table(batch.sparkSession).write(rows, batch_id)


def known_ttl(spark: SparkSession, tables: Tables, sources: DataFrame | None = None) -> DataFrame:
    """``src_ip``, ``ttl``: what the flow ingest has seen last, by source order.

    With ``sources``, only the buckets of these are read, and only their rows kept.
    """
    table = tables.ttl_table(spark)
    if sources is None:
        return latest_ttl(table.read())
    if not table.manifest()[1]:
        return latest_ttl(table.read(buckets=[]))
    wanted = sources.select("src_ip").distinct()
    stored = table.read(buckets=table.buckets_of(wanted))
    return latest_ttl(stored.join(wanted, "src_ip", "left_semi"))


def profile_batch(
    stored: DataFrame, batch_id: int, tables: Tables,
    assessor: BatchFunction | None = None,
    max_sequence: int | None = None,
    sequence_assessor: PartsAssessor | None = None,
) -> None:
    """Profile the attackers that this batch made repeat attackers.

    Only a source with a hack in this batch can newly reach the minimum, so
    the batch decides whom to look at. An assessor also gets ``attack_sequence``,
    the ordered attacks up to this batch (all, or the first ``max_sequence``);
    a ``sequence_assessor`` gets them part by part, so that no row holds them all.
    Their history comes from the roll-up, of which only the buckets of this
    batch's attackers are read, and of those only their own rows are kept. A
    profile is written once and never refreshed; rows of this very batch are
    ignored when looking for existing profiles, so a repeat run rewrites them.
    Its id is that of the attacker's first hack alert in the batch.
    """
    spark = stored.sparkSession
    rollups, profiles = tables.rollup_table(spark), tables.profile_table(spark)
    rollups.write(rollup.roll_up(stored), batch_id)
    # these two have a row for each source and are needed several times
    attackers = _written(
        stored.filter(F.col("llm_classification") == "hack")
        .groupBy("src_ip").agg(F.min("id").alias("id")),
        f"{tables.staging}-attackers",
    )
    candidates = profile.without_profile(
        attackers, profiles.read(before=batch_id, buckets=profiles.buckets_of(attackers))
    )
    history = touched_rollup(rollups, attackers, batch_id + 1).join(
        candidates, "src_ip", "left_semi"
    )
    due = _written(
        profile.profile_facts(history).join(candidates, "src_ip"), f"{tables.staging}-due"
    )
    if assessor is None and sequence_assessor is None:
        assessed = assess_profiles(due)
    else:
        parts = _sequence_parts(
            stored, touched_rollup(rollups, attackers, batch_id), due, tables, max_sequence
        )
        if sequence_assessor is not None:
            assessed = due.join(assess_sequences(parts, sequence_assessor), "src_ip")
        else:
            assessed = assess_profiles(due.join(_joined(parts), "src_ip", "left"), assessor)
    rows = (
        assessed
        .withColumn("time_span", profile.time_span(F.col("first_seen"), F.col("last_seen")))
        .withColumn("created_at", F.col("last_seen"))
        .withColumn("updated_at", F.col("last_seen"))
    )
    profiles.write(
        rows.select(*(F.col(f.name).cast(f.dataType) for f in PROFILES.fields)), batch_id
    )


def _written(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` as stored at ``path``, which is overwritten."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def touched_rollup(rollups: SnapshotTable, sources: DataFrame, before: int) -> DataFrame:
    """The roll-up of earlier batches in the buckets of ``sources``."""
    return rollups.read(before=before, buckets=rollups.buckets_of(sources))


def maintain(
    spark: SparkSession, tables: Tables, *, fanout: int = FANOUT, keep_seconds: float = 3600
) -> None:
    """Merge the parts of all tables and delete what is no longer needed.

    Runs within the ingest; may also run beside it. Readers are not disturbed
    for ``keep_seconds``. The TTL table is kept by the flow ingest.
    """
    for table, combine in (
        (tables.alert_table(spark), None),
        (tables.rollup_table(spark), rollup.merged),
        (tables.profile_table(spark), None),
    ):
        table.merge(combine, fanout=fanout)
        table.vacuum(keep_seconds=keep_seconds)


def _started(spark: SparkSession, writer, available_now: bool) -> StreamingQuery:
    with stream_settings(spark):
        if available_now:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=POLL_INTERVAL).start()


def start_flow_ingest(
    lines: DataFrame,
    tables: Tables,
    *,
    merge_every: int | None = MERGE_EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Keep the TTL last reported for each source from a streaming frame of flow lines.

    ``lines`` has ``value`` and ``source_order``
    (:func:`~palisade.sources.lines.stream_lines` with ``ordered``). Each line
    is parsed once: a batch leaves one row for each source it reports on, and
    merges keep the newest of them by source order, whichever batch it came
    with. A batch that runs again replaces its own rows.
    """
    table = tables.ttl_table(lines.sparkSession)

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.write(newest_ttl(parse_ttl_lines(number_lines(batch))), batch_id)
        if merge_every and (batch_id + 1) % merge_every == 0:
            table.merge(newest_ttl, fanout=max(2, merge_every))
            table.vacuum()

    writer = lines.writeStream.foreachBatch(handle).option(
        "checkpointLocation", tables.flow_checkpoint
    )
    return _started(lines.sparkSession, writer, available_now)


def _sequence_parts(
    stored: DataFrame, earlier: DataFrame, due: DataFrame, tables: Tables,
    max_sequence: int | None = None,
) -> DataFrame:
    """The sequences of the sources in ``due`` in parts, whole or the first ``max_sequence`` steps.

    A source is profiled as soon as it has enough hacks, so one that is due
    now had fewer before: at most one, by its facts, and the rest in this batch.
    """
    sources = due.select("src_ip")
    before = earlier.filter(F.col("hacks") > 0).select(
        "src_ip", F.lit("hack").alias("llm_classification"), "attack_type",
        F.col("first_hack").alias("created_at"), F.lit(0).cast("bigint").alias("id"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("hacks"))).alias("_n"),
    ).drop("_n")
    now = stored.select(*before.columns)
    hacks = before.unionByName(now).join(sources, "src_ip", "left_semi")
    sequence = profile.attack_sequence(hacks, at=f"{tables.staging}-sequence")
    if max_sequence is not None:
        sequence = sequence.filter(F.col("position") <= max_sequence)
    return profile.sequence_text(sequence)


def _joined(parts: DataFrame) -> DataFrame:
    """``attack_sequence`` of each source as one text."""
    part = F.struct("part", "attack_sequence")
    whole = parts.groupBy("src_ip").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return whole.select(
        "src_ip",
        F.array_join(F.col("parts.attack_sequence"), ARROW).alias("attack_sequence"),
    )


def start_ingest(
    lines: DataFrame,
    tables: Tables,
    *,
    ttl: Callable[[], DataFrame] | None = None,
    scorer: BatchFunction | None = None,
    assessor: BatchFunction | None = None,
    sequence_assessor: PartsAssessor | None = None,
    max_sequence: int | None = None,
    merge_every: int | None = MERGE_EVERY,
    available_now: bool = False,
) -> StreamingQuery:
    """Start the ingest of a streaming frame of raw lines.

    Polls on a fixed interval, or with ``available_now`` works off what is
    there and stops. TTLs are those :func:`start_flow_ingest` has stored by the
    time of the batch; ``ttl`` names another place to get them, called for
    every batch that has alerts. ``max_sequence`` limits the steps an assessor
    is given; by default it gets all, which must fit one text. A
    ``sequence_assessor``, given instead, reads them part by part. Every ``merge_every`` batches the tables
    are maintained (``None``: leave that to a job of yours).
    """

    session = lines.sparkSession
    if assessor is not None and sequence_assessor is not None:
        raise ValueError("give an assessor or a sequence_assessor, not both")

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Written once and read back: the stateful plan behind the batch runs
        # once, and the work on the rows happens in the caller's session, with
        # adaptive execution, which a stream's own session switches off.
        batch.write.mode("overwrite").parquet(tables.staging)
        staged = session.read.schema(batch.schema).parquet(tables.staging)
        if staged.isEmpty():
            return
        stored = store_batch(
            staged, batch_id, tables, ttl=ttl and ttl(), scorer=scorer
        )
        profile_batch(stored, batch_id, tables, assessor, max_sequence, sequence_assessor)
        if merge_every and (batch_id + 1) % merge_every == 0:
            maintain(session, tables, fanout=max(2, merge_every))

    writer = (
        parsed_stream(lines).writeStream.foreachBatch(handle)
        .option("checkpointLocation", tables.checkpoint)
    )
    return _started(session, writer, available_now)


def start_kpis(
    alerts: DataFrame, path: str, checkpoint: str, *, available_now: bool = False
) -> StreamingQuery:
    """Keep the key figures of a scored alert stream up to date at ``path``.

    Each refresh is a version of its own, so :func:`current_kpis` always finds
    one whole set of figures.
    """
    table = _kpi_table(alerts.sparkSession, path)

    def replace(figures: DataFrame, batch_id: int) -> None:
        table.write(figures, batch_id, alone=True)
        table.vacuum()

    writer = (
        report.kpis(alerts).writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", checkpoint)
    )
    return _started(alerts.sparkSession, writer, available_now)


def _kpi_table(spark: SparkSession, path: str) -> SnapshotTable:
    return SnapshotTable(spark, path, KPIS)


def current_kpis(spark: SparkSession, path: str) -> DataFrame:
    """The key figures of the newest refresh; no rows before the first."""
    return _kpi_table(spark, path).read().drop("batch_id")


def stored_alerts(spark: SparkSession, tables: Tables) -> DataFrame:
    return tables.alert_table(spark).read().drop("batch_id")


def newest_alerts(
    spark: SparkSession, tables: Tables, limit: int = fixed.NEWEST_ROWS
) -> DataFrame:
    """The newest alerts; only parts that can hold one of them are opened."""
    rows = tables.alert_table(spark).newest("created_at", limit)
    return report.newest_alerts(rows.drop("batch_id"), limit)


def stored_rollup(spark: SparkSession, tables: Tables) -> DataFrame:
    return tables.rollup_table(spark).read().drop("batch_id")


def stored_view(
    spark: SparkSession, tables: Tables, *,
    population_limit: int | None = fixed.NEWEST_ROWS, **options,
) -> AnalystView:
    """The analyst's view of the stored alerts.

    Profiles come from the roll-up and the newest alerts from the parts that
    hold them, so that a refresh does not read the whole table.
    """
    alerts = stored_alerts(spark, tables)
    newest = None if population_limit is None else newest_alerts(spark, tables, population_limit)
    return analyst_view(
        alerts, population_limit=population_limit, newest=newest,
        rollups=stored_rollup(spark, tables), **options,
    )


def batch_counts(spark: SparkSession, tables: Tables) -> DataFrame:
    """New alerts per batch."""
    return tables.alert_table(spark).read().groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("alerts")
    )


def stored_profiles(spark: SparkSession, tables: Tables) -> DataFrame:
    return tables.profile_table(spark).read().drop("batch_id")
