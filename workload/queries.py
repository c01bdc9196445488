"""One query per operator, over the driver's test tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade import schemas
from palisade.functions import assessment, bands, labels
from palisade.functions.assessment import ARROW
from palisade.operators import dataset as ds
from palisade.operators import enrich, profile, report, rollup, score
from palisade.plans import analytics
from palisade.plans.dataset import build_dataset, read_alert_logs
from palisade.session import fresh_path
from palisade.sources import tables
from palisade.sources.alert_log import (
    count_lines_by,
    event_time,
    parse_alert_lines,
    rejected_lines,
    store_alert_lines,
)
from palisade.sources.eve import parse_flow_lines, parse_ttl_lines
from palisade.sources.lines import newest_lines
from palisade.sources.snapshots import SnapshotTable
from palisade.streaming import ingest
from workload import binding

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.alert_lines(binding.wide_events(spark, sf_dir))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_alert_lines(_lines(spark, sf_dir))


def _flow_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.flow_lines(binding.wide_events(spark, sf_dir))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_flow_lines(_flow_lines(spark, sf_dir))


def _dataset(spark: SparkSession, sf_dir: str, *, ordered: bool = True) -> DataFrame:
    return build_dataset(_parsed(spark, sf_dir), _flows(spark, sf_dir), ordered=ordered)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.stored_alerts(binding.wide_events(spark, sf_dir))


def _source_line(df: DataFrame) -> DataFrame:
    """The source order as two plain columns."""
    return df.withColumn("source_rank", F.col("source_order.rank")).withColumn(
        "line", F.col("source_order.line")
    ).drop("source_order")


def _moment(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- lines ----------------------------------------------------------------------


@query
def parse_alert_lines_archive(spark, sf_dir):
    return _source_line(_parsed(spark, sf_dir))


@query
def parse_alert_lines_live(spark, sf_dir):
    return _source_line(parse_alert_lines(_lines(spark, sf_dir), grammar="live"))


@query
def parse_reject_count(spark, sf_dir):
    return count_lines_by(_lines(spark, sf_dir))


@query
def alerts_and_rejects(spark, sf_dir):
    """One scan leaves alerts, rejected lines and counts; what each table holds."""
    found = store_alert_lines(
        _lines(spark, sf_dir), fresh_path(spark, "parsed"), grammar="live"
    )
    alerts = _source_line(found.alerts).select(
        "source_rank", "line", F.lit("alert").alias("kind"), F.col("signature").alias("content")
    )
    rejected = _source_line(found.rejected).select(
        "source_rank", "line", F.lit("rejected").alias("kind"), F.col("value").alias("content")
    )
    return alerts.unionByName(rejected).withColumns({
        "lines": F.lit(found.lines).cast("bigint"), "rejects": F.lit(found.rejects).cast("bigint"),
    })


@query
def rejected_alert_lines(spark, sf_dir):
    return _source_line(rejected_lines(_lines(spark, sf_dir), grammar="live"))


@query
def alert_event_time(spark, sf_dir):
    parsed = _source_line(_parsed(spark, sf_dir))
    return parsed.select(
        "source_rank", "line", "timestamp",
        _moment(event_time(F.col("timestamp"))).alias("event_ts"),
    )


@query
def scan_alert_files(spark, sf_dir):
    """Lines written as text files, one folder per interface, read back and parsed."""
    root = fresh_path(spark, "alert-logs")
    _lines(spark, sf_dir).select("value", "interface").write.partitionBy(
        "interface"
    ).text(root)
    sources = [(f"{root}/interface={name}", name) for name in ("OPT1", "LAN")]
    return read_alert_logs(spark, sources).drop("source_order")


@query
def parse_eve_alerts(spark, sf_dir):
    return _source_line(_flows(spark, sf_dir)).drop("flow_duration")


@query
def flow_duration(spark, sf_dir):
    return _flows(spark, sf_dir).select("flow_id", "flow_duration")


@query
def union_sources(spark, sf_dir):
    opt1 = parse_alert_lines(
        _lines(spark, sf_dir).filter(F.col("interface") == "OPT1").drop("interface"),
        interface="OPT1",
    )
    lan = parse_alert_lines(
        _lines(spark, sf_dir).filter(F.col("interface") == "LAN").drop("interface"),
        interface="LAN",
    )
    both = enrich.union_sources(opt1, lan)
    return both.groupBy("interface", F.col("source_order.rank").alias("source_rank")).agg(
        F.count(F.lit(1)).alias("alerts"), F.sum("src_port").alias("src_port_sum")
    )


# --- enrichment -------------------------------------------------------------------


@query
def flow_summary_first_non_null(spark, sf_dir):
    return enrich.flow_summary(_flows(spark, sf_dir))


@query
def enrich_alerts_left_join(spark, sf_dir):
    summary = enrich.flow_summary(_flows(spark, sf_dir))
    return _source_line(enrich.join_flows(_parsed(spark, sf_dir), summary))


@query
def ttl_latest(spark, sf_dir):
    return enrich.latest_ttl(parse_ttl_lines(_flow_lines(spark, sf_dir)))


@query
def ttl_latest_of_tail(spark, sf_dir):
    tail = newest_lines(_flow_lines(spark, sf_dir), 100)
    return enrich.latest_ttl(parse_ttl_lines(tail))


@query
def ttl_enrich(spark, sf_dir):
    ttl = enrich.latest_ttl(parse_ttl_lines(_flow_lines(spark, sf_dir)))
    live = parse_alert_lines(_lines(spark, sf_dir), grammar="live")
    return _source_line(enrich.join_ttl(live, ttl)).select(
        "source_rank", "line", "src_ip", "ttl",
        bands.os_family(F.col("ttl")).alias("os"),
    )


# --- labels -----------------------------------------------------------------------


@query
def classify_attack_type(spark, sf_dir):
    parsed = _source_line(_parsed(spark, sf_dir))
    return parsed.select(
        "source_rank", "line", "signature",
        labels.attack_type(F.col("signature")).alias("attack_type"),
    )


@query
def kill_chain_stage(spark, sf_dir):
    attack = labels.attack_type(F.col("signature"))
    staged = _parsed(spark, sf_dir).select(
        attack.alias("attack_type"), labels.kill_chain_stage(attack).alias("kill_chain_stage")
    )
    return staged.groupBy("attack_type", "kill_chain_stage").agg(
        F.count(F.lit(1)).alias("alerts")
    )


@query
def fp_likelihood(spark, sf_dir):
    summary = enrich.flow_summary(_flows(spark, sf_dir))
    joined = enrich.join_flows(_parsed(spark, sf_dir), summary)
    labelled = _source_line(ds.label_alerts(joined, with_flows=True))
    return labelled.select(
        "source_rank", "line", "flow_bytes", "fp_likelihood", "ground_truth"
    )


@query
def fp_likelihood_no_eve(spark, sf_dir):
    labelled = _source_line(ds.label_alerts(_parsed(spark, sf_dir), with_flows=False))
    return labelled.select("source_rank", "line", "fp_likelihood", "ground_truth")


# --- dataset ----------------------------------------------------------------------


@query
def dedup_keep_first(spark, sf_dir):
    return _source_line(ds.drop_repeats(_parsed(spark, sf_dir)))


@query
def dedup_counts(spark, sf_dir):
    parsed = _parsed(spark, sf_dir)
    before = parsed.agg(F.count(F.lit(1)).alias("rows")).withColumn("step", F.lit("before"))
    after = ds.drop_repeats(parsed).agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "step", F.lit("after")
    )
    return before.unionByName(after)


@query
def final_dataset(spark, sf_dir):
    return _dataset(spark, sf_dir)


@query
def final_dataset_no_eve(spark, sf_dir):
    return build_dataset(_parsed(spark, sf_dir))


@query
def label_distribution(spark, sf_dir):
    return report.label_distribution(_dataset(spark, sf_dir, ordered=False))


@query
def fp_histogram(spark, sf_dir):
    return report.fp_histogram(_dataset(spark, sf_dir, ordered=False))


@query
def enrichment_coverage(spark, sf_dir):
    return report.enrichment_coverage(_dataset(spark, sf_dir, ordered=False))


@query
def csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "dataset-csv")
    tables.write_csv(_dataset(spark, sf_dir), path)
    return tables.read_csv(spark, path, schemas.DATASET)


@query
def table_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "dataset")
    tables.write_dataset(_dataset(spark, sf_dir), path)
    return spark.read.parquet(path).select(*schemas.DATASET.fieldNames())


# --- verdicts ---------------------------------------------------------------------

_VERDICT = schemas.VERDICT.fieldNames()


@query
def score_rule(spark, sf_dir):
    scored = score.score_alerts(parse_alert_lines(_lines(spark, sf_dir), grammar="live"))
    return _source_line(scored).select("source_rank", "line", *_VERDICT)


@query
def score_fallback(spark, sf_dir):
    def partial_scorer(batch: pd.DataFrame) -> list[dict]:
        """Fails on priority 3; omits keys on 2; an explicit null on 1."""
        if (batch["priority"] == 3).any():
            raise RuntimeError("no verdict")
        return [
            {"classification": "hack"} if priority == 2
            else {"classification": "hack", "attack_type": None, "risk_score": 9,
                  "explanation": "seen", "false_positive_likelihood": 10}
            for priority in batch["priority"]
        ]

    live = parse_alert_lines(_lines(spark, sf_dir), grammar="live")
    scored = score.score_alerts(live, partial_scorer)
    return _source_line(scored).select("source_rank", "line", *_VERDICT)


# --- analytics --------------------------------------------------------------------


def _with_text_time(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("created_at", _moment("created_at"))


@query
def newest_alerts(spark, sf_dir):
    return _with_text_time(report.newest_alerts(_alerts(spark, sf_dir)))


@query
def newest_stored_alerts(spark, sf_dir):
    path = fresh_path(spark, "alerts")
    _alerts(spark, sf_dir).write.parquet(path)
    return _with_text_time(report.newest_stored_alerts(spark.read.parquet(path)))


@query
def newest_alerts_of_parts(spark, sf_dir):
    """Over a table that grew batch by batch; only parts that can hold a row are opened."""
    table = SnapshotTable(spark, fresh_path(spark, "parts"), schemas.ALERTS, ranges=["created_at"])
    alerts = _alerts(spark, sf_dir)
    for batch, rows in enumerate(_by_id(alerts, 6)):
        table.write(rows, batch)
    table.merge(fanout=3)
    return _with_text_time(report.newest_alerts(table.newest("created_at", 500).drop("batch_id")))


@query
def newest_alerts_13(spark, sf_dir):
    return report.recent_listing(_alerts(spark, sf_dir))


@query
def filter_alerts(spark, sf_dir):
    kept = report.filter_alerts(_alerts(spark, sf_dir), min_risk=2)
    return kept.select("id", "attack_type", *_VERDICT[:1], *_VERDICT[3:])


@query
def filter_alerts_open(spark, sf_dir):
    kept = report.filter_alerts(
        _alerts(spark, sf_dir), hide_false_positives=False, verdicts=(), attack_types=()
    )
    return kept.select("id", "attack_type", *_VERDICT[:1], *_VERDICT[3:])


@query
def kpis(spark, sf_dir):
    return report.kpis(report.newest_alerts(_alerts(spark, sf_dir)))


@query
def kpis_whole_table(spark, sf_dir):
    return report.kpis(_alerts(spark, sf_dir))


@query
def fp_suppression(spark, sf_dir):
    return report.fp_suppression(report.newest_alerts(_alerts(spark, sf_dir)))


@query
def fp_suppression_whole_table(spark, sf_dir):
    return report.fp_suppression(_alerts(spark, sf_dir))


@query
def verdict_counts(spark, sf_dir):
    return report.verdict_counts(_alerts(spark, sf_dir))


@query
def attack_type_counts(spark, sf_dir):
    return report.attack_type_counts(_alerts(spark, sf_dir))


@query
def risk_timeline(spark, sf_dir):
    timeline = report.risk_timeline(_alerts(spark, sf_dir))
    return timeline.withColumn("time", _moment("time"))


@query
def alert_feed(spark, sf_dir):
    newest = report.newest_alerts(_alerts(spark, sf_dir))
    return report.alert_feed(report.filter_alerts(newest))


@query
def alert_feed_whole_table(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    return report.alert_feed(report.filter_alerts(alerts), limit=None)


@query
def accuracy_report(spark, sf_dir):
    return report.accuracy_report(_alerts(spark, sf_dir))


@query
def accuracy_overall(spark, sf_dir):
    return report.accuracy_overall(report.accuracy_report(_alerts(spark, sf_dir)))


@query
def accuracy_report_newest(spark, sf_dir):
    return report.accuracy_report(report.newest_alerts(_alerts(spark, sf_dir)))


# --- attackers --------------------------------------------------------------------


def _earlier_profiles(alerts: DataFrame) -> DataFrame:
    """Attackers profiled by an ingest that ran up to the middle of January."""
    earlier = alerts.filter(F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz"))
    return profile.repeat_attackers(earlier)


@query
def repeat_attackers(spark, sf_dir):
    return profile.repeat_attackers(_alerts(spark, sf_dir))


@query
def distinct_attackers(spark, sf_dir):
    return analytics.attackers_in(_alerts(spark, sf_dir))


@query
def unprofiled_attackers(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    return profile.without_profile(
        profile.repeat_attackers(alerts), _earlier_profiles(alerts)
    )


@query
def attacker_sequence(spark, sf_dir):
    return profile.sequence_text(profile.attack_sequence(_alerts(spark, sf_dir)))


@query
def attack_sequence_steps(spark, sf_dir):
    return profile.attack_sequence(_alerts(spark, sf_dir))


@query
def attacker_facts(spark, sf_dir):
    facts = profile.profile_facts(profile.port_facts(_alerts(spark, sf_dir)))
    return facts.select(
        "src_ip", "attack_count", "hack_ports", "max_risk",
        _moment("first_hack").alias("first_hack"), _moment("last_hack").alias("last_hack"),
    )


@query
def stored_profile(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    facts = profile.profile_facts(profile.port_facts(alerts))
    new = profile.without_profile(facts, _earlier_profiles(alerts))
    return score.assess_profiles(new).select(
        "src_ip", "methodology", "objective", "skill_level", "recommended_response",
        "attack_count",
        profile.time_span(F.col("first_seen"), F.col("last_seen")).alias("time_span"),
        "ports_targeted",
    )


@query
def profile_assessor_fallback(spark, sf_dir):
    def partial_assessor(batch: pd.DataFrame) -> list[dict]:
        """Fails on an odd number of attacks, otherwise answers in part."""
        if (batch["attack_count"] % 2 == 1).any():
            raise RuntimeError("no assessment")
        return [{"methodology": "mixed", "skill_level": None} for _ in range(len(batch))]

    facts = profile.profile_facts(profile.port_facts(_alerts(spark, sf_dir)))
    return score.assess_profiles(facts, partial_assessor).select(
        "src_ip", "attack_count", *schemas.ASSESSMENT.fieldNames()
    )


def _flat(profiles: DataFrame) -> DataFrame:
    def text(name: str) -> Column:
        return F.array_join(F.transform(name, lambda x: x.cast("string")), ", ").alias(name)

    return profiles.select(
        "src_ip", "total", text("attack_types"), text("signatures"), text("ports"),
        "max_risk", "time_start", "time_end", text("kill_chain"), "threat_level",
    )


@query
def attacker_profile(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    population = report.newest_alerts(alerts)
    return _flat(analytics.current_profiles(alerts, population))


@query
def attacker_profile_whole_table(spark, sf_dir):
    return _flat(profile.attacker_profile(_alerts(spark, sf_dir)))


@query
def attacker_os(spark, sf_dir):
    return profile.attacker_os(_alerts(spark, sf_dir))


def _by_id(alerts: DataFrame, batches: int) -> list[DataFrame]:
    """The alerts as that many batches, in order of their ids."""
    first, last = alerts.agg(F.min("id"), F.max("id")).first()
    batch = F.floor((F.col("id") - F.lit(first)) * batches / F.lit(last - first + 1))
    return [alerts.filter(batch == i) for i in range(batches)]


def _stored_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roll-up of the alerts, kept batch by batch and merged on the way."""
    path = fresh_path(spark, "rollup")
    table = SnapshotTable(spark, path, schemas.ROLLUP, bucket_by="src_ip", buckets=8)
    for batch, rows in enumerate(_by_id(_alerts(spark, sf_dir), 5)):
        table.write(rollup.roll_up(rows), batch)
        table.merge(rollup.merged, fanout=3)
    return table.read().drop("batch_id")


@query
def attacker_profile_rollup(spark, sf_dir):
    return _flat(rollup.attacker_profile(_stored_rollup(spark, sf_dir)))


@query
def attacker_os_rollup(spark, sf_dir):
    return rollup.attacker_os(_stored_rollup(spark, sf_dir))


def _stored_view(spark: SparkSession, sf_dir: str, **options) -> analytics.AnalystView:
    """The view over a stored table, read anew."""
    path = fresh_path(spark, "stored-alerts")
    _alerts(spark, sf_dir).write.parquet(path)
    return analytics.analyst_view(spark.read.parquet(path), **options)


@query
def view_kpis(spark, sf_dir):
    return _stored_view(spark, sf_dir)["kpis"]


@query
def feed_count(spark, sf_dir):
    return _stored_view(spark, sf_dir, min_risk=2)["feed_count"]


@query
def feed_count_whole_table(spark, sf_dir):
    return report.feed_count(report.filter_alerts(_alerts(spark, sf_dir), min_risk=2))


@query
def attacker_card_os(spark, sf_dir):
    cards = _stored_view(spark, sf_dir)["attackers"]
    return cards.select("src_ip", "total", "ttl", "os")


@query
def view_assessment(spark, sf_dir):
    """An assessor that leaves keys out, and fails for addresses ending in 7."""

    def assessor(batch: pd.DataFrame) -> list[dict]:
        if batch["src_ip"].str.endswith("7").any():
            raise ValueError("no answer")
        return [{"methodology": f"{n} alerts", "skill_level": "script_kiddie"} for n in batch["total"]]

    profiles = profile.attacker_profile(_alerts(spark, sf_dir))
    return score.assess_cards(profiles, assessor).select(
        "src_ip", "methodology", "objective", "skill_level", "response",
        "assessed_threat_level", "assessed",
    )


@query
def profile_assessment(spark, sf_dir):
    profiles = profile.attacker_profile(_alerts(spark, sf_dir))
    steps = F.col("kill_chain")
    return profiles.select(
        "src_ip", "threat_level",
        assessment.steps_text(steps).alias("kill_chain"),
        assessment.rule_objective(steps).alias("objective"),
        assessment.rule_skill(steps).alias("skill_level"),
        assessment.rule_response(F.col("src_ip")).alias("response"),
    )


@query
def profile_card(spark, sf_dir):
    return profile.profile_card(profile.attacker_profile(_alerts(spark, sf_dir)))


# --- stored tables ----------------------------------------------------------------


@query
def add_column_default(spark, sf_dir):
    alerts = _alerts(spark, sf_dir)
    before = F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    old, new = alerts.filter(before).drop("ttl"), alerts.filter(~before)
    field = T.StructField("ttl", T.LongType())
    extended = tables.add_column(old, field, 0).select("id", "ttl")
    return extended.unionByName(
        tables.union_with_defaults([new, old], {"ttl": 0}).filter(~before).select("id", "ttl")
    )


@query
def clear_table(spark, sf_dir):
    path = fresh_path(spark, "cleared")
    alerts = _alerts(spark, sf_dir)
    alerts.write.parquet(path)
    before = spark.read.parquet(path).count()
    left = tables.clear_table(spark, path, alerts.schema)
    return spark.range(1).select(
        F.lit(before).cast("bigint").alias("rows_before"),
        F.lit(left).cast("bigint").alias("rows_left"),
    )


# --- streams ----------------------------------------------------------------------


def _line_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binding.alert_lines(binding.events_stream(spark, sf_dir)).select("value")


def _ingested(spark: SparkSession, sf_dir: str) -> ingest.Tables:
    where = ingest.Tables.below(fresh_path(spark, "ingest"))
    flows = binding.flow_lines(binding.events_stream(spark, sf_dir))
    ingest.start_flow_ingest(flows, where, available_now=True).awaitTermination()
    ingest.start_ingest(
        _line_stream(spark, sf_dir), where, available_now=True
    ).awaitTermination()
    return where


def _flows_in_batches(events: DataFrame, where: ingest.Tables) -> None:
    """The flow lines of ``events`` batch by batch, merged on the way."""
    ingest.start_flow_ingest(
        binding.flow_lines(events), where, merge_every=2, available_now=True
    ).awaitTermination()


@query
def stream_dedup(spark, sf_dir):
    path = fresh_path(spark, "distinct-lines")
    distinct = ingest.distinct_lines(_line_stream(spark, sf_dir))
    distinct.writeStream.format("parquet").option(
        "checkpointLocation", f"{path}-progress"
    ).trigger(availableNow=True).start(path).awaitTermination()
    stored = spark.read.schema(distinct.schema).parquet(path)
    return stored.withColumn("line_hash", F.lower(F.hex("line_hash")))


@query
def stream_ingest(spark, sf_dir):
    where = _ingested(spark, sf_dir)
    return ingest.stored_alerts(spark, where).drop("id", "created_at")


@query
def stream_ingest_batches(spark, sf_dir):
    """The events as several files, one file per micro-batch."""
    where = ingest.Tables.below(fresh_path(spark, "ingest"))
    events = binding.events_stream_of_files(spark, sf_dir, fresh_path(spark, "landing"), files=4)
    _flows_in_batches(events, where)
    ingest.start_ingest(
        binding.alert_lines(events).select("value"), where, available_now=True
    ).awaitTermination()
    return ingest.stored_alerts(spark, where).drop("id", "created_at")


@query
def stream_ingest_merged(spark, sf_dir):
    """As several batches, the tables' parts being merged on the way."""
    where = ingest.Tables.below(fresh_path(spark, "ingest"))
    events = binding.events_stream_of_files(spark, sf_dir, fresh_path(spark, "landing"), files=5)
    _flows_in_batches(events, where)
    ingest.start_ingest(
        binding.alert_lines(events).select("value"), where, available_now=True, merge_every=2,
    ).awaitTermination()
    return ingest.stored_alerts(spark, where).drop("id", "created_at")


@query
def stream_ttl(spark, sf_dir):
    """The TTL per source kept up by a stream of flow lines, in five batches."""
    where = ingest.Tables.below(fresh_path(spark, "ingest"))
    events = binding.events_stream_of_files(spark, sf_dir, fresh_path(spark, "landing"), files=5)
    _flows_in_batches(events, where)
    return ingest.known_ttl(spark, where)


@query
def stream_profile_sequence(spark, sf_dir):
    """Profiles whose assessor repeats the attack sequence it was given."""
    where = ingest.Tables.below(fresh_path(spark, "ingest"))

    def assessor(batch: pd.DataFrame) -> list[dict]:
        return [{"methodology": sequence} for sequence in batch["attack_sequence"]]

    ingest.start_ingest(
        _line_stream(spark, sf_dir), where, assessor=assessor, available_now=True
    ).awaitTermination()
    return ingest.stored_profiles(spark, where).select(
        "src_ip", "attack_count", F.col("methodology").alias("attack_sequence")
    )


@query
def stream_profile_parts(spark, sf_dir):
    """Profiles whose assessor reads the attack sequence part by part."""
    where = ingest.Tables.below(fresh_path(spark, "ingest"))

    def assessor(source: str, texts: Iterator[str]) -> dict:
        digest, steps = hashlib.sha256(), 0
        for n, text in enumerate(texts):
            digest.update(((ARROW if n else "") + text).encode())
            steps += text.count(ARROW) + 1
        return {"methodology": digest.hexdigest(), "objective": str(steps)}

    ingest.start_ingest(
        _line_stream(spark, sf_dir), where, sequence_assessor=assessor, available_now=True
    ).awaitTermination()
    return ingest.stored_profiles(spark, where).select(
        "src_ip", "attack_count", F.col("methodology").alias("sequence_sha256"),
        F.col("objective").cast("bigint").alias("steps"), "recommended_response",
    )


@query
def stream_new_per_batch(spark, sf_dir):
    return ingest.batch_counts(spark, _ingested(spark, sf_dir)).select("alerts")


@query
def stream_profiles(spark, sf_dir):
    where = _ingested(spark, sf_dir)
    return ingest.stored_profiles(spark, where).drop(
        "id", "time_span", "created_at", "updated_at"
    )


@query
def stream_kpis(spark, sf_dir):
    path = fresh_path(spark, "kpis")
    scored = score.score_alerts(ingest.parsed_stream(_line_stream(spark, sf_dir)))
    ingest.start_kpis(
        scored, path, f"{path}-progress", available_now=True
    ).awaitTermination()
    return ingest.current_kpis(spark, path)
