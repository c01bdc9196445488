"""Newest alerts, filters, key figures, distributions and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions import bands, labels
from palisade.schemas import RECENT_COLUMNS

# --- the population -------------------------------------------------------------


def newest_alerts(alerts: DataFrame, limit: int | None = fixed.NEWEST_ROWS) -> DataFrame:
    """The ``limit`` newest alerts, newest first.

    ``None`` keeps all as they are: figures over all alerts need no order.
    """
    if limit is None:
        return alerts
    return alerts.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def newest_stored_alerts(
    alerts: DataFrame, limit: int = fixed.NEWEST_ROWS
) -> DataFrame:
    """Same rows as :func:`newest_alerts`, for a large stored table.

    The age of the oldest row wanted is found from one column first. As a
    filter it reaches the scan, where the row-group ranges of ``created_at``
    rule out nearly everything before the wide columns are read. Rows without
    ``created_at`` are the oldest.
    """
    oldest = (
        alerts.select("created_at").orderBy(F.desc("created_at")).limit(limit)
        .agg(F.min("created_at"))
    ).scalar()
    recent = (F.col("created_at") >= oldest) | F.col("created_at").isNull()
    return newest_alerts(alerts.filter(recent), limit)


def recent_listing(alerts: DataFrame, limit: int = fixed.NEWEST_ROWS) -> DataFrame:
    """The compact 13-column listing of the newest alerts."""
    return newest_alerts(alerts, limit).select(*RECENT_COLUMNS)


def filter_alerts(
    alerts: DataFrame,
    *,
    hide_false_positives: bool = True,
    verdicts: tuple[str, ...] = ("hack", "normal"),
    attack_types: tuple[str, ...] = tuple(fixed.ATTACK_LABELS),
    min_risk: int = 0,
) -> DataFrame:
    """Feed filters; an empty tuple switches its filter off."""
    kept = alerts
    if hide_false_positives:
        kept = kept.filter(F.col("false_positive_likelihood") < fixed.SUPPRESS_FROM)
    if verdicts:
        kept = kept.filter(F.col("llm_classification").isin(*verdicts))
    if attack_types:
        kept = kept.filter(F.col("attack_type").isin(*attack_types))
    return kept.filter(F.col("risk_score") >= min_risk)


# --- key figures ----------------------------------------------------------------


def _hack():
    return F.col("llm_classification") == "hack"


def _suppressed():
    return F.col("false_positive_likelihood") >= fixed.SUPPRESS_FROM


def kpis(alerts: DataFrame) -> DataFrame:
    """One row: totals and whole-percent shares. Works on streams too."""
    counts = alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_hack()).alias("hacks"),
        F.count_if(F.col("risk_score") >= fixed.CRITICAL_RISK).alias("critical"),
        F.count_if(_suppressed()).alias("suppressed"),
    )
    total = F.col("total")
    return counts.select(
        "*",
        bands.percent(F.col("hacks"), total).alias("hack_percent"),
        bands.percent(F.col("suppressed"), total).alias("suppressed_percent"),
    )


def fp_suppression(alerts: DataFrame) -> DataFrame:
    """One row: suppression rate, suppressed, confirmed threats, shown."""
    counts = alerts.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(_suppressed()).alias("suppressed"),
        F.count_if(
            _hack() & (F.col("false_positive_likelihood") < fixed.SUPPRESS_FROM)
        ).alias("confirmed"),
    )
    total, suppressed = F.col("total"), F.col("suppressed")
    return counts.select(
        bands.percent(suppressed, total, 1).alias("suppression_rate"),
        "suppressed", "confirmed", (total - suppressed).alias("shown"),
    )


# --- distributions ---------------------------------------------------------------


def verdict_counts(alerts: DataFrame) -> DataFrame:
    """Counts per verdict; alerts without one are not counted."""
    return (
        alerts.filter(F.col("llm_classification").isNotNull()).groupBy("llm_classification")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .orderBy(F.desc("alerts"), "llm_classification")
    )


def attack_type_counts(alerts: DataFrame) -> DataFrame:
    """Counts per attack type with display label, without ``other``."""
    return (
        alerts.filter(F.col("attack_type") != fixed.OTHER_ATTACK)
        .groupBy("attack_type")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .withColumn("label", labels.attack_label(F.col("attack_type")))
        .orderBy(F.desc("alerts"), "attack_type")
    )


def label_distribution(dataset: DataFrame) -> DataFrame:
    """Value counts of the four label columns, in one pass over the rows."""
    names = ("ground_truth", "attack_type", "kill_chain_stage", "interface")
    pairs = F.array(*(
        F.struct(F.lit(n).alias("dimension"), F.col(n).alias("value")) for n in names
    ))
    return (
        dataset.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("alerts"))
        .orderBy("dimension", F.desc("alerts"), "value")
    )


def fp_histogram(dataset: DataFrame) -> DataFrame:
    """Counts in ten bins of ten points, right-closed, empty bins included.

    The first bin also holds 0. Values outside 0-100 are in no bin.
    """
    score = F.col("fp_likelihood")
    bin_no = F.greatest(F.ceil(score / 10), F.lit(1)).cast("bigint")
    counts = (
        dataset.filter(score.between(0, 100))
        .groupBy(bin_no.alias("bin_no"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bins = dataset.sparkSession.range(1, 11).select(F.col("id").alias("bin_no"))
    return (
        bins.join(counts, "bin_no", "left")
        .select(
            "bin_no",
            ((F.col("bin_no") - 1) * 10).alias("above"),
            (F.col("bin_no") * 10).alias("up_to"),
            F.coalesce("n", F.lit(0)).alias("alerts"),
        )
        .orderBy("bin_no")
    )


def enrichment_coverage(dataset: DataFrame) -> DataFrame:
    """One row: how many alerts have each of the main flow columns."""
    return dataset.agg(
        F.count("flow_bytes").alias("flow_bytes_filled"),
        F.count("flow_duration").alias("flow_duration_filled"),
        F.count("app_proto").alias("app_proto_filled"),
        F.count(F.lit(1)).alias("total"),
    )


def risk_timeline(alerts: DataFrame) -> DataFrame:
    """Risk over time, oldest first."""
    return alerts.select(
        F.col("created_at").try_cast("timestamp_ntz").alias("time"), "risk_score", "id"
    ).orderBy("time", "id").drop("id")


# --- feed ------------------------------------------------------------------------


def feed_count(alerts: DataFrame) -> DataFrame:
    """One row: how many alerts the feed's filters let through, before its limit."""
    return alerts.agg(F.count(F.lit(1)).alias("alerts"))


def alert_feed(alerts: DataFrame, limit: int | None = fixed.FEED_ROWS) -> DataFrame:
    """Display columns of the newest alerts: summary line plus detail panel.

    Newest first, also without a limit.
    """
    risk, likelihood = F.col("risk_score"), F.col("false_positive_likelihood")
    if limit is None:
        newest = alerts.orderBy(F.desc("created_at"), F.desc("id"))
    else:
        newest = newest_alerts(alerts, limit)
    return newest.select(
        "id",
        F.substring("timestamp", 1, 19).alias("time"),
        bands.shortened(F.col("signature"), 48).alias("signature"),
        F.concat("src_ip", F.lit(" → "), "dst_ip").alias("route"),
        "llm_classification",
        labels.attack_label(F.col("attack_type")).alias("attack_label"),
        "risk_score",
        bands.risk_class(risk).alias("risk_class"),
        bands.risk_color(risk).alias("risk_color"),
        (risk * 6).cast("bigint").alias("bar_width"),
        bands.fp_band(likelihood).alias("fp_band"),
        bands.severity_flag(risk).alias("severity"),
        F.substring("signature", 1, 55).alias("title"),
        "explanation", "protocol", "src_port", "dst_port", "priority",
        "false_positive_likelihood",
    )


# --- accuracy against expected verdicts --------------------------------------------


def accuracy_report(
    alerts: DataFrame,
    expected: Sequence[tuple[str, str]] = fixed.EXPECTED_VERDICTS,
) -> DataFrame:
    """Per expected signature: alerts, correct verdicts, percent, status.

    The signatures reach the scan as a filter, and alerts are counted before
    the join; signatures without alerts stay with zeros. Rows come in the
    order of the list.
    """
    table = alerts.sparkSession.createDataFrame(
        [(i, *pair) for i, pair in enumerate(expected)],
        "place int, signature string, expected string",
    )
    counts = (
        alerts.filter(F.col("signature").isin(*(signature for signature, _ in expected)))
        .groupBy("signature", "llm_classification")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    correct = F.col("llm_classification") == F.col("expected")
    return (
        table.join(counts, "signature", "left")
        .groupBy("place", "signature", "expected")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("alerts"),
            F.coalesce(F.sum(F.when(correct, F.col("n"))), F.lit(0)).alias("correct"),
        )
        .withColumn("accuracy", bands.percent(F.col("correct"), F.col("alerts")))
        .withColumn("status", bands.accuracy_status(F.col("accuracy")))
        .orderBy("place")
        .drop("place")
    )


def accuracy_overall(report: DataFrame) -> DataFrame:
    totals = report.agg(
        F.sum("correct").alias("correct"), F.sum("alerts").alias("alerts")
    )
    return totals.withColumn(
        "accuracy", bands.percent(F.col("correct"), F.col("alerts"))
    )
