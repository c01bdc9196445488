"""Threshold bands, percentages and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import fixed_values as fixed


def risk_class(risk: Column) -> Column:
    return (
        F.when(risk >= fixed.CRITICAL_RISK, F.lit("critical"))
        .when(risk >= fixed.WARNING_RISK, F.lit("warning"))
        .otherwise(F.lit("safe"))
    )


def risk_color(risk: Column) -> Column:
    return (
        F.when(risk >= fixed.CRITICAL_RISK, F.lit("red"))
        .when(risk >= fixed.WARNING_RISK, F.lit("amber"))
        .otherwise(F.lit("green"))
    )


def fp_band(likelihood: Column) -> Column:
    return (
        F.when(likelihood >= fixed.SUPPRESS_FROM, F.lit("red"))
        .when(likelihood >= fixed.AMBER_FROM, F.lit("amber"))
        .otherwise(F.lit("green"))
    )


def severity_flag(risk: Column) -> Column:
    """Marker of a freshly ingested alert."""
    return F.when(
        F.coalesce(risk, F.lit(0)) >= fixed.SEVERE_RISK, F.lit("severe")
    ).otherwise(F.lit("notice"))


def threat_level(max_risk: Column) -> Column:
    return F.when(max_risk >= fixed.CRITICAL_RISK, F.lit("CRITICAL")).otherwise(
        F.lit("HIGH")
    )


def accuracy_status(percent: Column) -> Column:
    return (
        F.when(percent >= fixed.PASS_ACCURACY, F.lit("pass"))
        .when(percent >= fixed.WARN_ACCURACY, F.lit("warn"))
        .otherwise(F.lit("fail"))
    )


def os_family(ttl: Column) -> Column:
    """Operating-system guess from an observed time-to-live."""
    return (
        F.when(ttl == 0, F.lit("Unknown"))
        .when(ttl <= fixed.LINUX_MAX_TTL, F.lit("Linux/Unix"))
        .when(ttl <= fixed.WINDOWS_MAX_TTL, F.lit("Windows"))
        .when(ttl <= fixed.DEVICE_MAX_TTL, F.lit("Network Device"))
        .otherwise(F.lit("Unknown"))
    )


def percent(part: Column, whole: Column, decimals: int = 0) -> Column:
    """Half-even rounded share of ``whole`` in percent; 0 of nothing is 0."""
    share = part / F.greatest(whole, F.lit(1)) * F.lit(100.0)
    rounded = F.bround(share, decimals)
    return rounded if decimals else rounded.cast("bigint")


def shortened(text: Column, limit: int) -> Column:
    """The first ``limit`` characters, with an ellipsis if any were cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))
    ).otherwise(text)
