"""Mergeable roll-up of alerts, from which profiles are made without the alerts.

One row per source, port and (for hacks) attack type and signature. Counts,
minima and maxima only, so the roll-ups of any batches may be united, or merged
into fewer rows, and give the same profiles. First and last positions keep the
order in which values were first seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.functions import bands
from palisade.operators import profile

KEYS = ("src_ip", "dst_port", "attack_type", "signature")


def roll_up(alerts: DataFrame) -> DataFrame:
    """The roll-up of stored alerts; usable as the facts of :func:`profile.profile_facts`."""
    hack = F.coalesce(F.col("llm_classification") == "hack", F.lit(False))
    at = F.struct(*profile.TIME_ORDER)
    hack_seen = F.when(hack, F.struct(at.alias("at"), "timestamp"))
    ttl_seen = F.when(F.col("ttl") > 0, F.struct(at.alias("at"), "ttl"))
    return (
        alerts.withColumn("_hack", hack).withColumn("_hack_seen", hack_seen)
        .withColumn("_ttl_seen", ttl_seen)
        .withColumn("attack_type", F.when(hack, F.col("attack_type")))
        .withColumn("signature", F.when(hack, F.col("signature")))
        .groupBy(*KEYS)
        .agg(
            F.count_if("_hack").alias("hacks"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
            F.min("_hack_seen.at.created_at").alias("first_hack"),
            F.max("_hack_seen.at.created_at").alias("last_hack"),
            F.max(F.when(F.col("_hack"), F.coalesce("risk_score", F.lit(0)))).alias("max_risk"),
            F.max(F.when(F.col("_hack"), F.col("risk_score"))).alias("top_risk"),
            F.min("_hack_seen").alias("oldest"),
            F.max("_hack_seen").alias("newest"),
            F.max("_ttl_seen").alias("newest_ttl"),
        )
    )


def merged(rollups: DataFrame) -> DataFrame:
    """Roll-ups of several batches as one, a row per key."""
    def lowest(name: str) -> Column:
        return F.min(name).alias(name)

    def highest(name: str) -> Column:
        return F.max(name).alias(name)

    return rollups.groupBy(*KEYS).agg(
        F.sum("hacks").alias("hacks"), lowest("first_seen"), highest("last_seen"),
        lowest("first_hack"), highest("last_hack"), highest("max_risk"), highest("top_risk"),
        lowest("oldest"), highest("newest"), highest("newest_ttl"),
    )


def _of(rollups: DataFrame, sources: DataFrame | None) -> DataFrame:
    if sources is None:
        return rollups
    return rollups.join(sources.select("src_ip"), "src_ip", "left_semi")


def attacker_profile(rollups: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """What :func:`profile.attacker_profile` gives, from the roll-up alone."""
    hacks = _of(rollups.filter("hacks > 0"), sources)
    return profile.profiles_of(hacks.select(
        *KEYS, F.col("hacks").alias("rows"), F.col("top_risk").alias("max_risk"), "oldest", "newest",
    ))


def attacker_os(rollups: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """What :func:`profile.attacker_os` gives, from the roll-up alone."""
    newest = _of(rollups, sources).groupBy("src_ip").agg(F.max("newest_ttl")["ttl"].alias("ttl"))
    ttl = F.coalesce(F.col("ttl"), F.lit(0))
    return newest.select("src_ip", ttl.alias("ttl"), bands.os_family(ttl).alias("os"))
