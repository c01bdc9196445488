"""Repeat attackers and their profiles.

One source may own a large share of all alerts. Facts are therefore grouped
twice: first by source *and* the value at hand (port, attack type, signature),
which combines inside the map tasks and leaves one row per distinct value,
then by source over those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions import assessment, bands
from palisade.operators.numbering import with_position

TIME_ORDER = ("created_at", "id")


def _is_hack() -> Column:
    return F.coalesce(F.col("llm_classification") == "hack", F.lit(False))


def _time_order() -> Column:
    return F.struct(*TIME_ORDER)


def repeat_attackers(
    alerts: DataFrame, *, minimum: int = fixed.MIN_REPEAT_HACKS
) -> DataFrame:
    """Sources with at least ``minimum`` hack alerts."""
    return (
        alerts.filter(_is_hack())
        .groupBy("src_ip")
        .agg(F.count(F.lit(1)).alias("attack_count"))
        .filter(F.col("attack_count") >= minimum)
    )


def without_profile(attackers: DataFrame, profiles: DataFrame) -> DataFrame:
    """Attackers that have no stored profile yet."""
    return attackers.join(profiles.select("src_ip"), "src_ip", "left_anti")


def attack_sequence(
    alerts: DataFrame, *, minimum: int = fixed.MIN_REPEAT_HACKS, at: str | None = None
) -> DataFrame:
    """Every hack alert of a repeat attacker with its place in the sequence.

    One row per alert: ``src_ip``, ``position`` (1 is the oldest),
    ``attack_type`` (``unknown`` if empty). ``at`` as for :func:`with_position`.
    """
    hacks = alerts.filter(_is_hack()).select(
        "src_ip", *TIME_ORDER,
        F.coalesce(F.nullif("attack_type", F.lit("")), F.lit("unknown")).alias("attack_type"),
    )
    numbered = with_position(
        hacks, list(TIME_ORDER), within=["src_ip"], total="hacks", at=at
    )
    return numbered.filter(F.col("hacks") >= minimum).select(
        "src_ip", "position", "attack_type"
    )


def sequence_text(sequence: DataFrame, *, steps_per_row: int = 10_000) -> DataFrame:
    """The sequence of each attacker as text, in rows of bounded length.

    Row ``part`` holds the steps after the first ``part * steps_per_row``;
    joined in order of ``part`` the rows are the whole sequence.
    """
    part = F.floor((F.col("position") - 1) / F.lit(steps_per_row)).cast("bigint")
    step = F.struct("position", "attack_type")
    return (
        sequence.withColumn("part", part)
        .groupBy("src_ip", "part")
        .agg(F.sort_array(F.collect_list(step)).alias("steps"))
        .select(
            "src_ip", "part",
            F.size("steps").cast("bigint").alias("step_count"),
            F.array_join(F.col("steps.attack_type"), assessment.ARROW).alias("attack_sequence"),
        )
    )


# --- facts of the stored profile ----------------------------------------------


def port_facts(alerts: DataFrame) -> DataFrame:
    """Mergeable facts per source, port and hack attack type.

    Counts, minima and maxima only, so facts of several batches of alerts can
    be united and given to :func:`profile_facts` as if they were one.
    """
    hack = _is_hack()
    return (
        alerts.withColumn("attack_type", F.when(hack, F.col("attack_type")))
        .groupBy("src_ip", "dst_port", "attack_type")
        .agg(
            F.count_if(hack).alias("hacks"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
            F.min(F.when(hack, F.col("created_at"))).alias("first_hack"),
            F.max(F.when(hack, F.col("created_at"))).alias("last_hack"),
            F.max(F.when(hack, F.coalesce("risk_score", F.lit(0)))).alias("max_risk"),
        )
    )


def _ports(condition: Column) -> Column:
    """Distinct positive ports as text, ascending."""
    port = F.when((F.col("dst_port") > 0) & condition, F.col("dst_port"))
    return F.array_join(
        F.transform(F.sort_array(F.collect_set(port)), lambda p: p.cast("string")), ", "
    )


def profile_facts(
    facts: DataFrame, *, minimum: int = fixed.MIN_REPEAT_HACKS
) -> DataFrame:
    """One row per repeat attacker, from :func:`port_facts`.

    ``ports_targeted`` and ``first_seen``/``last_seen`` cover all verdicts of
    the source; ``hack_ports``, ``first_hack``/``last_hack``, ``max_risk`` and
    ``attack_types`` its hack alerts only.
    """
    return (
        facts.groupBy("src_ip")
        .agg(
            F.sum("hacks").alias("attack_count"),
            _ports(F.lit(True)).alias("ports"),
            _ports(F.col("hacks") > 0).alias("hack_ports"),
            F.min("first_seen").alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.min("first_hack").alias("first_hack"),
            F.max("last_hack").alias("last_hack"),
            F.max("max_risk").alias("max_risk"),
            F.sort_array(F.collect_set("attack_type")).alias("attack_types"),
        )
        .filter(F.col("attack_count") >= minimum)
        .withColumn("ports_targeted", _or_none(F.col("ports")))
        .drop("ports")
    )


def _or_none(text: Column) -> Column:
    return F.when(text == "", F.lit("none")).otherwise(text)


def time_span(first: Column, last: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.when(
        first.isNotNull(),
        F.concat(F.date_format(first, pattern), F.lit(" to "), F.date_format(last, pattern)),
    ).otherwise(F.lit("unknown"))


# --- facts shown with an attacker ---------------------------------------------


def attacker_profile(alerts: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """One row per source with hack alerts: counts, lists, risk and time range.

    Attack types and signatures are distinct in the order they first occurred,
    ports distinct and ascending. ``sources`` limits the profiles to the given
    addresses (a frame with ``src_ip``); all their alerts count.

    Alerts are first reduced to one row per combination of the three values,
    which happens inside the map tasks and is where a hot source shrinks. Each
    combination then yields three facets, reduced again to distinct values
    before anything is collected.
    """
    hacks = alerts.filter(_is_hack())
    if sources is not None:
        hacks = hacks.join(sources.select("src_ip"), "src_ip", "left_semi")

    seen = F.struct("at", "timestamp")
    return profiles_of(
        hacks.withColumn("at", _time_order())
        .groupBy("src_ip", "attack_type", "signature", "dst_port")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.max("risk_score").alias("max_risk"),
            F.min(seen).alias("oldest"),
            F.max(seen).alias("newest"),
        )
    )


def profiles_of(combinations: DataFrame) -> DataFrame:
    """The profiles, from hacks counted per source, attack type, signature and port.

    ``rows``, ``max_risk`` and the ``oldest`` and ``newest`` hack (``at``,
    ``timestamp``); a combination may come in several rows.
    """

    def facet(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"))

    facets = combinations.select(
        "src_ip", "rows", "max_risk", "oldest", "newest",
        F.inline(F.array(
            facet("type", F.col("attack_type")),
            facet("signature", F.col("signature")),
            facet("port", F.col("dst_port")),
        )),
    )
    # each row has exactly one type facet: it carries the row count
    distinct = facets.groupBy("src_ip", "kind", "value").agg(
        F.sum(F.when(F.col("kind") == "type", F.col("rows"))).alias("rows"),
        F.max("max_risk").alias("max_risk"),
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
    ).withColumn("first_at", F.col("oldest.at"))

    def collected(kind: str, *order: str) -> Column:
        entry = F.when(F.col("kind") == kind, F.struct(*order, "value"))
        return F.sort_array(F.collect_list(entry))["value"]

    profiles = distinct.withColumn(
        "number", F.when(F.col("kind") == "port", F.col("value").try_cast("bigint"))
    ).groupBy("src_ip").agg(
        F.sum("rows").alias("total"),
        collected("type", "first_at").alias("attack_types"),
        collected("signature", "first_at").alias("signatures"),
        collected("port", "number").alias("port_texts"),
        F.max("max_risk").alias("max_risk"),
        F.min("oldest")["timestamp"].alias("time_start"),
        F.max("newest")["timestamp"].alias("time_end"),
    )
    return profiles.select(
        "src_ip", "total", "attack_types", "signatures",
        F.transform("port_texts", lambda p: p.cast("bigint")).alias("ports"),
        "max_risk", "time_start", "time_end",
        assessment.profile_steps(F.col("attack_types")).alias("kill_chain"),
        bands.threat_level(F.col("max_risk")).alias("threat_level"),
    )


def attacker_os(alerts: DataFrame) -> DataFrame:
    """Newest positive TTL of every source (0 if none) and the OS it suggests."""
    known = F.when(F.col("ttl") > 0, _time_order())
    newest = alerts.groupBy("src_ip").agg(F.max_by("ttl", known).alias("ttl"))
    ttl = F.coalesce(F.col("ttl"), F.lit(0))
    return newest.select("src_ip", ttl.alias("ttl"), bands.os_family(ttl).alias("os"))


def profile_card(profiles: DataFrame) -> DataFrame:
    """Display texts of a profile: capped lists and the rule-based assessment."""
    steps = F.col("kill_chain")
    return profiles.select(
        "src_ip", "total", "max_risk", "threat_level", "time_start", "time_end",
        F.array_join(F.col("attack_types"), assessment.ARROW).alias("attack_sequence"),
        F.array_join(
            F.transform(F.slice("signatures", 1, 6), lambda s: F.substring(s, 1, 40)), " · "
        ).alias("signatures"),
        F.array_join(
            F.transform(F.slice("ports", 1, 10), lambda p: p.cast("string")), ", "
        ).alias("ports"),
        assessment.steps_text(steps).alias("kill_chain"),
        assessment.rule_objective(steps).alias("objective"),
        assessment.rule_skill(steps).alias("skill_level"),
        assessment.rule_response(F.col("src_ip")).alias("response"),
    )
