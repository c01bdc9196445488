"""Kill-chain steps and the rule-based assessment of one attacker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import fixed_values as fixed

ARROW = " → "


def profile_steps(attack_types: Column) -> Column:
    """Steps, in kill-chain order, that the set of attack types shows."""
    steps = (
        F.when(
            F.arrays_overlap(attack_types, F.array(*(F.lit(t) for t in types))),
            F.lit(step),
        )
        for step, types in fixed.PROFILE_STEPS
    )
    return F.array_compact(F.array(*steps))


def steps_text(steps: Column) -> Column:
    return F.when(
        F.size(steps) > 0, F.array_join(steps, ARROW)
    ).otherwise(F.lit("Undetermined"))


def _ladder(steps: Column, multi: str, disruption: str, rest: str) -> Column:
    return (
        F.when(F.size(steps) >= 3, F.lit(multi))
        .when(F.array_contains(steps, "Disruption"), F.lit(disruption))
        .otherwise(F.lit(rest))
    )


def rule_objective(steps: Column) -> Column:
    return _ladder(
        steps,
        "Systematic multi-stage attack following cyber kill chain",
        "Service disruption / denial of service",
        "Reconnaissance and information gathering",
    )


def rule_skill(steps: Column) -> Column:
    return _ladder(steps, "INTERMEDIATE", "SCRIPT KIDDIE", "SCRIPT KIDDIE")


def rule_response(src_ip: Column) -> Column:
    return F.concat(
        F.lit("Block "), src_ip,
        F.lit(" at firewall level. Review all targeted ports."),
    )
