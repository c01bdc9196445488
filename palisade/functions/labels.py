"""Labels of a single alert."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade import fixed_values as fixed


def lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    """Value of a small constant table, or the default."""
    entries = F.create_map(*(F.lit(x) for item in table.items() for x in item))
    return F.coalesce(F.try_element_at(entries, key), default)


def needed_pieces(pattern: str) -> list[str]:
    """Literal pieces of a pattern: a text that holds none of them cannot match it.

    Empty if the pattern is more than alternatives of literals, ``.?`` and ``\\b``.
    """
    pieces = []
    for alternative in pattern.split("|"):
        runs = re.split(r"\.\?|\\b", alternative)
        longest = max(runs, key=len)
        if not longest or any(re.search(r"[\\^$.*+?()\[\]{}]", run) for run in runs):
            return []
        pieces.append(longest)
    return [p for p in dict.fromkeys(pieces) if not any(o != p and o in p for o in pieces)]


def _occurs(text: Column, pattern: str) -> Column:
    """Whether the pattern matches somewhere; looking for its pieces first is much cheaper."""
    pieces = needed_pieces(pattern)
    if not pieces:
        return text.rlike(pattern)
    return reduce(Column.__or__, (F.contains(text, F.lit(p)) for p in pieces)) & text.rlike(pattern)


def attack_type(signature: Column) -> Column:
    """First attack type whose pattern occurs in the signature, else other."""
    text = F.lower(signature)
    (pattern, label), *rest = fixed.ATTACK_TYPE_PATTERNS
    ladder = reduce(
        lambda chain, entry: chain.when(_occurs(text, entry[0]), F.lit(entry[1])),
        rest,
        F.when(_occurs(text, pattern), F.lit(label)),
    )
    return ladder.otherwise(F.lit(fixed.OTHER_ATTACK))


def kill_chain_stage(attack: Column) -> Column:
    return lookup(fixed.KILL_CHAIN_STAGES, attack, F.lit(fixed.UNKNOWN_STAGE))


def attack_label(attack: Column) -> Column:
    """Display label; a type without one shows as itself."""
    return lookup(fixed.ATTACK_LABELS, attack, attack)


def fp_likelihood(
    signature: Column, priority: Column, flow_bytes: Column | None
) -> Column:
    """Likelihood (0-100) that the alert is noise.

    Pass ``flow_bytes=None`` when no flow data was supplied at all: every
    alert then gets the no-traffic points. With flow data only a known zero
    does; an alert that found no flow record gets none.
    """

    def points(condition: Column, score: int) -> Column:
        return F.when(condition, F.lit(score)).otherwise(F.lit(0))

    score = (
        points(F.startswith(F.upper(signature), F.lit(fixed.NOISE_PREFIX)), fixed.NOISE_PREFIX_POINTS)
        + points(priority == fixed.LOW_PRIORITY, fixed.LOW_PRIORITY_POINTS)
        + points(signature.rlike(fixed.INFORMATIONAL_PATTERN), fixed.INFORMATIONAL_POINTS)
    )
    if flow_bytes is None:
        score = score + F.lit(fixed.NO_TRAFFIC_POINTS)
    else:
        score = score + points(flow_bytes == 0, fixed.NO_TRAFFIC_POINTS)
    return F.least(score, F.lit(fixed.MAX_LIKELIHOOD)).cast("bigint")


def ground_truth(likelihood: Column) -> Column:
    return F.when(
        likelihood >= fixed.FALSE_POSITIVE_FROM, F.lit("false_positive")
    ).otherwise(F.lit("true_positive"))
