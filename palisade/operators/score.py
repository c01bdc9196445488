"""Verdicts for alerts and assessments for attackers.

Both accept a caller-supplied batch function ``pandas.DataFrame -> verdicts``
that runs inside the tasks, or fall back on rules written as columns.

A batch function returns one mapping per row (a list of dicts), or a pandas
frame with one row per input row. A key that is missing takes its default, a
key that is present with null stays null. If a call fails, the batch is halved
until the rows that cannot be scored are found; only those get the fallback. A
function that raises :class:`ScorerUnavailable` gives the whole batch the
fallback in that one call. Rows with a fallback are added to an accumulator, if
one is given.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palisade import fixed_values as fixed
from palisade.functions import assessment, labels
from palisade.schemas import ASSESSMENT, VERDICT

class ScorerUnavailable(Exception):
    """Raised by a batch function whose service is down: no row is to blame."""


BatchFunction = Callable[[pd.DataFrame], "pd.DataFrame | Iterable[Mapping[str, Any]]"]
PartsAssessor = Callable[[str, Iterator[str]], Mapping[str, Any]]


def _apply_batches(
    df: DataFrame,
    function: BatchFunction,
    fields: list[tuple[str, T.StructField]],
    defaults: Mapping[str, Any],
    fallback: Mapping[str, Any],
    batch_rows: int,
    fallbacks: Accumulator | None = None,
) -> DataFrame:
    """Run ``function`` over Arrow batches; ``fields`` maps answer key to column.

    The helpers are local so that they travel with the task; nothing has to be
    installed on the executors.
    """

    down = ScorerUnavailable.__name__

    def answers_for(batch: pd.DataFrame) -> list[Mapping[str, Any]]:
        if batch.empty:
            return []
        try:
            result = function(batch)
            if isinstance(result, pd.DataFrame):
                result = result.astype(object).where(result.notna(), None).to_dict("records")
            result = [dict(answer) for answer in result]
            if len(result) != len(batch):
                raise ValueError("one answer per row expected")
            return result
        except Exception as error:
            # by name: the class may have travelled with the function
            if len(batch) == 1 or type(error).__name__ == down:
                if fallbacks is not None:
                    fallbacks.add(len(batch))
                return [fallback] * len(batch)
            middle = len(batch) // 2
            return answers_for(batch.iloc[:middle]) + answers_for(batch.iloc[middle:])

    converters = {T.LongType(): lambda v: int(float(v)), T.StringType(): str}

    def convert(value: Any, field: T.StructField) -> Any:
        if value is None or value != value:
            return None
        try:
            return converters[field.dataType](value)
        except (TypeError, ValueError):
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), batch_rows):
                part = whole.iloc[start:start + batch_rows].reset_index(drop=True)
                answers = answers_for(part)
                added = {
                    field.name: pd.Series(
                        [convert(a.get(key, defaults.get(key)), field) for a in answers],
                        dtype="Int64" if field.dataType == T.LongType() else object,
                    )
                    for key, field in fields
                }
                yield part.assign(**added)

    kept = [f for f in df.schema.fields if f.name not in {x.name for _, x in fields}]
    schema = T.StructType([*kept, *(field for _, field in fields)])
    return df.select(*(f.name for f in kept)).mapInPandas(run, schema)


# --- alerts ------------------------------------------------------------------

# Stored column of each verdict key.
_VERDICT_KEYS = list(zip(fixed.VERDICT_DEFAULTS, VERDICT.fields))


def rule_verdict(alerts: DataFrame) -> DataFrame:
    """Deterministic verdict columns from signature and priority alone.

    Likely noise and unrecognised signatures are normal, everything else is a
    hack; risk falls with the priority number and is lower for likely noise.
    """
    signature, priority = F.col("signature"), F.col("priority")
    attack, noise = F.col("_attack"), F.col("_noise")
    likely_noise = noise >= fixed.FALSE_POSITIVE_FROM
    by_priority = F.when(priority == 1, 9).when(priority == 2, 7).otherwise(4)
    # the patterns are matched in a step of their own: once for each alert,
    # however many columns need what they found
    matched = alerts.withColumns({
        "_attack": labels.attack_type(signature),
        "_noise": labels.fp_likelihood(signature, priority, None),
    })
    return (
        matched.withColumn(
            "llm_classification",
            F.when(likely_noise | (attack == fixed.OTHER_ATTACK), F.lit("normal"))
            .otherwise(F.lit("hack")),
        )
        .withColumn("attack_type", attack)
        .withColumn(
            "explanation",
            F.concat_ws(
                " ", signature, F.lit("from"), F.col("src_ip"), F.lit("to"),
                F.concat_ws(":", "dst_ip", F.col("dst_port").cast("string")),
            ),
        )
        .withColumn(
            "risk_score",
            (by_priority - F.when(likely_noise, 3).otherwise(0)).cast("bigint"),
        )
        .withColumn("false_positive_likelihood", noise)
        .drop("_attack", "_noise")
    )


def score_alerts(
    alerts: DataFrame, scorer: BatchFunction | None = None, *, batch_rows: int = 1024,
    fallbacks: Accumulator | None = None,
) -> DataFrame:
    """Alerts with the five verdict columns."""
    if scorer is None:
        return rule_verdict(alerts)
    return _apply_batches(
        alerts, scorer, _VERDICT_KEYS,
        fixed.VERDICT_DEFAULTS, fixed.VERDICT_FALLBACK, batch_rows, fallbacks,
    )


# --- attackers ---------------------------------------------------------------

_ASSESSMENT_KEYS = [(field.name, field) for field in ASSESSMENT.fields]


def _default_response(src_ip: Column) -> Column:
    return F.concat(F.lit("Block "), src_ip)


def assess_profiles(
    profiles: DataFrame, assessor: BatchFunction | None = None, *, batch_rows: int = 64
) -> DataFrame:
    """Profiles with methodology, objective, skill level and response.

    Without an assessor, objective and skill come from the kill-chain steps of
    ``attack_types``. Keys an assessor leaves out default to ``unknown`` and to
    blocking the address.
    """
    if assessor is None:
        steps = assessment.profile_steps(F.col("attack_types"))
        return (
            profiles.withColumn("methodology", F.lit("unknown"))
            .withColumn("objective", assessment.rule_objective(steps))
            .withColumn("skill_level", assessment.rule_skill(steps))
            .withColumn("recommended_response", _default_response(F.col("src_ip")))
        )

    def with_defaults(batch: pd.DataFrame) -> list[Mapping[str, Any]]:
        answers = assessor(batch)
        if isinstance(answers, pd.DataFrame):
            answers = answers.astype(object).where(answers.notna(), None).to_dict("records")
        return [
            {"recommended_response": f"Block {source}", **answer}
            for source, answer in zip(batch["src_ip"], answers, strict=True)
        ]

    unknown = {"methodology": "unknown", "objective": "unknown", "skill_level": "unknown"}
    scored = _apply_batches(
        profiles, with_defaults, _ASSESSMENT_KEYS,
        {**unknown, "recommended_response": None},
        {**unknown, "recommended_response": _FAILED}, batch_rows,
    )
    return scored.withColumn(
        "recommended_response",
        F.when(
            F.col("recommended_response") == _FAILED, _default_response(F.col("src_ip"))
        ).otherwise(F.col("recommended_response")),
    )


_FAILED = "\u0000failed"


def assess_sequences(parts: DataFrame, assessor: PartsAssessor) -> DataFrame:
    """``src_ip`` and its assessment, from attack sequences too long for one row.

    ``parts`` is what :func:`~palisade.operators.profile.sequence_text` gives.
    The assessor gets a source and an iterator over the texts of its parts, in
    order; only the batch at hand is in memory, however long the sequence.
    Keys it leaves out, and sources it fails on, get the same as in
    :func:`assess_profiles`.
    """
    unknown = {name: "unknown" for name in ASSESSMENT.fieldNames()[:-1]}
    schema = T.StructType([parts.schema["src_ip"], *ASSESSMENT.fields])
    arrow_schema, answers_per_batch = to_arrow_schema(schema), 1024

    def answered(source: Any, rows: Iterator[tuple]) -> dict[str, Any]:
        def texts() -> Iterator[str]:
            for expected, (_, part, text) in enumerate(rows):
                if part != expected:
                    raise AssertionError(f"part {part} of {source} came for {expected}")
                yield text

        rest = texts()
        defaults = {**unknown, "recommended_response": f"Block {source}"}
        try:
            answer = {**defaults, **assessor(source, rest)}
        except AssertionError:
            raise
        except Exception:
            answer = defaults
        for _ in rest:  # what the assessor did not want to see
            pass
        return {
            "src_ip": source,
            **{k: None if answer[k] is None else str(answer[k]) for k in defaults},
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (
            row for batch in batches
            for row in zip(*(column.to_pylist() for column in batch.columns))
        )
        answers = []
        for source, own in groupby(rows, key=itemgetter(0)):
            answers.append(answered(source, own))
            if len(answers) == answers_per_batch:
                yield pa.RecordBatch.from_pylist(answers, schema=arrow_schema)
                answers = []
        yield pa.RecordBatch.from_pylist(answers, schema=arrow_schema)

    # The rows of a source lie together and in order, so a task reads them from
    # one stream, source after source: a call of Python for each source would
    # cost more than its rows. A fixed count, because bytes do not tell what an
    # assessor costs: partitions sized by them leave most cores without work.
    partitions = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = parts.select("src_ip", "part", "attack_sequence").repartition(partitions, "src_ip")
    return placed.sortWithinPartitions("src_ip", "part").mapInArrow(run, schema)


# --- assessments shown with an attacker ------------------------------------------

_CARD_KEYS = [
    ("methodology", T.StructField("methodology", T.StringType())),
    ("objective", T.StructField("objective", T.StringType())),
    ("skill_level", T.StructField("skill_level", T.StringType())),
    ("response", T.StructField("response", T.StringType())),
    ("threat_level", T.StructField("assessed_threat_level", T.StringType())),
]


def assess_cards(
    profiles: DataFrame, assessor: BatchFunction | None = None, *, batch_rows: int = 64
) -> DataFrame:
    """Profiles with methodology, objective, skill level, response and threat level.

    A key the assessor leaves out shows a dash; skill is upper-cased. Where it
    fails, and without one, rules decide and methodology is null. ``assessed``
    tells which rows an assessor answered for.
    """
    steps = F.col("kill_chain")
    rules = {
        "objective": assessment.rule_objective(steps),
        "skill_level": assessment.rule_skill(steps),
        "response": assessment.rule_response(F.col("src_ip")),
    }
    if assessor is None:
        return profiles.withColumns({
            "methodology": F.lit(None).cast("string"), **rules,
            "assessed_threat_level": F.lit(None).cast("string"), "assessed": F.lit(False),
        })
    answered = _apply_batches(
        profiles, assessor, _CARD_KEYS,
        {**{key: fixed.NO_ANSWER for key, _ in _CARD_KEYS}, "threat_level": None},
        {key: _FAILED for key, _ in _CARD_KEYS}, batch_rows,
    ).withColumn("assessed", ~F.col("methodology").eqNullSafe(_FAILED))

    def shown(name: str, given: Column, rule: Column | None = None) -> Column:
        other = F.lit(None).cast("string") if rule is None else rule
        return F.when(F.col("assessed"), given).otherwise(other).alias(name)

    names = [field.name for _, field in _CARD_KEYS]
    kept = [c for c in answered.columns if c not in names]
    return answered.select(
        *kept, shown("methodology", F.col("methodology")),
        shown("objective", F.col("objective"), rules["objective"]),
        shown("skill_level", F.upper("skill_level"), rules["skill_level"]),
        shown("response", F.col("response"), rules["response"]),
        shown("assessed_threat_level", F.col("assessed_threat_level")),
    )
