"""Alert-log lines to columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.fixed_values import (
    ALERT_TIMESTAMP_FORMAT,
    ARCHIVE_LINE_GROUPS,
    ARCHIVE_LINE_PATTERN,
    LIVE_LINE_GROUPS,
    LIVE_LINE_PATTERN,
)
from palisade.sources.lines import keep_wanted, mark_wanted

_SEPARATOR = "\u0001"
_NUMBERS = {"priority", "src_port", "dst_port"}

# (pattern, group names, what may stand before the pattern)
_GRAMMARS = {
    "archive": (ARCHIVE_LINE_PATTERN, ARCHIVE_LINE_GROUPS, r"(?s)^.*?"),
    "live": (LIVE_LINE_PATTERN, LIVE_LINE_GROUPS, r"(?s)^\s*"),
}


def _captures(line: Column, grammar: str) -> Column:
    """Array of all captured groups; any other length means no match.

    One replacement rewrites the whole line to its groups, so the expression
    runs once however many groups there are. The rare line that itself holds
    the separator takes the group-by-group path.
    """
    pattern, groups, lead = _GRAMMARS[grammar]
    whole = f"{lead}{pattern}.*$"
    numbers = range(1, len(groups) + 1)
    rewritten = F.regexp_replace(
        line, F.lit(whole), F.lit(_SEPARATOR.join(f"${n}" for n in numbers))
    )
    one_by_one = F.when(
        line.rlike(whole),
        F.array(*(F.regexp_extract(line, whole, n) for n in numbers)),
    )
    return F.when(
        F.contains(line, F.lit(_SEPARATOR)), one_by_one
    ).otherwise(F.split(rewritten, _SEPARATOR))


def parse_alert_lines(
    lines: DataFrame, *, grammar: str = "archive", interface: str | None = None
) -> DataFrame:
    """Alert columns of every line that fits the grammar.

    ``lines`` is static or streaming and has a text column ``value``; its
    other columns are kept. Lines that do not fit are dropped (see
    :func:`count_lines`). ``grammar`` is ``"archive"`` (found anywhere in the
    line, yields the rule id) or ``"live"`` (from the start of the line).
    """
    matched = keep_wanted(lines, *_captured(grammar))
    carried = [c for c in lines.columns if c != "value"]
    return matched.select(*_alert_columns(grammar, interface), *carried)


def _captured(grammar: str) -> tuple:
    """What :func:`keep_wanted` and :func:`mark_wanted` need to add ``captured``."""
    size = len(_GRAMMARS[grammar][1])
    return _captures(F.col("value"), grammar), lambda found: F.size(found) == size, "captured"


def _alert_columns(grammar: str, interface: str | None) -> list[Column]:
    columns = []
    for position, name in enumerate(_GRAMMARS[grammar][1]):
        text = F.col("captured")[position]
        columns.append((text.try_cast("bigint") if name in _NUMBERS else text).alias(name))
    if interface is not None:
        columns.append(F.lit(interface).alias("interface"))
    return columns


@dataclass(frozen=True)
class ParsedLines:
    """What one scan of a log left: stored alerts, stored rejects, and counts."""

    alerts: DataFrame
    rejected: DataFrame
    lines: int
    parsed: int

    @property
    def rejects(self) -> int:
        return self.lines - self.parsed


def store_alert_lines(
    lines: DataFrame, path: str, *, grammar: str = "archive", interface: str | None = None
) -> ParsedLines:
    """Parse ``lines`` once and replace ``path`` with both the alerts and the rejected lines.

    ``alerts`` is what :func:`parse_alert_lines` gives, ``rejected`` what
    :func:`rejected_lines` gives; the counts are taken while the rows are
    written, so that no line is read or matched a second time.
    """
    carried = [c for c in lines.columns if c != "value"]
    parsed = _alert_columns(grammar, interface)
    rejected = F.col("captured").isNull()
    seen = Observation()
    rows = mark_wanted(lines, *_captured(grammar)).select(
        *parsed, *carried, F.when(rejected, F.col("value")).alias("_value"),
        rejected.alias("_rejected"),
    ).observe(
        seen, F.count(F.lit(1)).alias("lines"), F.count_if(~F.col("_rejected")).alias("parsed")
    )
    rows.write.mode("overwrite").partitionBy("_rejected").parquet(path)
    # the folder of the partition says which it is; either may be missing
    stored = lines.sparkSession.read.schema(
        T.StructType([f for f in rows.schema.fields if f.name != "_rejected"])
        .add("_rejected", "boolean")
    ).parquet(path)
    alerts = [c for c in rows.columns if c not in ("_value", "_rejected")]
    return ParsedLines(
        stored.filter(~F.col("_rejected")).select(*alerts),
        stored.filter("_rejected").select(
            *(F.col("_value").alias(c) if c == "value" else c for c in lines.columns)
        ),
        **seen.get,
    )


def _fits(grammar: str) -> Column:
    fits = F.size(_captures(F.col("value"), grammar)) == len(_GRAMMARS[grammar][1])
    return F.coalesce(fits, F.lit(False))


def count_lines(lines: DataFrame, *, grammar: str = "archive") -> DataFrame:
    """One row: lines read, lines parsed, lines rejected."""
    return count_lines_by(lines, [grammar]).drop("grammar")


def count_lines_by(lines: DataFrame, grammars: Iterable[str] = tuple(_GRAMMARS)) -> DataFrame:
    """Lines read, parsed and rejected: a row for each ``grammar``, all from one scan."""
    grammars = list(grammars)
    totals = lines.agg(
        F.count(F.lit(1)).alias("lines"), *(F.count_if(_fits(g)).alias(g) for g in grammars)
    )
    return totals.select(F.inline(F.array(*(
        F.struct(
            F.lit(g).alias("grammar"), F.col("lines"), F.col(g).alias("parsed"),
            (F.col("lines") - F.col(g)).alias("rejected"),
        )
        for g in grammars
    ))))


def rejected_lines(lines: DataFrame, *, grammar: str = "archive") -> DataFrame:
    """The lines :func:`parse_alert_lines` drops, unchanged."""
    return lines.filter(~_fits(grammar))


def event_time(timestamp: Column) -> Column:
    """The alert's text timestamp as a time-zone free timestamp, or null.

    Fraction digits after the sixth are cut off.
    """
    micros = F.regexp_replace(timestamp, r"(\.\d{6})\d+$", "$1")
    return F.try_to_timestamp(micros, F.lit(ALERT_TIMESTAMP_FORMAT)).cast(
        "timestamp_ntz"
    )
