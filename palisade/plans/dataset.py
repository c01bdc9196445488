"""Alert logs and flow logs to the labelled dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from palisade.operators import dataset as ops
from palisade.operators import enrich
from palisade.sources.alert_log import parse_alert_lines
from palisade.sources.eve import parse_flow_lines
from palisade.sources.lines import read_lines, read_lines_if_present
from palisade.sources.tables import write_csv, write_dataset


def build_dataset(
    alerts: DataFrame, flows: DataFrame | None = None, *, ordered: bool = True
) -> DataFrame:
    """Labelled, duplicate-free dataset in final column and row order.

    ``alerts`` and ``flows`` are parsed lines with ``source_order``. Without
    ``flows`` the flow columns are null and scoring knows none were supplied.

    Rows come in time order unless ``ordered`` is off, which saves a shuffle of
    the whole dataset where only counts are wanted.

    Repeats are dropped before the join: the join adds columns but never rows,
    so the result is the same and only alerts that stay are moved again. Labels
    are computed per row after the last shuffle, so they are not moved at all.
    """
    kept = ops.drop_repeats(alerts)
    if flows is not None:
        kept = enrich.join_flows(kept, enrich.flow_summary(flows))
    if ordered:
        kept = ops.in_time_order(kept)
    labelled = ops.label_alerts(kept, with_flows=flows is not None)
    return ops.complete_columns(labelled)


def read_alert_logs(
    spark: SparkSession, sources: Sequence[tuple[str, str]]
) -> DataFrame:
    """Alerts of all ``(path, interface)`` sources, first source first."""
    return enrich.union_sources(*(
        parse_alert_lines(read_lines(spark, path, rank=rank), interface=interface)
        for rank, (path, interface) in enumerate(sources)
    ))


def read_flow_logs(spark: SparkSession, paths: Sequence[str]) -> DataFrame | None:
    """Flow records of the paths that exist, or ``None`` if none does."""
    present = [
        parse_flow_lines(lines)
        for rank, path in enumerate(paths)
        if (lines := read_lines_if_present(spark, path, rank=rank)) is not None
    ]
    return enrich.union_sources(*present) if present else None


def run(
    spark: SparkSession,
    alert_sources: Sequence[tuple[str, str]],
    flow_paths: Sequence[str],
    table_path: str,
    csv_path: str | None = None,
) -> DataFrame:
    """Build the dataset, store it, and return the stored table."""
    built = build_dataset(
        read_alert_logs(spark, alert_sources), read_flow_logs(spark, flow_paths),
        ordered=False,  # the stored table has an order of its own
    )
    write_dataset(built, table_path)
    stored = spark.read.parquet(table_path).select(*built.columns)
    if csv_path is not None:
        # from the stored table, so the logs are not parsed and joined again;
        # the duplicate key is unique by now, so no sort range can get hot
        write_csv(stored.orderBy(*ops.DUPLICATE_KEY), csv_path)
    return stored
