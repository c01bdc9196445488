"""Labelling, duplicate removal and the final shape of the dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions import labels
from palisade.schemas import DATASET

DUPLICATE_KEY = ["timestamp", "signature", "src_ip", "dst_ip", "dst_port"]


def label_alerts(alerts: DataFrame, *, with_flows: bool) -> DataFrame:
    """Add attack type, kill-chain stage, noise likelihood and ground truth.

    ``with_flows`` tells whether flow data was supplied at all; it decides the
    no-traffic points (see :func:`palisade.functions.labels.fp_likelihood`).
    """
    flow_bytes = F.col("flow_bytes") if with_flows else None
    signature = F.col("signature")
    scored = alerts.withColumns({
        "attack_type": labels.attack_type(signature),
        "fp_likelihood": labels.fp_likelihood(signature, F.col("priority"), flow_bytes),
    })
    return scored.withColumns({
        "kill_chain_stage": labels.kill_chain_stage(F.col("attack_type")),
        "ground_truth": labels.ground_truth(F.col("fp_likelihood")),
    })


def drop_repeats(alerts: DataFrame) -> DataFrame:
    """Of alerts that agree on the duplicate key, the first in source order.

    A rank filter of this form is also applied inside each map task before
    the shuffle, so however many copies a key has, one per task is moved.
    """
    copies = Window.partitionBy(*DUPLICATE_KEY).orderBy("source_order")
    return (
        alerts.withColumn("_copy", F.row_number().over(copies))
        .filter(F.col("_copy") == 1)
        .drop("_copy")
    )


def complete_columns(alerts: DataFrame) -> DataFrame:
    """Exactly the dataset columns, in order; absent ones become null."""
    present = set(alerts.columns)
    return alerts.select(*(
        (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in DATASET.fields
    ))


def in_time_order(alerts: DataFrame) -> DataFrame:
    """Alerts sorted by timestamp text, ties in source order.

    The source order is part of the sort key, so the range partitions stay
    even when very many alerts share one timestamp.
    """
    return alerts.orderBy("timestamp", "source_order")
