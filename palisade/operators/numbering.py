"""Exact running positions without sending a group through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.session import fresh_path

_ROW_BITS = 33  # monotonically_increasing_id: partition above, row below


def with_position(
    df: DataFrame, order: list[str], *, within: list[str] | None = None,
    name: str = "position", total: str | None = None, at: str | None = None,
) -> DataFrame:
    """Number rows 1, 2, ... in ``order``, separately for each ``within`` value.

    With ``total`` the rows of the group are counted into a column of that name.

    ``order`` must end in a unique column. A window per group would sort a hot
    group in one task. Here a range partitioning on group and order cuts any
    group wherever needed; each row takes its offset inside its partition, and
    the only thing summed in sequence is one count per group and partition.

    The sorted rows are written while this function runs: positions are
    derived from where rows lie, and that must stay the same if an executor is
    lost. They go to ``at``, which is overwritten and is the caller's to
    remove, or else to a folder of their own below the shared folder.
    """
    group = list(within or [])
    spark = df.sparkSession
    path = at or fresh_path(spark, "numbered")
    numbered = (
        df.repartitionByRange(*group, *order)
        .sortWithinPartitions(*group, *order)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    numbered.write.mode("overwrite").parquet(path)
    placed = spark.read.schema(numbered.schema).parquet(path).withColumn(
        "_part", F.shiftright("_row", _ROW_BITS)
    )
    pieces = placed.groupBy(*group, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first")
    )
    # one row per group and partition; without groups, one per partition
    same_group = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = same_group.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = pieces.withColumn(
        "_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    ).withColumn("_total", F.sum("_rows").over(same_group)).drop("_rows")
    # null-safe, so rows without a group value are numbered like any group
    on = F.col("p._part") == F.col("o._part")
    for column in group:
        on = on & F.col(f"p.{column}").eqNullSafe(F.col(f"o.{column}"))
    if not group:
        # a row for each partition: moving the rows to these few keys instead
        # would leave the work on them to as many tasks
        offsets = F.broadcast(offsets)
    joined = placed.alias("p").join(offsets.alias("o"), on)
    kept = [F.col(f"p.{c}") for c in df.columns]
    position = F.col("_row") - F.col("_first") + F.col("_before") + 1
    totals = [F.col("_total").alias(total)] if total else []
    return joined.select(*kept, position.alias(name), *totals)
