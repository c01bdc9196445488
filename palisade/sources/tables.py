"""Stored tables: read, write, append once, extend, clear."""

from __future__ import annotations

from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CSV_ROWS = 500_000

# How the labelled dataset lies: columns of few values first, so that the rows
# of any one value, whichever column it is of, stand in few stretches. The rest
# tells rows apart, so that no range of the sort can get hot.
DATASET_ORDER = (
    "interface", "ground_truth", "attack_type", "fp_likelihood", "src_ip",
    "timestamp", "signature", "dst_ip", "dst_port",
)


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at ``path``, or an empty one if nothing is there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_csv(df: DataFrame, path: str) -> None:
    """Replace ``path`` with CSV files, header included, row order kept.

    Quotes inside a value are doubled, as CSV readers outside Spark expect.
    Values may hold line breaks, so a reader cannot split a file: each holds
    at most ``CSV_ROWS`` rows.
    """
    df.write.mode("overwrite").options(
        header=True, escape='"', maxRecordsPerFile=CSV_ROWS
    ).csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).options(
        header=True, escape='"', enforceSchema=False, multiLine=True
    ).csv(path)


def write_dataset(df: DataFrame, path: str, *, row_group_bytes: int | None = None) -> None:
    """Replace the labelled dataset, clustered by :data:`DATASET_ORDER`.

    Readers skip where a database would use indexes: by folder for
    ``interface``, by file and row-group range for ``ground_truth``,
    ``attack_type``, ``fp_likelihood`` and ``src_ip``, and by Bloom filter for a
    source that lies between others. The order of ``df`` is given up for that.
    """
    writer = (
        df.repartitionByRange(*DATASET_ORDER).sortWithinPartitions(*DATASET_ORDER)
        .write.mode("overwrite").partitionBy("interface").options(**{
            "parquet.bloom.filter.enabled#src_ip": "true",
            "parquet.bloom.filter.adaptive.enabled": "true",
        })
    )
    if row_group_bytes is not None:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append the rows of one batch; writing the same batch again replaces it.

    The batch's own folder is overwritten, so a repeat run without rows also
    clears what the first run left.
    """
    df.write.mode("overwrite").parquet(batch_path(path, batch_id))


def batch_path(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def read_batch(
    spark: SparkSession, path: str, schema: T.StructType, batch_id: int
) -> DataFrame:
    """The rows of one batch; only its own folder is listed."""
    return read_table(spark, batch_path(path, batch_id), schema)


def with_batch_id(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def add_column(df: DataFrame, field: T.StructField, default: Any) -> DataFrame:
    """``df`` with one more column; a frame that has it already gets gaps filled."""
    value = F.lit(default).cast(field.dataType)
    if field.name in df.columns:
        value = F.coalesce(F.col(field.name), value)
    return df.withColumn(field.name, value)


def union_with_defaults(
    frames: list[DataFrame], defaults: dict[str, Any]
) -> DataFrame:
    """Union by name of tables written before and after a column was added."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first.fillna(defaults)


def clear_table(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """Empty the table at ``path`` and return how many rows are left."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return read_table(spark, path, schema).count()
