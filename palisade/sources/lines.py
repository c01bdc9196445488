"""Text lines, static or streaming, with their source order."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.schemas import SOURCE_ORDER

MAX_FILES_PER_TRIGGER = 1000
# Spark's own default of seven days would drop files that keep an old date.
MAX_FILE_AGE = "36500d"


def read_lines(spark: SparkSession, path: str, *, rank: int = 0) -> DataFrame:
    """``value`` and ``source_order`` for every line below ``path``.

    The order is taken on the scan itself, before anything can move rows:
    splits keep their lines in sequence, so the running id orders lines
    inside one block and the block offset orders blocks inside one file.
    """
    lines = spark.read.text(path)
    return lines.select(
        "value",
        F.struct(
            F.lit(rank).alias("rank"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
        ).cast(SOURCE_ORDER).alias("source_order"),
    )


def read_lines_if_present(
    spark: SparkSession, path: str, *, rank: int = 0
) -> DataFrame | None:
    """Like :func:`read_lines`, or ``None`` when the path does not exist."""
    try:
        return read_lines(spark, path, rank=rank)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def newest_lines(lines: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` lines in source order."""
    return lines.orderBy(F.desc("source_order")).limit(limit)


def stream_lines(
    spark: SparkSession,
    path: str,
    *,
    max_files_per_trigger: int | None = MAX_FILES_PER_TRIGGER,
    max_file_age: str = MAX_FILE_AGE,
    archive: str | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Lines of the files landing in a folder. Each file is read once.

    A batch takes ``max_files_per_trigger`` files (``None``: all there are),
    so that a backlog is worked off in batches of bounded size. Files whose
    date lies further than ``max_file_age`` before that of the newest one are
    left out; the default is meant to leave out none. With ``archive``, files
    that were worked off move to that folder, which keeps the list of files
    to remember, and to list, short.

    With ``ordered``, ``source_order`` tells files by the time they were last
    changed, then by name. A stream cannot number lines, so :func:`number_lines`
    does that on each micro-batch.
    """
    reader = spark.readStream.option("maxFileAge", max_file_age)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    lines = reader.text(path)
    if not ordered:
        return lines
    landed = F.unix_millis("_metadata.file_modification_time").cast("string")
    return lines.select(
        "value",
        F.struct(
            F.lit(0).alias("rank"),
            F.concat_ws(" ", F.lpad(landed, 15, "0"), "_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.lit(None).cast("bigint").alias("line"),
        ).cast(SOURCE_ORDER).alias("source_order"),
    )


def number_lines(batch: DataFrame) -> DataFrame:
    """A micro-batch whose ``source_order`` also orders the lines inside a block.

    To be applied before anything moves the rows, like the running id of
    :func:`read_lines`. Line numbers that are there already stay.
    """
    line = F.coalesce("source_order.line", F.monotonically_increasing_id())
    return batch.withColumn("source_order", F.col("source_order").withField("line", line))


def mark_wanted(df: DataFrame, parsed: Column, wanted, name: str) -> DataFrame:
    """Add ``parsed`` as column ``name``, null in rows for which ``wanted`` does not hold.

    ``wanted`` takes and returns a Column. A plain filter over a computed
    column is pushed below the projection that computes it, and the expensive
    expression (a regular expression, a JSON parse) then runs twice per line.
    The outer explode of a zero-or-one element array computes it once, and
    works on streams too.
    """
    hit = F.filter(F.array(parsed), wanted)
    return df.select("*", F.explode_outer(hit).alias(name))


def keep_wanted(df: DataFrame, parsed: Column, wanted, name: str) -> DataFrame:
    """Like :func:`mark_wanted`, without the rows that are not wanted."""
    return mark_wanted(df, parsed, wanted, name).filter(F.col(name).isNotNull())
