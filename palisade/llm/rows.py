"""What the operators of this package share: row identity, sizes, small joins.

Conventions. A null text counts as the empty text. A row is identified by its
``doc_id`` and a hash of its text, so null or repeated ids and repeated rows
are handled: rows equal in both get equal results. Columns that an operator
adds replace input columns of the same name; other extra columns pass through
or are ignored, as each docstring says.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.session import fresh_path

KEY = "_llm_key"

# A lookup is broadcast only after its rows were counted and found below this.
SMALL_ROWS = 20_000


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def keyed(docs: DataFrame) -> DataFrame:
    """``_llm_key``, ``doc_id``, ``text`` (null: empty)."""
    return docs.select(
        row_key().alias(KEY), "doc_id", F.coalesce("text", F.lit("")).alias("text")
    )


def join_by_row(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on the row identity; ``right`` has one row for each."""
    renamed = right.withColumnRenamed("doc_id", "_llm_doc").withColumnRenamed(KEY, "_llm_k")
    joined = left.join(
        renamed,
        (F.col(KEY) == F.col("_llm_k")) & F.col("doc_id").eqNullSafe(F.col("_llm_doc")),
        how,
    )
    return joined.drop("_llm_doc", "_llm_k")


def join_grouped(
    left: DataFrame, grouped: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Join with a side that was grouped by the (non-null) ``keys``.

    Joining on a hash of the keys as well makes both sides shuffle for the join
    itself. Otherwise the grouping's own shuffle would serve, which adaptive
    execution cannot split where one key holds many rows of ``left``. One bit
    is enough for that, and takes no room in the shuffle.
    """
    spread = F.pmod(F.xxhash64(*keys), F.lit(2))
    joined = left.withColumn("_llm_spread", spread).join(
        grouped.withColumn("_llm_spread", spread), [*keys, "_llm_spread"], how
    )
    return joined.drop("_llm_spread")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage."""
    path = fresh_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame) -> DataFrame:
    """The frame, marked for broadcast if its counted rows are few."""
    kept = stored(df, "lookup")
    if kept.count() <= SMALL_ROWS:
        return F.broadcast(kept)
    return kept


def by_bytes(
    batches: Iterator[pa.RecordBatch], text: str, limit: int
) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of text, one row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        begin, total = 0, 0
        for i, size in enumerate(sizes):
            if i > begin and total + size > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size
        if begin < len(sizes):
            yield batch.slice(begin)
