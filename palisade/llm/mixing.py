"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.rows import small_or_not

WORD = r"[^\x20\x09-\x0D]+"
HASH_DIGITS = 13  # hexadecimal digits of the hash that make the draw: 52 bits


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float], most: float = 3.0
) -> DataFrame:
    """``source``, ``source_size``, ``target`` from rows (``source``, ``size``).

    Sources in code-point order, null last, take ``weights`` in turn and share
    the sum of all sizes by weight. A target stops at ``most`` times its
    source's size; the excess goes to the others by weight until none is above.

    That is the level L with sum(min(most * size, L * weight)) = total: taking
    sources by rising most * size / weight, one is full if it lies below the
    level that those from it on would share. One row per source remains after
    the aggregation, so the windows without a key see only those.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    turn = (
        F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    ) % len(weights)
    weighted = per_source.withColumn(
        "_weight", F.array(*(F.lit(float(w)) for w in weights))[turn]
    ).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    by_need = everything.orderBy(
        F.col("_cap") / F.col("_weight"), F.col("source").asc_nulls_last()
    )
    before = by_need.rowsBetween(Window.unboundedPreceding, -1)
    from_here = by_need.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(
        F.sum("_cap").over(before), F.lit(0.0)
    )
    level = weighted.withColumn("_level", rest / F.sum("_weight").over(from_here))
    open_ = F.col("_cap") >= F.col("_level") * F.col("_weight")
    shared = F.max(F.when(open_, F.col("_level"))).over(everything)
    return level.withColumn("_shared", shared).select(
        "source", "source_size",
        F.when(open_, F.col("_shared") * F.col("_weight")).otherwise(F.col("_cap")).alias("target"),
    )


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the id alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    digits = F.substring(F.md5(text), 1, HASH_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def with_copies(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 42
) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``copies``.

    A source's rate is target / size. Each document gets floor(rate) copies
    and one more if its hash draw falls below the fraction, so reruns agree
    and rows with equal ids get equally many. Sizes are words; a null text has
    none, and a source without words has target 0. Null sources are one
    source. Input columns named like the four are replaced.
    """
    own = ("size", "source_size", "target", "copies")
    sized = docs.drop(*own).withColumn("size", word_count(F.col("text")))
    targets = small_or_not(source_targets(sized.select("source", "size"), weights, most))
    named = targets.withColumnRenamed("source", "_llm_source")
    joined = sized.join(named, F.col("source").eqNullSafe(F.col("_llm_source"))).drop("_llm_source")
    rate = F.when(
        F.col("source_size") > 0,
        F.least(F.lit(float(most)), F.col("target") / F.col("source_size")),
    ).otherwise(F.lit(0.0))
    extra = draw(F.col("doc_id"), seed) < rate - F.floor(rate)
    return joined.withColumn(
        "copies", F.floor(rate).cast("long") + F.when(extra, 1).otherwise(0).cast("long")
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, seed: int = 42
) -> DataFrame:
    """The mixed corpus: each row of :func:`with_copies` as often as it says."""
    counted = with_copies(docs, weights, most, seed)
    numbers = F.sequence(F.lit(1).cast("long"), F.col("copies"))
    repeated = counted.filter("copies > 0").withColumn("_llm_copy", F.explode(numbers))
    return repeated.select(*docs.columns)
