"""Left joins of big, possibly skewed rows with a one-row-per-key side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPREAD = "_key_hash"


def join_lookup(left: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """Left join; ``lookup`` has at most one row per key, built by grouping.

    A small lookup is broadcast by the optimizer after its size is known. For
    a big one, rows of one hot key would all meet in one task. Adaptive
    execution splits such a partition, but only if a shuffle feeds the join
    directly, and the grouped side would reuse the shuffle of its grouping.
    Joining on a hash of the keys as well makes both sides shuffle for the
    join itself, so the split applies. The extra shuffle moves the grouped
    rows only, and the hash never changes which rows match.
    """
    spread = F.xxhash64(*keys)
    joined = left.withColumn(_SPREAD, spread).join(
        lookup.withColumn(_SPREAD, spread), [*keys, _SPREAD], "left"
    )
    return joined.drop(_SPREAD)
