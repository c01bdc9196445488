"""Toxicity: a linear classifier on character n-grams scaled by log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.rows import by_bytes
from palisade.llm.winnowing import gram_hashes

GRAMS = (3, 4, 5)  # code points
BUCKET_BITS = 20  # n-grams are hashed into so many bits
MAX_LABELLED = 20_000  # labelled rows the classifier is fitted on, those of least hash
PRIOR = 1.0  # documents' worth of the pooled frequency in each class's frequency
LEAST_RATIO = 0.7  # n-grams whose log ratio is nearer to 0 are left out
LEAST_COUNT = 4  # as are n-grams in fewer labelled documents
LEAST_Z = 5.0  # and those whose toxic share lies fewer deviations from the overall share
PENALTY = 0.02
STEPS = 800
THRESHOLD = 0.7
_FIT_PARTS = 8
_MOVED = 4_000_000


def buckets(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of the lower-cased text, with repeats."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint64(64 - BUCKET_BITS)
    found = [
        ((gram_hashes(codes, n) + np.uint64(n)) >> shift).astype(np.int64)
        for n in GRAMS if len(codes) >= n
    ]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    """Weight of each bucket (ratio times coefficient) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str | None) -> float:
        """Probability of label 1; each n-gram counts once."""
        found = buckets(text)
        used = np.unique(found[self.weights[found] != 0])
        z = self.intercept + float(self.weights[used].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def held_out(doc_id: Column) -> Column:
    """Whether labels of the row may not be learnt from; a null id is not held out."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % 3
    return F.coalesce(rest == 1, F.lit(False))


def _training_rows(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """``text``, ``toxic`` of at most ``limit`` labelled rows that are not held out.

    A document with several labels is toxic if one says so; of several rows
    with one id, the text of least hash is used.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    per_doc = usable.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        F.max(F.col("toxic").cast("int")).alias("toxic")
    )
    picked = per_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    chosen = picked.withColumnRenamed("doc_id", "_llm_doc")
    # at most ``limit`` rows of two numbers
    found = docs.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_llm_doc")
    )
    return found.groupBy("_llm_doc").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"),
        F.max("toxic").alias("toxic"),
    ).select("text", "toxic")


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in by_bytes(batches, "text", _MOVED):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[toxic, np.unique(buckets(text))] += 1
    used = np.flatnonzero(counts.sum(axis=0))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])],
        ["bucket", "clean", "toxic"],
    )


def log_ratios(counts: DataFrame, n_clean: int, n_toxic: int) -> DataFrame:
    """``bucket``, ``ratio``: log of the classes' document frequencies' ratio.

    Both frequencies are drawn towards the pooled one, so that rare n-grams
    say little; those that chance explains are left out.
    """
    pooled = (F.col("clean") + F.col("toxic")) / F.lit(float(n_clean + n_toxic))
    in_toxic = (F.col("toxic") + PRIOR * pooled) / F.lit(n_toxic + PRIOR)
    in_clean = (F.col("clean") + PRIOR * pooled) / F.lit(n_clean + PRIOR)
    n = F.col("clean") + F.col("toxic")
    share = n_toxic / (n_clean + n_toxic)
    z = (F.col("toxic") - n * share) / F.sqrt(n * (share * (1 - share)))
    return counts.filter((n >= LEAST_COUNT) & (F.abs(z) >= LEAST_Z)).select(
        "bucket", F.log(in_toxic / in_clean).alias("ratio")
    ).filter(F.abs("ratio") >= LEAST_RATIO)


def _descend(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on the scaled features: full gradients with momentum.

    Steps are so small that no direction overshoots; a penalty on the
    coefficients keeps rare features from growing without end.
    """
    lengths = np.array([len(r) for r in rows])
    place = np.repeat(np.arange(len(rows)), lengths)
    feature = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    scale = ratio[feature]
    coefficient, intercept = np.zeros(len(ratio)), 0.0
    speed, speed_0 = np.zeros(len(ratio)), 0.0
    squares = np.bincount(place, scale**2, len(rows))
    step = 1.0 / (0.25 * (float(np.percentile(squares, 99)) + 1.0) + PENALTY)
    for _ in range(STEPS):
        z = intercept + np.bincount(place, scale * coefficient[feature], len(rows))
        error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels
        slope = np.bincount(feature, scale * error[place], len(ratio)) / len(rows)
        speed = 0.9 * speed - step * (slope + PENALTY / len(rows) * coefficient)
        speed_0 = 0.9 * speed_0 - step * float(error.mean())
        coefficient += speed
        intercept += speed_0
    return coefficient * ratio, intercept


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Model:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Rows whose crc32(doc_id) mod 3 is 1 are never learnt from. At most
    ``limit`` labelled rows are used. Without labels of both classes the score
    of every text is the share of toxic labels, 0 if there are none.
    """
    rows = _training_rows(docs, labels, limit).repartition(_FIT_PARTS)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    weights = np.zeros(1 << BUCKET_BITS)
    if not n_clean or not n_toxic:
        return Model(weights, 500.0 if n_toxic else -500.0)
    counts = rows.mapInArrow(_count_grams, "bucket bigint, clean bigint, toxic bigint").groupBy(
        "bucket"
    ).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # at most one row for each bucket
    told = log_ratios(counts, n_clean, n_toxic).orderBy("bucket").toPandas()
    number = np.full(1 << BUCKET_BITS, -1, np.int64)
    number[told["bucket"]] = np.arange(len(told))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", _MOVED):
            found = [number[np.unique(buckets(t))] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([f[f >= 0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                batch.column(1),
            ], ["used", "toxic"])

    sample = rows.mapInArrow(features, "used array<int>, toxic int").toPandas()
    learnt, intercept = _descend(
        [np.asarray(u, np.int64) for u in sample["used"]],
        sample["toxic"].to_numpy(np.float64), told["ratio"].to_numpy(),
    )
    weights[told["bucket"]] = learnt
    return Model(weights, intercept)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` (0 to 1) and ``predicted`` (0 or 1).

    Only the text is read: null and empty texts get the intercept's score,
    equal texts equal scores. Columns of these names are replaced.
    """
    own = ("held_out", "score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per bucket

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        known = shared.value
        return pd.Series([known.score(text) for text in texts], dtype=float)

    scored = docs.drop(*own).withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "score", scores("text")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows of ``docs`` and score all of them."""
    return score(docs, fit(docs, labels))
