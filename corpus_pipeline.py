"""From raw documents to a training mix, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm import decontaminate, lines, mixing, simhash
from palisade.llm import toxicity as toxic
from palisade.llm.rows import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars``, where it exists, follows the text."""
    if "n_chars" not in docs.columns:
        return docs
    size = F.coalesce(F.length("text").cast("long"), F.col("n_chars"))
    return docs.withColumn("n_chars", size)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    scored = toxic.toxicity(docs, _table(spark, sf_dir, "labels"))
    return scored.filter("predicted = 0").select(*docs.columns)


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of several lines that stood before."""
    return _recounted(lines.dedup_lines(docs).select(*docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose SimHash fingerprints differ in at most 3 bits."""
    return simhash.one_of_each(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that benchmark phrases cover."""
    return _recounted(decontaminate.remove_passages(docs, _table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources weigh 5, 2, 1, repeating."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", cut_benchmark),
    ("source_mixing", mix_sources),
]

# The first stage's classifier is out of SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
