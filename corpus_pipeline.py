"""From raw documents to packed training sequences, one operator a stage.

Each stage is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralane.llm import classifier, dedup, mixing, packing, quality
from terralane.storage import remove, settle


#: Rows in an Arrow batch: with documents of some kilobytes a batch then holds some megabytes, in the JVM and in Python.
ARROW_ROWS = 2000
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ARROW_ROWS, unless it was given a size of its own: 10,000 is the engine's default."""
    if int(spark.conf.get(_ROWS_SETTING, "10000")) == 10_000:
        spark.conf.set(_ROWS_SETTING, str(ARROW_ROWS))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules adapted to their language and source.

    Short ones may stay, but for those without a word: null and empty texts go.  Null languages and sources are groups of
    their own; repeated rows share a verdict; long texts are measured whole; an empty table gives no rows.
    """
    return quality.passing(docs, least_words=1)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance sample keeps.

    Ties with the last one kept stay, so repeated rows share a verdict; without labels all stay; null ids share one noise
    value; null and empty texts have ratio 1; long texts are scored whole; an empty table gives no rows.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classifier.sampled(docs, labels)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: 5-word shingles, similarity 0.8 or more.

    Of repeated rows the first in storage stays; documents without words or without an id that no other has a copy of stay;
    long texts are shingled whole; an empty table gives no rows.
    """
    small_batches(spark)
    return dedup.representatives(docs, k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, 0 to 3 times.

    A null source is one of its own; rows of one source and id go together; null ids hash like an empty one; a text without
    words goes with its hash; an empty table gives no rows.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of 2048 tokens.

    A null or empty text is its end id alone; repeated rows and null ids are packed like others; a long text is encoded whole
    and cut into pieces; an empty table gives no rows.
    """
    small_batches(spark)
    return packing.pack(docs, max_len=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier's hashed models, SetSketch candidates and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
