"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

1. ``quality_classifier``: documents that the classifier rejects go.
2. ``ngram_jaccard_join``: of each class of near duplicates one document stays (the smallest doc_id).
3. ``suffix_array_dedup``: byte strings of 100 that occur earlier are removed from the texts.
4. ``benchmark_decontamination``: documents that contain a benchmark item go.
5. ``mixing_sources``: how often each remaining document is taken (``copies``), and its words.

The first four return the columns of their input.  Stages handle null values, empty texts, repeated
rows, empty tables and extra columns as their operators state.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from agewise.llm.decontaminate import without_contaminated
from agewise.llm.frames import original_id
from agewise.llm.jaccard_join import one_of_each_class
from agewise.llm.mixing import mix
from agewise.llm.quality_model import accepted
from agewise.llm.suffix_dedup import without_repeats
from agewise.session import checkpoint_dir


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each_class(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = mix(docs)
    return out.select(original_id().alias("doc_id"), "source", "size", "source_size", "target", "copies", "taken")


STAGES = [(f.__name__, f) for f in (quality_classifier, ngram_jaccard_join, suffix_array_dedup, benchmark_decontamination, mixing_sources)]

#: The stages hash, learn and draw; SQL can't express them (tests hold them against brute force).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
