"""The corpus pipeline: five stages over documents, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillwater.llm import decontaminate, mixing, quality, sharding, similarity_join
from stillwater.llm.common import columns, forget, free, marked, shared_dir, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, fitted on the labelled ones, doesn't reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts: that of the smallest id."""
    return similarity_join.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage similar to a benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: none to three times."""
    [times, time] = free(docs, "times", "time")
    mixed = mixing.mix(docs, keep=True, times=times).filter(F.col(times) > 0)
    return mixed.select(*columns(docs), F.explode(F.sequence(F.lit(1), F.col(times))).alias(time)).drop(time)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard, 0 to 23, and their slot in it."""
    return sharding.shard_rows(docs, 24)


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", join_similar),
    ("benchmark decontamination", decontaminate_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shard),
]

#: No SQL expresses the fitted classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        path = f"{shared_dir(spark)}/stage{k}"
        made = marked()
        stage(spark, docs, sf_dir).write.parquet(path)
        forget(made)  # what the stage left behind
        docs = spark.read.parquet(path)
