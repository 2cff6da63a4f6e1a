"""The corpus pipeline: documents in, token files out. Each stage applies one operator of ``bibliospark.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibliospark.llm import decontaminate, jaccard, mixing, quality, tokens
from bibliospark.llm.common import fold
from bibliospark.llm.queries import vocabulary
from bibliospark.session import table, work_folder


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labelled documents among those it is given, without the
    held-out fifth."""
    return quality.kept_by_quality(docs, table(spark, sf_dir, "labels").filter(fold() != 0))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest id: five-word shingles, Jaccard 0.8."""
    return jaccard.one_per_component(docs, percent=80, width=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: a document appears as often as it is drawn, shuffled within output shards."""
    return mixing.mixed(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, read back: doc_id, start, n_tokens, ids_crc32."""
    path = work_folder(spark, "tokens")
    tokens.write_tokens(docs, path, vocabulary())
    return tokens.token_digests(spark, path)


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", decontaminated), ("mixing", mixed), ("tokens", tokenized)]

#: A learned classifier and seeded draws are not SQL; tests/llm/test_pipeline.py holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
