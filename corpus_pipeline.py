"""A corpus pipeline of five of the training-data operators, stage by stage over whole tables.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's result as
Parquet and reads it back as the next one's input. All stages but the last keep the columns of
documents (and any others). Repeated rows, null texts and null ids go through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from artilake.llm import decontaminate, ngram_join, packing, secrets, toxicity
from artilake.llm.common import stored

WIDTH, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled rows outside the held-out third."""
    return toxicity.keep(docs, toxicity.trained(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return ngram_join.keep_first(docs, WIDTH, PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reported spans are replaced in the texts; no document goes."""
    return secrets.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, each a sequence of its own."""
    return packing.digest(packing.pack(docs))


STAGES = [("toxicity", drop_toxic), ("ngram_join", drop_near_copies), ("decontamination", drop_contaminated), ("secrets", mask_secrets), ("packing", pack)]

#: The stages are models, joins by hash and tokenizers: no SQL form. tests/llm compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
