"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tamiz.llm import decontaminate, jaccard, language, mixing, tokenshards
from tamiz.llm.queries import shipped
from tamiz.llm.shared import settle, workspace


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told; ``lang`` becomes the language found."""
    return language.documents_in_known_language(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones."""
    return jaccard.one_of_each_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def in_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources; a document that is taken twice is there twice."""
    return mixing.mixed_documents(docs)


def as_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids in shards: where each starts, how many ids it has, and their checksum."""
    return tokenshards.token_rows(docs)


STAGES = [(name, lambda s, docs, d, f=f: shipped(lambda s, d: f(s, docs, d))(s, d)) for name, f in (("language_id", known_language), ("ngram_jaccard", without_near_copies), ("decontamination", without_benchmark), ("source_mix", in_target_mix), ("token_ids", as_token_ids))]

#: SQL can't express the classifier, the knapsack or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    root, docs = workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"{root}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
