"""A corpus in five stages: quality rules, toxicity, near duplicates, mixing, packing.

Each stage takes all that the one before kept and returns the columns of documents (the last one: packed pieces); what it
returns is written as Parquet in the shared folder and read again, so that a lost executor costs no earlier stage.

Defined results: null, empty and blank texts fail the quality rules, so they go in the first stage; null ids, languages and
sources are kept as such; equal rows share their verdicts, and of near duplicates, equal rows among them, one stays; texts of
any length are read whole; an empty table gives no pieces; other columns pass through all stages but the last, whatever
their names. run() deletes a stage's table once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import common, jaccard_join, mixing, packing, quality_rules, toxicity
from tessella.llm.tokens import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), max_words=300_000)  # workers share their memory with the other stages


STAGES = [("quality rules", quality), ("toxicity", clean), ("n-gram Jaccard join", unique), ("mixing sources", mixed), ("packing", packed)]

#: Tokenization and the trained classifier can't be expressed in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = common.documents(spark, sf_dir), common.Scratch(spark), None
    for name, stage in STAGES:
        docs = scratch.put(name.replace(" ", "_"), stage(spark, docs, sf_dir))
        if before:
            scratch.drop(before)
        before = name.replace(" ", "_")
    return docs
