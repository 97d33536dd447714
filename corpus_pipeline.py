"""A corpus pipeline of five operators; each stage's table is written and read by the next."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontaminate, mixing, simhash, token_output, toxicity
from ledgerloom.shared import materialize

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. A null or empty text is judged by the edges of a text alone,
    repeated rows go or stay together, an empty table stays empty; without labels of both kinds all stay."""
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates stays, the one with the smallest id. Texts without words
    (null ones too) are one group; of repeated rows one stays; an empty table stays empty."""
    return simhash.deduplicate(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. Null and empty texts have none and stay, as do all documents
    where the benchmark is empty; repeated rows go or stay together."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them: not at all, or up to three times. A null source is a
    source; null and empty texts have no size and are left out; repeated rows are drawn one by one."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in the binary format, and what a reader of the files finds for each document. A null or empty text is
    the end id alone; null ids come first, repeated ids one behind the other; an empty table gives no rows."""
    return token_output.token_table(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_free),
    ("mix_sources", mixed),
    ("token_ids", tokens),
]

#: Neither trained scores nor hashed draws can be said in SQL; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; each but the last is written and read again, so no stage is computed twice.

    Columns of the documents pass through all of them, whatever they are called; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
