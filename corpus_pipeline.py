"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, tokens. Each stage's result is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finfacts.llm import exact_dedup, mixing, neardup, queries, toxicity
from finfacts.llm._shared import Scratch, documents


#: Near copies share at least this percentage of their five-word shingles.
ALIKE = 80
#: The mixture wanted once toxic documents are gone: shares of tokens by what the labels say of quality.
SHARES = {"good": 0.88, "poor": 0.12}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic. Null and empty texts stay, as do all where no label tells toxic from clean."""
    return toxicity.keep_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the longest, then the one with the smallest id. Null texts count as empty; a null id stays only alone."""
    return exact_dedup.keep_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Texts without words and null ids stay."""
    return neardup.keep_rows(docs, percent=ALIKE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates of 1 or more: documents of wanted domains are repeated, none is lost. Without labels there is one domain and nothing changes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null")
    return mixing.mix_rows(docs, labels.select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("domain")), SHARES, budget=1.25, lower=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; a null text counts as empty."""
    return queries.token_digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: The stages are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on. Without documents there are no rows."""
    scratch, docs = Scratch(spark), documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        scratch.drop(scratch.names[-1])
    return docs
