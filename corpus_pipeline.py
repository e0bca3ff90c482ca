"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Toxic documents go; of equal texts, then of near-duplicate groups, the row with the smallest
doc_id stays; sources are brought to their target weights by leaving out and
repeating documents; the rest is packed into sequences.

Decisions on rows are by their places in files, so rows that share a doc_id, or have none, are told apart; null ids
come after all others. A null text counts as empty: it scores as a text without words, equals other empty texts, has no near copies, is
mixed as a document of size 0 and packed as one end token. Texts are read whole, however long. Of repeated rows one stays; ties
go to the smaller doc_id, then place. Further columns are kept up to the last stage, whatever they are called. An empty table
gives empty results.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from streamctx.llm import dedup, jaccard, mixing, packing, staging, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(docs, locator=dedup.place_in_file(docs))
    return dedup.without(docs, staging.stage(found.where("NOT kept").select("locator"), "pipeline-near-copies"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply(docs, mixing.mix(docs, locator=dedup.place_in_file(docs)), dedup.place_in_file(docs))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_documents),
]

#: A trained classifier and packing can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staging.stage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
