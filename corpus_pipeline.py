"""A corpus pipeline over the operators of noteforge.llm: each stage works on all rows that the one before kept.

Documents that toxicity scoring rejects go, then exact copies, then near copies but one; the rest is mixed to the
sources' target weights, so a document can come twice or in part, and packed into batches of near equal lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from noteforge.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from noteforge.llm.common import free_name, stored


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those scored 0.5 and above."""
    score = free_name(docs, "score")
    return toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry_all=True).where(f"{score} < 0.5").drop(score)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without exact copies."""
    return exact_dedup.drop_exact(docs)


def distant(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one of each group of near copies."""
    return near_dedup.drop_near(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of docs, as documents."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document of the mix is packed."""
    return packing.pack(docs)


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("near dedup", distant), ("mixing", mixed), ("packing", packed)]
#: A label model, MinHash and pseudorandom permutations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over documents, each result written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
