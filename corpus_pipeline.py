"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the docs of the next one.  All but the last return documents
with the columns they came with.  Null and empty texts, very long ones, ties, repeated rows
and empty tables are treated as the operator of the stage says; other columns are carried.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import exact_dedup, mixing, packing, quality_classifier, simhash
from marketlens.session import ensure_checkpoint_dir
from marketlens.sources import files


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good."""
    return quality_classifier.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    return simhash.thin(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.remix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; a document that the mix repeats is packed each time."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("mixing", mix), ("packing", pack)]

#: The classifier, the fingerprints and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over ``documents``; what lies between them is written to the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *before, (_, last) = STAGES
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    try:
        for i, (_, stage) in enumerate(before):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
            docs = spark.read.parquet(f"{folder}/{i}")
        # packing has read its documents when it returns, so the folder can go
        return last(spark, docs, sf_dir)
    finally:
        files.remove(spark, folder)
