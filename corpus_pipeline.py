"""A corpus pipeline over the training-text operators: ``STAGES`` in their order."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeeper.llm import exact_dedup, mixing, ngram_join, sentencepiece_codec, toxicity
from lorekeeper.llm.common import file_order, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not predict toxic."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each component of 5-word shingle sets with a similarity of 0.8 or more."""
    return ngram_join.drop_similar(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the curriculum takes, once a copy, in the order of training."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document and the text that they decode to, in the order of training.

    ``position`` is the row's place in the files of the mix, null if it does not come from files;
    ``copy`` numbers rows that agree in doc_id and text, each of which has draws of its own.
    """
    at = file_order(docs)
    rows = docs.select("doc_id", "text", (F.lit(None).cast("long") if at is None else at).alias("position"))
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("position")
    rows = rows.withColumn("copy", F.row_number().over(same) - 1)
    return sentencepiece_codec.encode_documents(rows, copy=F.col("copy"), position=F.col("position"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: The classifier and the encoder cannot be expressed in SQL; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
