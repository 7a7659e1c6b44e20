"""A cleaning and mixing pipeline for training documents; every stage is one operator."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmatch.llm import byte_pairs, line_dedup, mixing, near_copies, quality_rules
from shelfmatch.session import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that neither the base rule nor a rule learned from ``labels`` rejects."""
    return quality_rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out every line that an earlier line repeats, short ones exactly; lengths follow the text."""
    left = line_dedup.deduplicated(docs, short_repeats=True).select(*docs.columns)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each group that shares four fifths of its five-word shingles; SimHash
    fingerprints and min-hash bands find who may."""
    return near_copies.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lay all documents out in the order that holds the sources at their weights."""
    return mixing.in_order(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token identifiers of every document, the digest that shows they decode to its text, and its place
    in the mix, read from where the stage before has put the row."""
    placed = mixing.places(docs).withColumn("__row", F.struct("doc_id", "mix_place"))
    found = byte_pairs.digests(byte_pairs.encode_documents(placed, *byte_pairs.public_ranks(), id_col="__row"))
    return found.select("doc_id.doc_id", *found.columns[1:], "doc_id.mix_place")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared folder and read again."""
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
