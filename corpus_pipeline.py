"""A corpus from raw documents to token ids: five stages, each one operator over all that the stage before it kept.

Stages take and return the columns of documents; the last returns a row for each document with its ids' digest.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.bpe_tree import encode
from plumbline.llm.common import share_package, shared_folder, table
from plumbline.llm.line_dedup import DOCUMENT_RATIO, document_line_dedup
from plumbline.llm.minhash import without_near_duplicates
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.toxicity import without_toxic


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The classifier learns from the labelled documents of the input."""
    return without_toxic(docs, table(spark, sf_dir, "labels"), cutoff=0.7)


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a hundredth of a source's documents, three at least, go."""
    return document_line_dedup(docs, ratio=DOCUMENT_RATIO, length_col="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles, directly or over others, the smallest id stays."""
    return without_near_duplicates(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources take part by weights 1, 2, 3 in turn; a document comes once for each pass that draws it."""
    return mixed_documents(docs, weights=[1, 2, 3], most=3)


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    share_package(spark)
    return encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("minhash_near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe_encode", encode_documents),
]

#: A fitted classifier and MinHash have no SQL form; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
