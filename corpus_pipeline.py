"""A training-corpus pipeline over the table documents: each stage is one operator, written as Parquet and
reread as the next one's input.

    toxicity          documents of a probable toxic grade go
    ngram_join        one document of each group of near copies stays (five words, similarity 0.8)
    decontamination   documents that hold a benchmark item go
    mixing            sources are repeated to tempered weights; every document is used at least once
    token_files       ids are written in doc_id order; the result is the digest of what is read back

The stages are written for null ids and texts, repeated rows, empty tables and further columns; what each case
gives is said at the operators. Repeated uses of a document reach the token files as rows of one doc_id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import decontamination, mixing, ngram_join, token_files, toxicity
from tessel.llm.common import read_table, shared_dir
from tessel.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train_toxicity(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.reject_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_copies(docs, shingle=5, percent=80)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(docs, tokenizer_path("word_bpe_49k.json"), 2)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_join", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("token_files", write_token_files),
]

#: Models, similarity joins and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each one's rows written to the shared folder and reread."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/tessel-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
