"""Queries of the corpus operators over the tables of a data folder, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, langid, mixing, ngram_join, quality, secrets, token_counts, token_files, toxicity
from .common import fold, read_table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 3) == 1
    model = quality.train_quality(docs, labels, ~held_out)
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), 0.9)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), 4096)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.score_toxicity(docs, toxicity.train_toxicity(docs, labels))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.corpus_models(docs))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(secrets.span_list(base).cast("binary"), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"),
    )


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(read_table(spark, sf_dir, "documents"), shingle=3, percent=90)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    found = langid.identify_languages(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_schedule(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_embedding_dedup, op3_token_counts, op4_token_files, op5_toxicity, op6_secrets, op7_ngram_join, op8_langid, op9_mixing, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    """None of the ten is given in SQL: models, tokenizers and similarity joins over whole tables have no
    SQL form that runs in reasonable time; their tests hold them against brute force."""
    return {}
