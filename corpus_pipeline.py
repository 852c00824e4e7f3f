"""From raw documents to token ids: five stages, each one operator over all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm import bpe, decontam, langid, line_dedup, ngram_join
from pagelens.llm.common import cut, unused
from pagelens.session import ship_package

RANKS = "byte_bpe_multi_50k.tiktoken"
#: A language scored below this is no decision; the document is rejected.
LEAST_SCORE = 0.5
#: Near duplicates of the pipeline: shingles of five words, a similarity of 0.8.
NEAR = ngram_join.JoinParams(words=5, percent=80)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or without a clear language; the model learns from ``lang``.

    Where no document has a language, nothing is learned and only documents
    without letters go.
    """
    ship_package(spark)
    model = langid.fit_language_model(docs)
    lang, score = unused("lang_pred", docs), unused("lang_score", docs)
    judged = langid.predict_language(docs, model, lang_out=lang, score_out=score)
    clear = F.col(score) >= LEAST_SCORE if model["langs"] else F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")
    return judged.where(clear).drop(lang, score)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts; a document that loses its whole text goes, as do its counts of characters."""
    ship_package(spark)
    done = line_dedup.dedup_lines(docs)
    left = done.where((F.col("n_removed") == 0) | (F.length(F.trim("text")) > 0))
    return left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays; null ids stay."""
    ship_package(spark)
    groups = ngram_join.ngram_jaccard_join(docs, params=NEAR)
    return docs.join(groups.where("doc_id <> component_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    ship_package(spark)
    leaks = unused("leaks", docs)
    marked = decontam.add_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=leaks)
    return marked.where(F.size(leaks) == 0).drop(leaks)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with the digest of their decoded bytes."""
    ship_package(spark)
    coded = bpe.bpe_round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "lang", "source", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("ngram_jaccard", ngram_jaccard), ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

#: No stage but the last could be SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every result but the last is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
