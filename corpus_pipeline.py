"""A training corpus from raw documents, in five stages, each an operator of the library applied to all that the stage
before it kept: language identification, exact duplicates, near duplicates, personal data, packing."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askframe.llm import exact_dedup, langid, ngram_join, packing, pii
from askframe.llm.common import few, kept, numbered

#: Words of a shingle, and the similarity (as a fraction) from which documents are near duplicates.
SHINGLE, NEAR = 5, (8, 10)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language: those without any letter, null and empty texts among them. All other rows stay,
    also rows without an id and repeated ones."""
    found = langid.label(docs)
    return found.where(F.col(found.columns[-2]) != langid.UNDETERMINED).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: of repeated rows too only one, of rows with and without an id one with."""
    rows, row = numbered(docs)
    dropped = few(exact_dedup.exact_dedup(rows, row_col=row).where("not kept").select(row))
    return rows.join(dropped, row, "left_anti").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each component of near duplicates, one without an id only if none has one. Texts
    without a word are no duplicates."""
    rows, row = numbered(docs)
    found = ngram_join.repeats(rows.select(F.col(row).alias("rid"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), SHINGLE, *NEAR)
    return rows.join(few(found.withColumnRenamed("rid", row)), row, "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and the terms that disclose it; n_chars follows the text. Every row stays, null texts as null."""
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long"))) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids: doc_id, start, length, doc_tokens, ids (little-endian uint32), sequence_id, offset. Every
    row is packed, a null or empty text as its end alone; rows without an id or of one id each have their own pieces."""
    return packing.pack_documents(docs, tokenizer())


def tokenizer() -> str:
    """The vocabulary's file: that of ASKFRAME_TOKENIZER, or the installed public one."""
    if at := os.environ.get("ASKFRAME_TOKENIZER"):
        return at
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


STAGES = [("language", language), ("exact", exact), ("near", near), ("private", private), ("packed", packed)]
#: A trained network, a corpus-wide join and a tokenizer have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
