"""Queries p8 and p9: token ids of all documents, and documents mixed by token shares.

SQL has no tokenizer; the tests hold both against the public library and brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, mixing
from factloom.session import materialize, table


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", bpe.default_path())


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: tokens, bytes, and documents whose ids do not decode to their text."""
    rows = bpe.roundtrip(table(spark, sf_dir, "documents"), "doc_id", "text", bpe.default_path(), ["source"])
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_bytes").alias("n_bytes"), F.count_if(~F.col("same")).alias("n_differing"))


def _mix(spark: SparkSession, sf_dir: str, total: str) -> tuple[DataFrame, list[mixing.Share]]:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"), "doc_id", "text", bpe.default_path(), total)


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus: the rows by slot, then by start, are its order."""
    return _mix(spark, sf_dir, "exact")[0].withColumnRenamed("size", "n_tokens")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, shares = _mix(spark, sf_dir, "exact")
    return mixing.shares_report(materialize(mixed.select("source", "size"), "mixed"), shares)


def p9_shares_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares when no record may be left out: sources that lack repeats fall behind."""
    mixed, shares = _mix(spark, sf_dir, "whole")
    return mixing.shares_report(materialize(mixed.select("source", "size"), "mixed"), shares)


QUERIES = {f.__name__: f for f in (p8_ids, p8_roundtrip, p9_mix, p9_shares, p9_shares_whole)}
SQL: dict[str, str] = {}
