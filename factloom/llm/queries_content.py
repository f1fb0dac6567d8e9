"""Query p10: abusive, hateful or sexual language in documents.

SQL has no such grammar; the tests hold it against the reviewed labels and hand-made cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import abuse
from factloom.session import table


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.scores(table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_scores(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id").distinct()


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged documents and rate per source, and how many show each kind."""
    rows = abuse.scores(table(spark, sf_dir, "documents"), "doc_id", "text", ["source"])
    flagged = F.col("score") >= abuse.THRESHOLD
    kinds = [F.count_if(F.array_contains("kinds", k)).alias(f"n_{k}") for k in ("insult", "threat", "hate", "sexual")]
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if(flagged).alias("n_flagged"), F.avg(flagged.cast("int")).alias("rate"), *kinds)


QUERIES = {f.__name__: f for f in (p10_found, p10_scores, p10_rates)}
SQL: dict[str, str] = {}
