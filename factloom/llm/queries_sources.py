"""Query p1: generated, minified or vendored source files, and what is left when they go.

SQL has no such operator; the tests hold it against hand-made files and brute-force links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import provenance
from factloom.session import table


def p1_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file: why it was not written by hand (null: it was), and the family it belongs to."""
    files = table(spark, sf_dir, "fts_inputs")
    out = provenance.classified(files)
    skipped = provenance.excluded(files, table(spark, sf_dir, "scan_config")).withColumn("skipped", F.lit(True))
    reason = F.when(F.col("skipped"), "excluded").otherwise(F.col("reason"))
    return out.join(skipped, "file_id", "left").withColumn("reason", reason).drop("skipped")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_files(spark, sf_dir).where("reason is not null").select("file_id").distinct()


def p1_handwritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that remain, per workspace and language."""
    files = table(spark, sf_dir, "fts_inputs").groupBy("file_id").agg(F.max("language").alias("language"))
    kept = p1_files(spark, sf_dir).where("reason is null").select("file_id", "workspace_id")
    return kept.join(files, "file_id").groupBy("workspace_id", "language").agg(F.count("*").alias("n_files"))


QUERIES = {f.__name__: f for f in (p1_found, p1_files, p1_handwritten)}
SQL: dict[str, str] = {}
