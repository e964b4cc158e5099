"""Queries of problem 9: template residue, filler and messages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.residue import residue
from skerry.sources.tables import table


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with residue."""
    return residue(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id").distinct()


def p9_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of documents with each kind of residue."""
    return residue(table(spark, sf_dir, "documents", "doc_id", "text")).select(F.explode("kinds").alias("kind")).groupBy("kind").agg(F.count("*").alias("n_documents"))


QUERIES = {"p9_found": p9_found, "p9_kinds": p9_kinds}
ORACLE: dict[str, str] = {}
