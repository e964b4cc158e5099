"""Queries of problem 5: new batches against all history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.history import publications
from skerry.sources.tables import table


def _publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publications(table(spark, sf_dir, "clean_records", "record_sequence", "batch_no", "title", "authors", "doi", "abstract"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose publication already has a record with a smaller batch number."""
    return _publications(spark, sf_dir).where("first_batch < batch_no").select("first_sequence", "record_sequence")


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each batch, and how many of them repeat a publication of an earlier one."""
    repeats = F.sum((F.col("first_batch") < F.col("batch_no")).cast("long"))
    return _publications(spark, sf_dir).groupBy("batch_no").agg(F.count("*").alias("n_records"), repeats.alias("n_repeats"))


QUERIES = {"p5_found": p5_found, "p5_batches": p5_batches}
ORACLE: dict[str, str] = {}
