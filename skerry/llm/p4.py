"""Queries of problem 4: copies hidden by differences of form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.copies import copies
from skerry.sources.tables import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clean_records", "record_sequence", "title", "authors", "doi")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy other than the first of its group."""
    return copies(_records(spark, sf_dir)).where("record_sequence <> first_sequence").select("first_sequence", "record_sequence")


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each group of copies, with its number of copies."""
    firsts = copies(_records(spark, sf_dir)).where("record_sequence = first_sequence").select("record_sequence", F.col("copies").alias("n_copies"))
    return firsts.join(_records(spark, sf_dir), "record_sequence")


QUERIES = {"p4_found": p4_found, "p4_collapsed": p4_collapsed}
ORACLE: dict[str, str] = {}
