"""Queries of problem 1: abstracts that lost their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.truncation import length_rows, significant_lengths, truncated
from skerry.sources.tables import table


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clean_records", "record_sequence", "source_file", "abstract", "abstract_raw")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose abstract was cut off."""
    return truncated(_records(spark, sf_dir)).select("record_sequence").distinct()


def p1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abstracts of each source, how many of them were cut off and how."""
    records = _records(spark, sf_dir)
    cut = truncated(records).groupBy("source_file").agg(
        F.count("*").alias("n_cut"), F.count_if(F.col("reason") == "limit").alias("n_limit"), F.count_if(F.col("reason") == "mark").alias("n_mark"), F.count_if(F.col("reason") == "ending").alias("n_ending")
    )
    whole = records.where("abstract is not null and trim(abstract) <> ''").groupBy("source_file").agg(F.count("*").alias("n_abstracts"))
    kept = ["n_cut", "n_limit", "n_mark", "n_ending"]
    out = whole.join(cut, "source_file", "left").fillna(0, kept)
    return out.withColumn("share_cut", F.round(F.col("n_cut") / F.col("n_abstracts"), 6))


def p1_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The significant lengths of each source."""
    return significant_lengths(length_rows(_records(spark, sf_dir)))


QUERIES = {"p1_found": p1_found, "p1_sources": p1_sources, "p1_limits": p1_limits}
ORACLE: dict[str, str] = {}
