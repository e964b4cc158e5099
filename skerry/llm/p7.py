"""Queries of problem 7: filling containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.packing import pack_documents
from skerry.sources.tables import table


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document or piece with its container, for each capacity."""
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "pack_capacity"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each capacity and the share of them that is filled."""
    packed = p7_containers(spark, sf_dir)
    return packed.groupBy("capacity_id", "capacity_tokens").agg(
        F.count_distinct("container_id").alias("n_containers"), F.sum("piece_tokens").alias("n_tokens"), F.max("container_tokens").alias("fullest")
    ).withColumn("fill", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


QUERIES = {"p7_containers": p7_containers, "p7_fill": p7_fill}
ORACLE: dict[str, str] = {}
