"""Queries of problem 8: evaluation passages in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.leakage import leaked_items
from skerry.sources.tables import table


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of an item, and the item."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items: in how many documents, and the longest run of their words there."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("run_words").alias("longest_run"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
ORACLE: dict[str, str] = {}
