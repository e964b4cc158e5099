"""Queries of problem 2: look-alike characters in titles and authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.lookalikes import affected_fields, fit_rewriter, lookalike_classes, rewritten, token_statistics
from skerry.sources.tables import table

FIELDS = ["title", "authors"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with a character that stands where plainly typed text has another."""
    records = table(spark, sf_dir, "clean_records", "record_sequence", *FIELDS)
    return affected_fields(records, "record_sequence", FIELDS, fit_rewriter(records, FIELDS))


def p2_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All titles and authors in one consistent form."""
    records = table(spark, sf_dir, "clean_records", "record_sequence", *FIELDS)
    rewriter = fit_rewriter(records, FIELDS)
    return records.select("record_sequence", *[rewritten(F.col(c), rewriter).alias(c) for c in FIELDS])


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The look-alike classes of the characters that occur: member, representative, occurrences."""
    records = table(spark, sf_dir, "clean_records", *FIELDS)
    stats = token_statistics(records, FIELDS)
    counts = {r["token"]: r["n"] for r in stats.collect()}
    pairs = [(m, top) for top, members in lookalike_classes(counts) for m in members if m in counts]
    return spark.createDataFrame(pairs, "token string, representative string").join(stats, "token")


QUERIES = {"p2_found": p2_found, "p2_clean_text": p2_clean_text, "p2_classes": p2_classes}
ORACLE: dict[str, str] = {}
