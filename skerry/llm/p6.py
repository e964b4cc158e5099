"""Queries of problem 6: spellings of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.names import entities, spelling_pairs, spellings
from skerry.sources.tables import materialize, table


def _entities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    names = materialize(spellings(table(spark, sf_dir, "clean_records", "authors"), "authors"), "spellings")
    return names, entities(names)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different spellings of one person or organisation."""
    return spelling_pairs(_entities(spark, sf_dir)[1])


def p6_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with its entity's most frequent spelling, and how often each occurs."""
    names, linked = _entities(spark, sf_dir)
    known = names.join(linked, "name")
    top = known.groupBy("entity").agg(F.max_by("name", F.struct("n", "name")).alias("main_name"))
    return known.join(top, "entity").select("name", "n", "main_name")


QUERIES = {"p6_found": p6_found, "p6_entities": p6_entities}
ORACLE: dict[str, str] = {}
