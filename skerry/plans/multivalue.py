"""Queries of problem 3: one row per author or hierarchy path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators.multivalue import authors_array, paths_array, split_to_rows
from skerry.sources.tables import table

#: Most paths an ontology may have to be sent to every task as a vocabulary.
MAX_KNOWN_PATHS = 20_000


def known_paths(spark: SparkSession, sf_dir: str) -> list[str]:
    """The paths of the ontology, a dimension table whose size is checked here."""
    rows = table(spark, sf_dir, "ontology_v4", "hierarchy_path").where("hierarchy_path is not null").limit(MAX_KNOWN_PATHS + 1).collect()
    if len(rows) > MAX_KNOWN_PATHS:
        raise ValueError(f"the ontology has more than {MAX_KNOWN_PATHS} paths")
    return [r[0] for r in rows]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of authors and assigned_paths with its position."""
    records = table(spark, sf_dir, "clean_records", "record_sequence", "authors")
    results = table(spark, sf_dir, "topic_v4_llm_record", "result_id", "assigned_paths")
    people = split_to_rows(records, "record_sequence", authors_array(F.col("authors")), "authors")
    paths = split_to_rows(results, "result_id", paths_array(F.col("assigned_paths"), known_paths(spark, sf_dir)), "assigned_paths")
    return people.unionByName(paths)


def p3_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of values per field and position."""
    return p3_found(spark, sf_dir).groupBy("field_name", "pos").agg(F.count("*").alias("n_values"), F.countDistinct("item").alias("n_items"))


QUERIES = {"p3_found": p3_found, "p3_value_counts": p3_value_counts}
ORACLE: dict[str, str] = {}
