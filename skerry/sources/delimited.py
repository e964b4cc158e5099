"""Delimited files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with header, quoted line breaks and doubled quotes; empty values and NA are NULL."""
    df = spark.read.csv(path, schema=schema, header=True, quote='"', escape='"', multiLine=True, nullValue="NA", emptyValue="")
    return df.replace("", None)


def read_padded_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab file without header and quotes: "#" begins a comment, missing last columns are NULL, further
    ones are dropped."""
    return spark.read.csv(path, schema=schema, sep="\t", quote="", comment="#", mode="PERMISSIVE")


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder with header; NULL is written empty."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', nullValue="", emptyValue="")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """A text folder with one line for each row, such as JSON requests or prompts; NULL gives none."""
    df.where(df[column].isNotNull()).select(column).write.mode("overwrite").text(path)
