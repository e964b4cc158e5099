"""RIS records: reading files and texts, writing texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.text import empty_to_null, squish

# RIS tags and the fields they fill.
TAGS = {"TY": "type", "ID": "record_id", "ST": "short_title", "AB": "abstract_raw", "AU": "authors", "DO": "doi_raw", "PY": "year_raw", "T2": "journal", "VL": "volume", "IS": "issue", "SP": "pages", "UR": "url_raw"}


def _tag(fields: Column, tag: str) -> Column:
    """Values of a tag joined by " | "; continuation lines belong to the line before."""
    own = F.filter(fields, lambda f: F.startswith(f, F.lit(f"{tag}  -")))
    values = F.transform(own, lambda f: squish(F.regexp_replace(F.substr(f, F.lit(6)), r"\r?\n", " ")))
    return empty_to_null(F.array_join(F.filter(values, lambda v: v != ""), " | "))


def parse_block(block: Column) -> list[Column]:
    """The fields of one record's text; what stands before its first tag is ignored."""
    fields = F.filter(F.split(block, r"(?m)^(?=[A-Z0-9]{2}  -)"), lambda f: f.rlike(r"^[A-Z0-9]{2}  -"))
    title = F.coalesce(_tag(fields, "TI"), _tag(fields, "ST"))
    return [*[_tag(fields, t).alias(name) for t, name in TAGS.items()], title.alias("title"), F.size(fields).alias("raw_field_count")]


def parse_texts(texts: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Records of RIS texts: ``keys``, ``record_no`` (from 1 in each text) and the fields.  A record ends with
    its ER line; text after the last one is ignored, a text without one has no records."""
    blocks = F.split(F.col(text), r"(?m)^ER\s{2}-.*$")
    return texts.select(*keys, F.posexplode(F.slice(blocks, 1, F.size(blocks) - 1)).alias("p", "block")).select(*keys, (F.col("p") + 1).alias("record_no"), *parse_block(F.col("block")))


def read_ris(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of RIS files, each file read whole, with ``source_file``; bad bytes become replacement
    characters."""
    files = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_name").alias("source_file"))
    return parse_texts(files, "value", ["source_file"])


def to_ris(df: DataFrame, key: str, out: str = "ris") -> DataFrame:
    """``key`` and the RIS text of each record; NULL fields have no line, authors one line each."""
    lines = [F.concat(F.lit("TY  - "), F.coalesce("type", F.lit("GEN")))]
    for tag, name in {"ID": "record_id", "TI": "title", "AB": "abstract_raw", "DO": "doi_raw", "PY": "year_raw", "T2": "journal"}.items():
        lines.append(F.concat(F.lit(f"{tag}  - "), F.col(name)))
    lines.append(F.concat(F.lit("AU  - "), F.array_join(F.split("authors", r"\s*\|\s*"), "\nAU  - ")))
    return df.select(key, F.concat(F.concat_ws("\n", *lines), F.lit("\nER  - \n")).alias(out))
