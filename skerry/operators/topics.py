"""Topics of a hierarchy by its terms in title and abstract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import split_columns
from skerry.operators.spans import dictionary, term_spans

LEVELS = ["broad_topic", "subtopic", "feature", "component"]
#: Dictionary rows that are sent to every task at most; a larger dictionary is an error.
MAX_TERMS = 100_000
#: A term that names no topic and is never looked for.
GENERAL = "general"


def topic_rows(ontology: DataFrame) -> list[dict]:
    """Dictionary rows of an ontology: every path with its lowest level, and with each of its standalone cues, as term."""
    levels = split_columns(F.col("hierarchy_path"), r"\s*>\s*", LEVELS)
    cues = F.split(F.coalesce("alternative_standalone_cues", F.lit("")), ";")
    terms = ontology.select("path_id", *levels, cues.alias("cues")).select("path_id", *LEVELS, F.explode(F.concat(F.array("component"), "cues")).alias("term"))
    terms = terms.withColumn("term", F.lower(F.trim("term"))).where((F.col("term") != "") & (F.col("term") != GENERAL)).distinct()
    rows = terms.orderBy("path_id", "term").limit(MAX_TERMS + 1).collect()
    if len(rows) > MAX_TERMS:
        raise ValueError(f"the topic dictionary has more than {MAX_TERMS} terms")
    return [r.asDict() for r in rows]


def detect_topics(df: DataFrame, key: str, fields: list[str], rows: list[dict]) -> DataFrame:
    """``key, mentions``: every occurrence of a term in the fields, overlaps included, with the path and its levels.

    Terms are found whatever the case between characters that are not letters, digits or "_"; a blank term and
    "General" never.  NULL and empty texts have no mentions; every record keeps its row."""
    rows = [r for r in rows if r["term"] and r["term"].strip() and r["term"].strip().lower() != GENERAL]
    spans = term_spans(df, key, fields, [r["term"].strip() for r in rows], "all")
    if not rows:
        rows = [{"path_id": None, **dict.fromkeys(LEVELS), "term": None}]
    paths = dictionary([{k: r[k] for k in ("path_id", *LEVELS)} for r in rows])

    def mention(s: Column) -> Column:
        of = F.get(paths, s["term"])
        return F.struct(*[of[k].cast("string").alias(k) for k in ("path_id", *LEVELS)], s["matched"].alias("matched_term"), s["source"].alias("source"), s["start"].alias("match_start"), s["end"].alias("match_end"))

    return spans.select(key, F.transform("spans", mention).alias("mentions"))


def assign_topics(detected: DataFrame, key: str) -> DataFrame:
    """A row for each topic of a record, or one without topic that is sent to review."""
    topics = F.array_distinct(F.transform("mentions", lambda m: F.struct(*[m[k].alias(k) for k in LEVELS])))
    rows = detected.select(key, F.explode_outer(topics).alias("t"))
    none = F.col("t").isNull()
    reason = F.when(none, "No topic dictionary terms detected").otherwise("One or more topic dictionary terms detected")
    return rows.select(key, "t.*", none.alias("review_required"), reason.alias("assignment_reason"))
