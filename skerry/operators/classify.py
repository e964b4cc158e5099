"""Assigning ontology paths to records through a pluggable classifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.arrow import map_lists

RESPONSE = "array<struct<path_id:string,reason:string>>"
#: A classifier gets the text of a record and returns (path_id, reason) pairs; it may raise.
Classifier = Callable[[str], list[tuple[str, str]]]


def keyword_classifier(cues: dict[str, list[str]], least: int = 1) -> Classifier:
    """A stand-in for a remote model: all paths with cue terms in the text, those with the most first, ties by id."""

    def classify(text: str) -> list[tuple[str, str]]:
        low = text.lower()
        found = [(pid, [c for c in terms if c.lower() in low]) for pid, terms in cues.items()]
        ranked = sorted(((p, hit) for p, hit in found if len(hit) >= least), key=lambda x: (-len(x[1]), x[0]))
        return [(p, "; ".join(hit)) for p, hit in ranked]

    return classify


def classify_records(df: DataFrame, key: str, text: Column, classifier: Classifier) -> DataFrame:
    """``key, response, error``: one call per record; what a call raises becomes its error, not the job's."""

    def run(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for keys, texts in batches:
            out = []
            for k, t in zip(keys, texts, strict=True):
                try:
                    out.append((k, [{"path_id": p, "reason": r} for p, r in classifier(t or "")], None))
                except Exception as e:  # a failed call is a result
                    out.append((k, None, str(e)))
            yield out

    kind = dict(df.dtypes)[key]
    return map_lists(df.select(key, text.alias("t")), run, f"{key} {kind}, response {RESPONSE}, error string")


def flatten_responses(responses: DataFrame, ontology: DataFrame, key: str) -> DataFrame:
    """``key, pos, path_id, hierarchy_path, reason, known``: the first of repeated ids, in the model's order;
    ids that the ontology lacks are kept apart by ``known``."""
    rows = responses.select(key, F.posexplode("response").alias("p", "r")).select(key, "p", "r.*")
    first = rows.groupBy(key, "path_id").agg(F.min_by(F.struct("p", "reason"), "p").alias("x")).select(key, (F.col("x.p") + 1).alias("pos"), "path_id", F.col("x.reason").alias("reason"))
    return first.join(ontology.select("path_id", "hierarchy_path"), "path_id", "left").withColumn("known", F.col("hierarchy_path").isNotNull())
