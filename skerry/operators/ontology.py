"""Ontologies: building one from terms, asking for its labels level by level, requests and answers as JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skerry.functions.arrow import map_lists
from skerry.functions.lists import numbered
from skerry.operators.relational import drop_general_if_specific

LEVELS = ["broad_topic", "subtopic", "feature", "component"]
GENERAL = "General"
#: A chooser gets a text and the labels allowed below each chosen parent, by parent; it returns the chosen (parent,
#: label) pairs.
Chooser = Callable[[str, dict[tuple, list[str]]], list[tuple[tuple, str]]]
#: The shape of an answer: messages with parts of text, in them the labels as JSON.
ANSWER = "output array<struct<type:string,content:array<struct<type:string,text:string>>>>"
LABELS = "labels array<string>, review_required boolean, review_reason string"


def build_ontology(terms: DataFrame, prefix: str = "TOPIC") -> DataFrame:
    """``path_id``, the levels, ``hierarchy_path``, ``term_count``, ``supporting_terms``: one row for each path, numbered
    in the order of its levels; terms that differ in letter case only count once.  NULL and empty terms are
    ignored.  Numbers run over the paths, of which there are as many as an ontology has, not over terms."""
    each = terms.where("term <> ''").groupBy(*LEVELS, F.lower("term").alias("_t")).agg(F.min("term").alias("term"))
    paths = each.groupBy(*LEVELS).agg(F.count("*").alias("term_count"), F.array_join(F.array_sort(F.collect_list("term")), "; ").alias("supporting_terms"))
    number = F.row_number().over(W.orderBy(*LEVELS))
    return paths.select(numbered(prefix, number).alias("path_id"), *LEVELS, F.concat_ws(" > ", *[F.coalesce(c, F.lit("NA")) for c in LEVELS]).alias("hierarchy_path"), "term_count", "supporting_terms")


def path_levels(ontology: DataFrame, path: str = "hierarchy_path") -> DataFrame:
    """``ontology`` with a column for each level of its paths."""
    parts = F.split(F.col(path), r"\s*>\s*")
    return ontology.select("*", *[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(LEVELS)])


def label_chooser(paths: list[tuple[str, ...]]) -> Chooser:
    """A stand-in for a remote model: a label is chosen if it or a label below it stands in the text; "General"
    where none of its siblings is."""
    below: dict[tuple, set[str]] = {}
    for p in paths:
        for k in range(1, len(p) + 1):
            below.setdefault(p[:k], set()).update(x.lower() for x in p[k - 1 :] if x and x != GENERAL)

    def choose(text: str, allowed: dict[tuple, list[str]]) -> list[tuple[tuple, str]]:
        low, out = text.lower(), []
        for parent, labels in allowed.items():
            hit = [x for x in labels if x != GENERAL and any(w in low for w in below[(*parent, x)])]
            out += [(parent, x) for x in hit or [x for x in labels if x == GENERAL and parent]]
        return out

    return choose


def classify_levels(df: DataFrame, key: str, text: Column, paths: list[tuple[str, ...]], chooser: Chooser) -> DataFrame:
    """``key``, the levels, ``review_required``, ``error``: labels chosen level by level, those of a level among the children of
    what was chosen before.

    Nothing chosen at the first level gives no row; nothing at a later one gives the labels so far, for review.  A label
    outside the allowed ones, or an exception, is the record's ``error``.  A path "General > General" goes where
    the record has another one in the same subtopic.  NULL texts are empty ones.  ``paths`` are an ontology's."""
    children: dict[tuple, list[str]] = {}
    for p in sorted(set(paths)):
        for k, label in enumerate(p):
            if label not in children.setdefault(p[:k], []):
                children[p[:k]].append(label)

    def descend(t: str) -> tuple[list[tuple], bool]:
        chosen: list[tuple] = [()]
        for depth in range(len(LEVELS)):
            allowed = {c: children[c] for c in chosen}
            found = chooser(t, allowed)
            if bad := sorted({x for parent, x in found if x not in allowed.get(parent, ())}):
                raise ValueError(f"labels not allowed: {', '.join(bad)}")
            if not found:
                return (chosen, True) if depth else ([], False)
            chosen = list(dict.fromkeys((*parent, x) for parent, x in found))
        return chosen, False

    def run(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for keys, texts in batches:
            out = []
            for k, t in zip(keys, texts, strict=True):
                try:
                    rows, review = descend(t or "")
                    out += [(k, *r, *[None] * (len(LEVELS) - len(r)), review, None) for r in rows]
                except Exception as e:  # a failed call is a result
                    out.append((k, *[None] * len(LEVELS), True, str(e)))
            yield out

    kind = dict(df.dtypes)[key]
    rows = map_lists(df.select(key, text.alias("t")), run, f"{key} {kind}, {', '.join(f'{c} string' for c in LEVELS)}, review_required boolean, error string")
    general = F.coalesce((F.col("feature") == GENERAL) & (F.col("component") == GENERAL), F.lit(False))
    return drop_general_if_specific(rows, [key, "broad_topic", "subtopic"], general)


def requests(df: DataFrame, key: str, title: Column, abstract: Column, instructions: str, allowed: list[str], model: str) -> DataFrame:
    """``custom_id, line``: one JSON object for each record with the instructions, its title and abstract, and the schema
    of the answer; NULL texts are empty."""
    part = lambda role, t: F.struct(F.lit(role).alias("role"), F.array(F.struct(F.lit("input_text").alias("type"), t.alias("text"))).alias("content"))
    user = F.concat(F.lit("TITLE\n"), F.coalesce(title, F.lit("")), F.lit("\n\nABSTRACT\n"), F.coalesce(abstract, F.lit("")))
    labels = F.struct(F.lit("array").alias("type"), F.struct(F.lit("string").alias("type"), F.array(*[F.lit(x) for x in allowed]).alias("enum")).alias("items"))
    schema = F.struct(F.lit("object").alias("type"), F.struct(labels.alias("labels")).alias("properties"))
    body = F.struct(F.lit(model).alias("model"), F.array(part("system", F.lit(instructions)), part("user", user)).alias("input"), F.struct(F.lit("json_schema").alias("type"), schema.alias("schema")).alias("format"))
    custom = F.concat(F.lit("record_"), F.col(key).cast("string"))
    return df.select(custom.alias("custom_id"), F.to_json(F.struct(custom.alias("custom_id"), body.alias("body"))).alias("line"))


def parse_answers(df: DataFrame, key: str, answer: Column, allowed: list[str]) -> DataFrame:
    """``key, labels, review_required, review_reason, error`` of JSON answers: the first text of their messages,
    its labels each once in the model's order.  Answers without message, without text or with labels outside
    ``allowed`` have no labels but an ``error``; so have NULL and broken ones."""
    messages = F.filter(F.from_json(answer, ANSWER)["output"], lambda x: x["type"] == "message")
    texts = F.filter(F.flatten(F.transform(messages, lambda x: F.coalesce(x["content"], F.array().cast("array<struct<type:string,text:string>>")))), lambda x: (x["type"] == "output_text") & x["text"].isNotNull())
    rows = df.select(key, messages.alias("m"), texts.alias("t")).withColumn("p", F.from_json(F.get("t", F.lit(0))["text"], LABELS))
    bad = F.array_except(F.col("p.labels"), F.array(*[F.lit(x) for x in allowed]).cast("array<string>"))
    error = (
        F.when(F.coalesce(F.size("m"), F.lit(0)) <= 0, "no message").when(F.coalesce(F.size("t"), F.lit(0)) <= 0, "no text").when(F.col("p.labels").isNull(), "no labels")
        .when(F.size(bad) > 0, F.concat(F.lit("labels not allowed: "), F.array_join(bad, ", ")))
    )
    return rows.select(key, F.when(error.isNull(), F.array_distinct("p.labels")).alias("labels"), F.col("p.review_required").alias("review_required"), F.col("p.review_reason").alias("review_reason"), error.alias("error"))
