"""Ontologies, labels level by level, requests and answers."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from skerry.operators import ontology as O

PATHS = [("Health", "Lice", "Treatment", "Baths"), ("Health", "Lice", "General", "General"), ("Health", "Vaccines", "General", "General"), ("Feed", "Oils", "Fish oil", "General")]


def classify(spark, texts, chooser=None):
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    rows = O.classify_levels(df, "k", F.col("t"), PATHS, chooser or O.label_chooser(PATHS)).collect()
    return sorted(((r.k, r.broad_topic, r.subtopic, r.feature, r.component, r.review_required, r.error) for r in rows), key=str)


def test_terms_build_an_ontology(spark):
    rows = [("B", "s", "f", "c", "Lice"), ("B", "s", "f", "c", "lice"), ("A", "s", "f", "c", "net"), ("B", "s", "f", "c", "bath"), ("A", "s", "f", "c", None), ("A", "s", "f", "c", "")]
    got = O.build_ontology(spark.createDataFrame(rows, "broad_topic string, subtopic string, feature string, component string, term string"))
    assert [(r.path_id, r.hierarchy_path, r.term_count, r.supporting_terms) for r in got.orderBy("path_id").collect()] == [("TOPIC_001", "A > s > f > c", 1, "net"), ("TOPIC_002", "B > s > f > c", 2, "Lice; bath")]


def test_levels_follow_parents(spark):
    got = classify(spark, ["baths against lice", "vaccines", "fish oil", "nothing", None])
    assert got == [(0, "Health", "Lice", "Treatment", "Baths", False, None), (1, "Health", "Vaccines", "General", "General", False, None), (2, "Feed", "Oils", "Fish oil", "General", False, None)]


def test_general_goes_beside_a_specific_path(spark):
    both = lambda t, allowed: [(p, x) for p, labels in allowed.items() for x in labels if p or x == "Health"]
    assert [r[2:5] for r in classify(spark, ["x"], both)] == [("Lice", "Treatment", "Baths"), ("Vaccines", "General", "General")]


def test_stops_and_errors(spark):
    stop = lambda t, allowed: [(p, x) for p, labels in allowed.items() for x in labels if len(p) < 1]
    assert classify(spark, ["x"], stop) == [(0, "Feed", None, None, None, True, None), (0, "Health", None, None, None, True, None)]
    wrong = lambda t, allowed: [((), "Politics")]
    assert classify(spark, ["x"], wrong) == [(0, None, None, None, None, True, "labels not allowed: Politics")]


def test_requests_are_json(spark):
    df = spark.createDataFrame([(1, 'A "title"', None)], "k int, t string, a string")
    row = O.requests(df, "k", F.col("t"), F.col("a"), "Do.", ["x", "y"], "m").first()
    body = json.loads(row.line)["body"]
    assert row.custom_id == "record_1" and body["input"][1]["content"][0]["text"] == 'TITLE\nA "title"\n\nABSTRACT\n'
    assert body["format"]["schema"]["properties"]["labels"]["items"]["enum"] == ["x", "y"]


def test_answers(spark):
    text = lambda labels: json.dumps({"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "refusal"}, {"type": "output_text", "text": json.dumps({"labels": labels, "review_required": True, "review_reason": None})}]}]})
    answers = [text(["b", "a", "b"]), text(["a", "q"]), '{"output": []}', '{"output": [{"type": "message", "content": []}]}', "{broken", None, text([])]
    df = spark.createDataFrame(list(enumerate(answers)), "k int, x string")
    got = [(r.labels, r.error) for r in O.parse_answers(df, "k", F.col("x"), ["a", "b"]).orderBy("k").collect()]
    assert got == [(["b", "a"], None), (None, "labels not allowed: q"), (None, "no message"), (None, "no text"), (None, "no message"), (None, "no message"), ([], None)]
