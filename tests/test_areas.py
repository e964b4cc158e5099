"""Areas of a record, gazetteers and their reviews."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skerry.operators import areas as A

SCHEMA = "k int, source string, area string, context string, matched_text string"


def strict(spark, rows):
    got = A.strict_areas(spark.createDataFrame(rows, SCHEMA), "k", F.col("area") == "Europe").collect()
    return {r.k: (r.areas, r.n_areas, r.reason, r.review_reason) for r in got}


def test_strict_areas(spark):
    rows = [
        (1, "title", "Norway", "in Norway", "Norway"), (1, "abstract", "Chile", "sampled in Chile", "Chile"),
        (2, "title", "Norway", "Norway", "Norway"), (2, "title", "Chile", "Chile", "Chile"),
        (3, "title", "Europe", "Europe", "Europe"), (3, "abstract", "Chile", "sampled in Chile", "Chile"),
        (4, "abstract", "Chile", "sampled in Chile", "Chile"), (4, "abstract", "Norway", "Norway", "Norway"), (4, "abstract", "Norway", "Norway", "Norway"),
        (5, "abstract", "Chile", "Chile", "Chile"), (5, "abstract", "Norway", "Norway", "Norway"),
        (6, "abstract", "Chile", "springer Chile", "Chile"), (7, "abstract", "Chile", "Chilean salmon", "Chilean"), (8, "abstract", None, "x", "x"),
        (9, "abstract", "Chile", "farmers such as Chile", "Chile"),
    ]
    assert strict(spark, rows) == {
        1: ("Norway", 1, "one area in the title", None), 2: ("Chile; Norway", 2, "areas named together in the title", None), 3: (None, 0, None, "title names a region"),
        4: ("Chile", 1, "study location", None), 5: (None, 0, None, "best areas are tied"), 9: ("Chile", 1, "strongest evidence", None),
    }
    assert strict(spark, []) == {}


def test_study_areas(spark):
    rows = [
        (1, "title", "Norway", "Norway", ""), (1, "abstract", "Chile", "sampled in Chile", ""), (1, "abstract", "Peru", "Peru", ""),
        (2, "abstract", "Chile", "Chile", ""), (3, "abstract", "Chile", "unlike Chile", ""), (4, "abstract", "Chile", "Chile", ""), (4, "abstract", "Peru", "Peru", ""), (5, "abstract", "Chile", "wiley", ""),
    ]
    got = A.study_areas(spark.createDataFrame(rows, SCHEMA), "k", ["sampled in"], ["unlike"], ["wiley"]).collect()
    assert {(r.k, r.area, r.reason, r.n_unresolved) for r in got} == {
        (1, "Norway", "named in the title", 1), (1, "Chile", "further area of the study", 1), (2, "Chile", "only area of the abstract", 0), (3, None, None, 1), (4, None, None, 2),
    }


def test_gazetteer_rules(spark):
    rows = [("Oslo", "populated place", 700_000), ("Bergen", "populated place", 280_000), ("Puerto Montt", "populated place", 10), ("Vadso", "populated place", None), ("Along", "country", None), ("Ohio", "admin1 name", None), ("Chile", "country", None)]
    got = A.filter_gazetteer(spark.createDataFrame(rows, "place string, kind string, population int")).collect()
    assert {(r.place, r.requires_case) for r in got} == {("Bergen", True), ("Puerto Montt", True), ("Chile", False)}


def test_review(spark):
    places = spark.createDataFrame([("Bath", "UK", "town"), ("Oslo", "NO", "town"), ("Bergen", "NO", "town")], "place string, area string, kind string")
    review = lambda *rows: spark.createDataFrame(list(rows), "place string, area string, kind string, decision string")
    kept, log = A.apply_review(places, review((" BATH", "UK", "town", "Remove "), ("oslo", "NO", "town", "keep")))
    assert {(r.place, r.review_decision) for r in kept.collect()} == {("Oslo", "keep"), ("Bergen", "not observed")}
    assert log.count() == 2
    for bad in ([("Bath", "UK", "town", None)], [("Bath", "UK", "town", "keep"), ("bath", "UK", "town", "remove")]):
        with pytest.raises(ValueError):
            A.apply_review(places, review(*bad))


def test_regions_and_names(spark):
    places = spark.createDataFrame([("North", "KOR", 5), ("New Brunswick", "USA", 60), ("Oslo", "NOR", 60)], "place string, area string, priority int")
    regions = spark.createDataFrame([("European", "Europe")], "place string, region string")
    got = A.with_regions(places, regions, spark.createDataFrame([("New Brunswick", "CAN")], "place string, area string")).collect()
    assert {(r.place, r.area, r.priority, r.region) for r in got} == {("Oslo", "NOR", 60, None), ("European", None, 200, "Europe"), ("New Brunswick", "CAN", 250, None)}
    m = spark.createDataFrame([(1, "NOR", "Norge"), (2, "NOR", "Noreg"), (3, "CHL", "Chile"), (4, None, "?")], "k int, code string, name string")
    names = spark.createDataFrame([("CHL", "Republic of Chile")], "code string, name string")
    assert {r.k: r.name for r in A.canonical_names(m, "code", "name", names).collect()} == {1: "Noreg", 2: "Noreg", 3: "Republic of Chile", 4: "?"}
