"""Expressions over lists in one field, samples, sweeps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from skerry.functions import lists as L
from skerry.operators import metrics as M
from skerry.operators import relational as R
from skerry.sources.delimited import write_lines


def test_sets_and_terms(spark):
    rows = [("B ; a;  b", "Salmon; trout;salmon;; cod"), (None, None), ("  ", ""), ("x;;y", "one")]
    got = spark.createDataFrame(rows, "s string, t string").select(L.normalised_set(F.col("s")), L.shorten_terms(F.col("t"), 2)).collect()
    assert [tuple(r) for r in got] == [("a; b", "Salmon; trout"), ("", ""), ("", ""), ("; x; y", "one")]


def test_windows_columns_and_codes(spark):
    row = spark.createDataFrame([("a  bc salmon def g", "10.1/x/y z~*", 7)], "t string, d string, n int").select(
        L.context_window(F.col("t"), F.lit(7), F.lit(12), 3), L.context_window(F.col("t"), F.lit(1), F.lit(1)), *L.split_columns(F.col("d"), "/", ["a", "b", "c", "e"]), L.percent_encode(F.col("d")), L.numbered("T", F.col("n")), L.numbered("T", F.lit(1234)),
    ).first()
    assert tuple(row) == ("bc salmon de", "a bc salmon def g", "10.1", "x", "y z~*", None, "10.1%2Fx%2Fy%20z~%2A", "T_007", "T_1234")
    assert tuple(spark.createDataFrame([("1/2/3",)], "d string").select(*L.split_columns(F.col("d"), "/", ["a", "b"])).first()) == ("1", "2/3")


def test_groups_and_cases(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, "a", 1), (4, None, 2)], "id int, g string, v int")
    assert {r.id: r.n for r in R.add_distinct_count(df, ["g"], "v", "n").collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert {r.id: r.n for r in R.add_distinct_count(df, ["g"], "v", "n", count_null=True).collect()} == {1: 2, 2: 2, 3: 2, 4: 1}
    assert {r.id for r in R.incomplete_cases(df, ["g", "v"]).collect()} == {2, 4}
    assert {r.id for r in R.filter_case(df, [(F.col("g") == "a", F.col("v") == 1)], F.lit(True)).collect()} == {1, 3, 4}
    assert R.union_distinct(df, df).count() == 4
    assert sorted(r.id for r in R.shuffled(df, "id", 1).collect()) == [1, 2, 3, 4]


def test_strata_are_disjoint_and_filled(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    got = R.disjoint_strata(df, "k", {"small": F.col("k") < 3, "even": F.col("k") % 2 == 0}, 5, 1).collect()
    assert len(got) == 10 == len({r.k for r in got})
    assert {s: sum(r.stratum == s for r in got) for s in ("small", "even", "fill")} == {"small": 3, "even": 5, "fill": 2}
    assert R.disjoint_strata(df.where("k < 0"), "k", {"all": F.lit(True)}, 5, 1).count() == 0


def test_sweep_matches_brute_force_and_thresholds_do_not_cross(spark):
    rows = [((i * 37 % 101) / 100, (i * 37 % 101) + i % 60 > 70) for i in range(1500)]
    sweep = M.threshold_sweep(spark.createDataFrame(rows, "score double, label boolean"), "score", "label")
    for r in sweep.collect():
        assert (r.tp, r.fp) == (sum(y for s, y in rows if s >= r.threshold), sum(not y for s, y in rows if s >= r.threshold))
    easy = spark.createDataFrame([(0.1, False), (0.2, False), (0.6, True), (0.7, True), (0.8, True), (0.9, True)], "score double, label boolean")
    one = M.operating_thresholds(M.threshold_sweep(easy, "score", "label"), 0.99, 0.95).first()
    # both are 0.6, so the first quartile of the positives (0.675) decides
    assert one.exclude_below == 0.6 and one.include_from == pytest.approx(0.675)
    empty = M.operating_thresholds(M.threshold_sweep(easy.where("score > 2"), "score", "label")).first()
    assert (empty.exclude_below, empty.include_from) == (0.0, 1.0)


def test_version_outcomes(spark):
    side = lambda rows: spark.createDataFrame(rows, "k int, c string")
    first = side([(1, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "b"), (6, "a")])
    second = side([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c"), (6, "a")])
    gold = side([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (7, "z")])
    got = {r.k: (r.outcome, r.review_required) for r in M.version_outcomes(first, second, gold, "k", "c").collect()}
    assert got == {
        1: ("Unchanged correct", False), 2: ("Improved", False), 3: ("Regressed", True), 4: ("Unchanged incorrect", False), 5: ("Changed but still incorrect", True), 6: ("No gold standard", True), 7: ("Unchanged incorrect", False),
    }


def test_lines(spark, tmp_path):
    write_lines(spark.createDataFrame([("a",), (None,), ("b",)], "x string"), "x", str(tmp_path / "o"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "o")).collect()) == ["a", "b"]
