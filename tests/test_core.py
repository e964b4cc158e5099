import pytest
from pyspark.sql import functions as F

from skerry.functions import text as X
from skerry.operators import metrics as M
from skerry.operators import relational as R
from skerry.operators.classify import classify_records, flatten_responses, keyword_classifier
from skerry.operators.incoming import jaro_winkler_pair, match_incoming, near_pairs
from skerry.plans.evaluation import delivery_audit
from skerry.sources.delimited import read_csv, read_padded_tsv, write_csv
from skerry.sources.ris import read_ris
from skerry.streaming.incremental import run_available


def test_text_functions(spark):
    df = spark.createDataFrame([(" a   b ", "NA", "<p>x&amp;lt;y</p>", "https://doi.org/10.1234/AB ", "2019/05/01", "Ærø—Łódź & æble; ß")], "a string, n string, h string, d string, y string, t string")
    r = df.select(X.squish(F.col("a")), X.clean_na(F.col("n")), X.clean_html(F.col("h")), X.normalise_doi(F.col("d")), X.year_of(F.col("y")), X.normalise_title(F.col("t"))).first()
    assert tuple(r) == ("a b", None, "x<y", "10.1234/ab", 2019, "aero lodz aeble ss")
    bad = spark.createDataFrame([("x", None), ("10.12/a", "abc")], "d string, y string").select(X.normalise_doi(F.col("d")).alias("d"), X.year_of(F.col("y")).alias("y")).collect()
    assert [tuple(r) for r in bad] == [(None, None), (None, None)]


def test_ris_files(spark, tmp_path):
    (tmp_path / "a.ris").write_text("junk\nTY  - JOUR\nTI  - One\n  goes on\nAU  - Berg, A.\nAU  - Holm, O.\nDO  - doi:10.1/x\nER  - \nTY  - JOUR\nST  - Short\nER  - \nTY  - lost\n")
    rows = read_ris(spark, str(tmp_path / "a.ris")).orderBy("record_no").collect()
    assert [(r.record_no, r.title, r.authors, r.source_file) for r in rows] == [(1, "One goes on", "Berg, A. | Holm, O.", "a.ris"), (2, "Short", None, "a.ris")]


def test_delimited_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\nb'), (2, None)], "k int, v string")
    write_csv(df, str(tmp_path / "c"))
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), "k int, v string").collect())) == [(1, 'a "q"\nb'), (2, None)]
    (tmp_path / "t.tsv").write_text("#c\n1\ta\n2\tb\tc\td\n")
    assert sorted(map(tuple, read_padded_tsv(spark, str(tmp_path / "t.tsv"), "k int, v string, w string").collect())) == [(1, "a", None), (2, "b", "c")]


def test_relational(spark):
    df = spark.createDataFrame([(i, i % 3 if i else None, i % 5) for i in range(50)], "k int, g int, v int")
    assert R.distinct_keep_first(df, ["g"], ["k"]).count() == 4
    assert R.add_count(df, ["g"]).where("g is null").first().n == 1
    assert {r.g: r.s for r in R.second_largest(df.where("g is not null"), ["g"], "v", "s").collect()} == {0: 4, 1: 4, 2: 4}
    assert [r.batch for r in R.batch_numbers(df, "k", 20).orderBy("k").collect()] == [1] * 20 + [2] * 20 + [3] * 10
    assert R.batch_numbers(df.where("k < 0"), "k", 20).count() == 0
    assert R.sample_up_to(df, "k", 7, 1).count() == 7 and R.stratified_sample(df, "g", "k", 2, 1).count() == 7
    with pytest.raises(ValueError):
        R.require_columns(df, ["k", "z"])


def test_set_metrics(spark):
    g = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, c string")
    p = spark.createDataFrame([(1, "a"), (1, "z"), (3, "q")], "k int, c string")
    got = {r.k: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in M.record_metrics(g, p, "k", "c").collect()}
    assert got == {1: (1, 1, 1, 0.5, 0.5), 2: (0, 0, 1, 0.0, 0.0), 3: (0, 1, 0, 0.0, 1.0)}
    assert M.disagreements(g, p, "k", "c").count() == 4


def test_thresholds(spark):
    s = spark.createDataFrame([(0.9, True), (0.9, False), (0.5, True), (0.1, False)], "s double, y boolean")
    sweep = {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in M.threshold_sweep(s, "s", "y").collect()}
    assert sweep == {0.9: (1, 1, 1, 1), 0.5: (2, 1, 0, 1), 0.1: (2, 2, 0, 0)}


def test_incoming(spark):
    assert round(jaro_winkler_pair("martha", "marhta"), 4) == 0.9611 and jaro_winkler_pair("", "a") == 0
    schema = "id int, title_key string, doi_key string, year int, author_key string, title_prefix string, token_key string"
    long = "growth of atlantic salmon smolts in closed sea pens"
    master = spark.createDataFrame([(1, long, "d1", 2001, "berg", long[:24], "x"), (2, "other title altogether", "d2", 2002, "holm", "o", "y"), (3, "", "d3", None, "", "", "")], schema)
    new = [(10, long, None, None, "z", "", ""), (11, long + "s", "d1", None, "z", "", ""), (12, "quite unlike", "d2", None, "q", "", ""), (13, "named", "d3", None, "", "", ""), (14, "growth of atlantic salmon smolts in closed sea penz", None, None, "berg", "", ""), (15, "unmatched", None, None, "nn", "", "")]
    new.append((16, "growth of atlantic salmon smolts in clossed see pans", None, 2001, "other", "", ""))  # of the same year only
    got = {r.new_id: (r.status, r.master_id) for r in match_incoming(spark.createDataFrame(new, schema), master).collect()}
    assert got == {10: ("duplicate", 1), 11: ("duplicate", 1), 12: ("doi_conflict_review", 2), 13: ("possible_duplicate", 3), 14: ("probable_duplicate", 1), 15: ("new", None), 16: ("possible_duplicate", 1)}


def test_near_titles_need_no_common_word(spark):
    """All pairs of a block are compared, by one row for each title and block."""
    rows = [(i, t, None, 2001, "", t[:24], "") for i, t in enumerate(["environmental contaminants", "enviornmental contamiannts", "salmon 88 9 " + "a" * 90, "salmon 98 8 " + "a" * 89])]
    df = spark.createDataFrame(rows, "id int, title_key string, doi_key string, year int, author_key string, title_prefix string, token_key string")
    pairs = near_pairs(df, df, 0.965)
    assert "explode(array_distinct" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.new_id, r.master_id, r.rank) for r in pairs.collect()} == {(i, j, 0) for i in range(4) for j in range(4) if i // 2 == j // 2}


def test_delivery_audit_compares_all_titles_of_a_year(spark, tmp_path):
    rows = [(1, "Environmental contaminants", None, None, 0, 2001), (2, "Enviornmental contamiannts", None, None, 1, 2001), (3, "Another title", None, None, 1, 2001), (4, "Another title", None, None, 1, 2001)]
    spark.createDataFrame(rows, "record_sequence int, title string, authors string, doi string, batch_no int, year int").write.parquet(str(tmp_path / "clean_records.parquet"))
    assert {(r.batch_no, r.fate, r.n) for r in delivery_audit(spark, str(tmp_path)).collect()} == {(1, "possible_duplicate", 1), (1, "new", 1), (1, "repeated_in_delivery", 1)}


def test_repeated_titles_are_compared_once(spark, monkeypatch):
    from skerry.operators import incoming

    met = []

    def pairs(*a, f=incoming.near_pairs):
        met.append(f(*a))
        return met[-1]

    monkeypatch.setattr(incoming, "near_pairs", pairs)
    schema = "id int, title_key string, doi_key string, year int, author_key string, title_prefix string, token_key string"
    a, b = "growth of atlantic salmon smolts in closed sea pens", "growth of atlantic salmon smolts in closed sea penz"
    master = [(i, a, None, 2001 if i % 2 else None, "berg", a[:24], "x") for i in range(1, 31)]
    new = [(i, b, None, 2001 if i % 3 else 2002, "" if i % 2 else "berg", b[:24], "x") for i in range(100, 130)]
    got = {r.new_id: (r.master_id, r.basis, r.status) for r in match_incoming(spark.createDataFrame(new, schema), spark.createDataFrame(master, schema)).collect()}
    first = lambda i: "same year" if i % 3 else "title prefix" if i % 2 else "same author"
    assert got == {i: (1, first(i), "probable_duplicate") for i in range(100, 130)}
    assert met[0].count() <= 4 * 2  # four kinds of new records, two of masters, each 30 times


def test_classifier_errors_are_rows(spark):
    df = spark.createDataFrame([(1, "lice and feed"), (2, None), (3, "boom")], "k int, t string")
    base = keyword_classifier({"P1": ["lice"], "P2": ["feed", "lice"]})

    def classify(text):
        if "boom" in text:
            raise RuntimeError("no answer")
        return base(text) + base(text)

    answers = classify_records(df, "k", F.col("t"), classify)
    assert [r.error for r in answers.orderBy("k").collect()] == [None, None, "no answer"]
    onto = spark.createDataFrame([("P2", "A > B")], "path_id string, hierarchy_path string")
    assert sorted((r.k, r.pos, r.path_id, r.known) for r in flatten_responses(answers, onto, "k").collect()) == [(1, 1, "P2", True), (1, 2, "P1", False)]


def test_incremental_runs_are_idempotent(spark, tmp_path):
    def write(keys, name):
        spark.createDataFrame([(k,) for k in keys], "k int").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    write([1, 2, 2], "a")
    stream = lambda: spark.readStream.schema("k int").parquet(str(tmp_path / "in" / "*"))
    run = lambda: run_available(stream(), "k", lambda d: d.withColumn("failed", F.lit(False)), str(tmp_path / "state"), str(tmp_path / "cp"))
    assert sorted(r.k for r in run().collect()) == [1, 2]
    assert sorted(r.k for r in run().collect()) == [1, 2]
    write([2, 3], "b")
    assert sorted(r.k for r in run().collect()) == [1, 2, 3]
