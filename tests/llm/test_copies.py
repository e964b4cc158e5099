import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.copies import Trie, combined, copies, copy_groups, radix_buckets
from skerry.llm.records import bare_doi, same_words, sentences, words

SCHEMA = "record_sequence int, title string, authors string, doi string, fp string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_forms_of_one_record_fall_together(spark):
    rows = [
        (5, "Short-day light and growth: a trial", "Berg, Anna | Holm, O.", "10.1/ab.c"),
        (2, "SHORT DAY LIGHT AND GROWTH – A TRIAL.", "O. Holm; Berg, Anna", "https://doi.org/10.1/AB.C"),
        (9, "shortday light and growth; trial, a", '"Berg, Anna","Holm, O."', "doi:10.1%2Fab.c."),
        (7, "Short-day light and growth: a trail", "Berg, Anna | Holm, O.", "10.1/ab.c"),
        (8, "Short-day light and growth: a trial", "Berg, Anna | Holm, O.", "10.1/other"),
        (11, None, "Berg, Anna", "10.1/x"),
        (12, "  ", None, None),
        (13, "Lone", None, None),
        (14, "Lone", "", ""),
    ]
    got = {r.record_sequence: (r.first_sequence, r.copies) for r in copies(frame(spark, rows)).collect()}
    assert got == {5: (2, 3), 2: (2, 3), 9: (2, 3), 7: (7, 1), 8: (8, 1), 13: (13, 2), 14: (13, 2)}


def test_hot_group_and_brute_force_with_small_buckets(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["cod", "ling", "tusk", "hake", "eel"]) for _ in range(4)) for _ in range(60)]
    rows = [(i, base[0] if i % 3 == 0 else rng.choice(base), "Holm A", None) for i in range(600)]
    rows = [(i, t.upper() if i % 2 else t, a, d) for i, t, a, d in rows]
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(tuple(sorted(words(t))), []).append(i)
    want = {i: (min(g), len(g)) for g in groups.values() for i in g}
    got = {r.record_sequence: (r.first_sequence, r.copies) for r in copies(frame(spark, rows), capacity=3).collect()}
    assert got == want


def test_empty_table_and_repeated_rows(spark):
    assert copies(spark.createDataFrame([], T._parse_datatype_string(SCHEMA))).count() == 0
    got = copies(frame(spark, [(1, "cod", None, None)] * 3)).collect()
    assert [tuple(r) for r in got] == [(1, 1, 3)] * 3


def test_buckets_fit_or_cannot_be_split(spark):
    df = spark.createDataFrame([(i, bytes([i % 7, i % 5, i % 3]), "f", 1, i) for i in range(200)], "fp bigint, canon binary, form string, n bigint, first_sequence int")
    sizes = radix_buckets(df, 10, step=1).groupBy("bucket").agg(F.count("*").alias("k"), F.countDistinct("canon").alias("d")).collect()
    assert sum(r.k for r in sizes) == 200
    assert all(r.k <= 10 or r.d == 1 for r in sizes)


def test_trie_counts():
    trie = Trie()
    for key in [b"", b"abc", b"abcdefgh", b"abcdefghij", b"abc"]:
        trie.add(key, "f", 1, 1, 1)
    assert sorted(len(t) for t in trie.terminals()) == [1, 1, 1, 2]


def test_words_dois_sentences():
    assert same_words("short day cod".split(), "cod shortday".split())
    assert not same_words("copper".split(), "coppre".split())
    assert bare_doi("DOI: 10.1000/ABC.") == bare_doi("http://dx.doi.org/10.1000/abc") == "10.1000/abc"
    assert bare_doi(None) == bare_doi(" ") == ""
    assert sentences("One fish. Two 0.5 fish!\nThree") == ["one fish", "two 0 5 fish", "three"]
    assert sentences(None) == []


def test_combining_is_partial_but_complete(spark):
    rows = spark.createDataFrame([(i, i % 2, b"k", "f") for i in range(100)], "record_sequence int, fp bigint, canon binary, form string")
    total = combined(rows).groupBy("fp").agg(F.sum("n").alias("n"), F.min("first_sequence").alias("m")).orderBy("fp").collect()
    assert [(r.n, r.m) for r in total] == [(50, 0), (50, 1)]
    assert copy_groups(rows).where("copies > 1").count() == 2
