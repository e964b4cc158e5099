import csv
import io

import pytest
from pyspark.sql import functions as F

from skerry.functions import text as X
from skerry.operators import places as P
from skerry.operators.incoming import jaro_winkler_pair, may_reach
from skerry.operators.incoming import _letters
from skerry.operators.screening import decide, document_frequency, terms
from skerry.operators.spans import TermFinder
from skerry.operators.species import SPECIES, detect_species, dictionary_violations, species_rows
from skerry.operators.topics import assign_topics, detect_topics, topic_rows

ONTOLOGY = [("P1", "Health > Lice > Counts > Lice counts", "sea lice; lice"), ("P2", "Health > Lice > General > General", ""), ("P3", "Feed > Oil > Algae > Algal oil", None), ("P4", "Feed > Oil > a+b > a+b (x)", "")]


def dictionary_frame(spark, text=SPECIES):
    rows = list(csv.reader(io.StringIO(text.strip())))
    return spark.createDataFrame([[x or None for x in r] for r in rows[1:]], ", ".join(f"{c} string" for c in rows[0]))


def test_dictionary_rules(spark):
    assert len(species_rows()) == 48 and dictionary_violations(dictionary_frame(spark)).count() == 0
    head = SPECIES.strip().splitlines()[0]
    bad = [",Name,Sci,x,common,TRUE,g", "A,Name,Sci,y,common,MAYBE,g", "A,Other,Sci,z,odd,TRUE,g", "B,B,S,z,common,TRUE,g", "B,B,S,w,common,TRUE,g", "B,B,S,w,common,TRUE,g"]
    got = {(r.rule, r.value) for r in dictionary_violations(dictionary_frame(spark, "\n".join([head, *bad]))).collect()}
    assert got == {("blank species_id", None), ("invalid is_farmed_candidate", "MAYBE"), ("invalid synonym_type", "odd"), ("repeated row", "w"), ("synonym of several species", "z"), ("several preferred names", "A")}
    with pytest.raises(ValueError):
        dictionary_violations(dictionary_frame(spark).drop("synonym"))


def test_boundaries_of_species_names(spark):
    df = spark.createDataFrame([(1, "salmon_x and Salmo gairdneri", None), (2, "Salmo salar.", "(S. salar) salmonid farms"), (3, None, "")], "k int, title string, abstract string")
    got = {r.k: [(m.species_id, m.matched_term) for m in r.mentions] for r in detect_species(df, "k").collect()}
    assert got == {1: [("ONC_MYKISS", "Salmo gairdneri")], 2: [("SAL_SALAR", "Salmo salar"), ("SAL_SALAR", "S. salar"), ("UNSPEC_SALMON", "salmonid farms")], 3: []}


def test_finder_agrees_with_a_scan():
    words = ["fish", "red fish", "sh", "fish fish", "İx"]
    text = "Fish fish fish, red FISH; redfish sh_ sh İx"
    want = []
    for i, w in enumerate(words):
        at, low = 0, text.replace("İ", "\0").lower().replace("\0", "İ")
        form = w if "İ" in w else w.lower()
        while (at := low.find(form, at)) >= 0:
            end = at + len(form)
            ok = lambda c: not (c.isascii() and (c.isalnum() or c == "_"))
            if (at == 0 or ok(text[at - 1])) and (end == len(text) or ok(text[end])):
                want.append((at, -end, i))
                at = end
            else:
                at += 1
    assert TermFinder(words)(text) == sorted(want)
    assert TermFinder([])("x") == []


def test_topics(spark):
    onto = spark.createDataFrame(ONTOLOGY, "path_id string, hierarchy_path string, alternative_standalone_cues string")
    rows = topic_rows(onto)
    assert [(r["path_id"], r["term"]) for r in rows] == [("P1", "lice"), ("P1", "lice counts"), ("P1", "sea lice"), ("P3", "algal oil"), ("P4", "a+b (x)")]
    df = spark.createDataFrame([(1, "Sea lice counts", "General notes"), (2, None, "ALGAL OIL, algal oil_x"), (3, "", None), (4, "licence", None)], "k int, title string, abstract string")
    found = detect_topics(df, "k", ["title", "abstract"], rows)
    got = {r.k: [(m.path_id, m.matched_term, m.source, m.match_start, m.match_end) for m in r.mentions] for r in found.collect()}
    assert got == {1: [("P1", "Sea lice", "title", 1, 8), ("P1", "lice counts", "title", 5, 15), ("P1", "lice", "title", 5, 8)], 2: [("P3", "ALGAL OIL", "abstract", 1, 9)], 3: [], 4: []}
    per = sorted((r.k, r.component, r.review_required) for r in assign_topics(found, "k").collect())
    assert per == [(1, "Lice counts", False), (2, "Algal oil", False), (3, None, True), (4, None, True)]
    assert assign_topics(detect_topics(df, "k", ["title"], []), "k").where("review_required").count() == 4


def gazetteer(spark, rows):
    return spark.createDataFrame(rows, "place string, area string, priority int, requires_case boolean, ambiguous boolean")


def test_places(spark, monkeypatch):
    names = gazetteer(spark, [("north sea", "sea", 1, False, False), ("the great north sea fishing bank", "bank", 2, False, True), ("Bank", "money", 1, True, False), ("north sea", "water", 3, False, False), ("", "none", 1, False, False)])
    df = spark.createDataFrame([(1, "On the Great North Sea fishing bank, North Sea", "a bank"), (2, None, ""), (3, "Bank", "north seas")], "k int, title string, abstract string")
    got = sorted((r.k, r.source, r.token_start, r.token_end, r.area) for r in P.match_places(df, "k", ["title", "abstract"], names).collect())
    want = [(1, "title", 2, 7, "bank"), (1, "title", 4, 5, "sea"), (1, "title", 4, 5, "water"), (1, "title", 9, 10, "sea"), (1, "title", 9, 10, "water"), (3, "title", 1, 1, "money")]
    assert got == want
    monkeypatch.setattr(P, "FIRST_WORDS", 1)  # a gazetteer too large for a set of first words
    monkeypatch.setattr(P, "BROADCAST_NAMES", 0)
    large = P.match_places(df, "k", ["title", "abstract"], names)
    assert sorted((r.k, r.source, r.token_start, r.token_end, r.area) for r in large.collect()) == want
    kept = P.best_priority(P.outermost(large, "k"), "k")
    assert sorted((r.k, r.token_start, r.area) for r in kept.collect()) == [(1, 2, "bank"), (1, 9, "water"), (3, 1, "money")]
    summary = {r.k: (r.places, r.areas, r.n_mentions, r.review_required) for r in P.summarise_places(df, kept, "k").collect()}
    assert summary == {1: ("north sea; the great north sea fishing bank", "bank; water", 2, True), 2: (None, None, 0, False), 3: ("Bank", "money", 1, False)}
    assert P.match_places(df, "k", ["title"], gazetteer(spark, [])).count() == 0


def test_bound_of_similarity_loses_no_pair(spark):
    import random

    rng = random.Random(2)
    rows = []
    for _ in range(3000):
        a = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 12)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            b[rng.randrange(len(b))] = rng.choice("abc d")
        b = "".join(b)
        rows.append((a, b, jaro_winkler_pair(a, b)))
    df = spark.createDataFrame(rows, "a string, b string, s double")
    a, b = F.col("a"), F.col("b")
    assert df.where((F.col("s") >= 0.9) & ~may_reach(a, b, _letters(a), _letters(b), 0.9)).count() == 0
    assert df.where((F.col("s") < 0.9) & ~may_reach(a, b, _letters(a), _letters(b), 0.9)).count() > 500


def test_text_helpers(spark):
    df = spark.createDataFrame([("a > b > c", "one two three four", " B; a ;b;"), (None, None, None)], "p string, t string, s string")
    r = df.select(*X.split_columns(F.col("p"), r"\s*>\s*", ["x", "y"]), X.shorten(F.col("t"), 8).alias("t"), X.around(F.col("t"), F.lit(5), F.lit(7), 4).alias("w"), X.set_text(F.col("s")).alias("s"), X.not_in_set(F.col("p"), ["z"]).alias("n")).collect()
    assert tuple(r[0]) == ("a", "b", "one two…", "one two thr", "a; b", True)
    assert tuple(r[1]) == (None, None, None, None, "", True)


def test_screening_terms_and_decisions(spark):
    df = spark.createDataFrame([("The salmon-lice in pens https://x.y/z",), ("salmon pens",), ("salmon",), (None,)], "t string")
    got = [sorted(r.terms) for r in terms(df, "t").collect()]
    assert got == [["lice", "lice pens", "pens", "salmon", "salmon lice"], ["pens", "salmon", "salmon pens"], ["salmon"], []]
    counts = {r.term: r.df for r in document_frequency(terms(df, "t"), least=2, most=0.7).collect()}
    assert counts == {"pens": 2}
    rows = spark.createDataFrame([(0.05,), (0.3,), (0.9,)], "p double").select(decide(F.col("p"), 0.1, 0.6).alias("d")).collect()
    assert [r.d for r in rows] == ["exclude", "review", "retain"]
