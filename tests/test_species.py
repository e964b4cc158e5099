import pytest

from skerry.operators.spans import dictionary, greedy_keep, with_spans
from skerry.operators.species import assign_species, detect_species
from pyspark.sql import functions as F

CASES = [
    ("Effects on Atlantic salmon and brown trout", None, ["SAL_SALAR", "SAL_TRUTTA"], ["SAL_SALAR"], "primary", "Brown trout"),
    ("ATLANTIC SALMON IN TANKS", None, ["SAL_SALAR"], ["SAL_SALAR"], "primary", None),
    ("Atlantic salmon farming", "nothing", ["SAL_SALAR"], ["SAL_SALAR"], "primary", None),
    ("Effects of salmon farming", None, ["UNSPEC_SALMON"], ["UNSPEC_SALMON"], "primary", None),
    ("On steelhead trout", None, ["ONC_MYKISS"], ["ONC_MYKISS"], "primary", None),
    ("Atlantic salmon", "Salmo salar and rainbow trout", ["ONC_MYKISS", "SAL_SALAR"], ["ONC_MYKISS", "SAL_SALAR"], "co-primary", None),
    ("Atlantic salmon", "growth of salmon in pens far away from anything else", ["SAL_SALAR", "UNSPEC_SALMON"], ["SAL_SALAR"], "primary", None),
    ("Salmo trutta in rivers", None, ["SAL_TRUTTA"], [None], "unresolved", "Brown trout"),
    ("Arctic char and brown trout", None, ["SALVELINUS_ALPINUS", "SAL_TRUTTA"], [None], "unresolved", "Arctic char; Brown trout"),
    ("salmon near Salmo trutta", None, ["SAL_TRUTTA", "UNSPEC_SALMON"], [None], "unresolved", "Brown trout"),
    ("farmed salmon near Salmo trutta", None, ["SAL_TRUTTA", "UNSPEC_SALMON"], ["UNSPEC_SALMON"], "primary", "Brown trout"),
    ("salmon" + " x" * 100 + " Salmo trutta", None, ["SAL_TRUTTA", "UNSPEC_SALMON"], ["UNSPEC_SALMON"], "primary", "Brown trout"),
    ("salmonid", "", [], [None], "unresolved", None),
    (None, None, [], [None], "unresolved", None),
]


@pytest.fixture(scope="module")
def detected(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(CASES)], "k int, title string, abstract string")
    return detect_species(df, "k").cache()


def test_mentions(detected):
    got = {r.k: sorted({m.species_id for m in r.mentions}) for r in detected.collect()}
    assert got == {i: sorted(c[2]) for i, c in enumerate(CASES)}


def test_assignments_cover_every_record(detected):
    rows = assign_species(detected, "k").collect()
    for i, c in enumerate(CASES):
        mine = [r for r in rows if r.k == i]
        assert sorted((r.farmed_species_id or "" for r in mine)) == sorted(x or "" for x in c[3])
        assert {r.assignment_role for r in mine} == {c[4]} and {r.non_target_species for r in mine} == {c[5]}
        assert all(r.review_required == (c[4] == "unresolved") for r in mine)


def test_offsets_slice_back_and_kept_spans_do_not_overlap(detected):
    for r in detected.collect():
        for source in ("title", "abstract"):
            text = CASES[r.k][0 if source == "title" else 1]
            spans = sorted((m.match_start, m.match_end, m.matched_term) for m in r.mentions if m.source == source)
            assert all(text[a - 1 : b] == t for a, b, t in spans)
            assert all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_policies(spark):
    df = spark.createDataFrame([("big red fish and red fish",), (None,), ("",)], "t string")
    terms = dictionary([{"term": t} for t in ("red fish", "big red fish", "fish")])
    every = [[(s.start, s.end) for s in r.s] for r in with_spans(df, F.col("t"), terms, "s").select("s").collect()]
    assert every == [[(1, 12), (5, 12), (9, 12), (18, 25), (22, 25)], [], []]
    outer = with_spans(df, F.col("t"), terms, "s", "containment").select("s").first().s
    assert [(s.start, s.end) for s in outer] == [(1, 12), (18, 25)]
    assert greedy_keep([0, 0, 4], [5, 5, 9], False) == [0] and greedy_keep([0, 0, 4], [5, 5, 9], True) == [0, 1, 2]
