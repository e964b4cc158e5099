import unicodedata

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.llm.lookalikes import Rewriter, UnionFind, affected_fields, fit_rewriter, lookalike_classes, rewritten, token_statistics

TEXTS = [
    ("plain text about salmon", None),
    ("ｆｕｌｌ width", "full width"),
    ("Leрugоkun", "Lepugokun"),
    ("no break", "no break"),
    ("zero​width", "zerowidth"),
    ("Håkon", "Håkon"),
    ("inﬂammation", "inflammation"),
    ("Лосось вода (Salmo)", "Лосось вода (Salmo)"),
    ("β-glucan – test “x”", "β-glucan – test “x”"),
    ("tab\tand\nbreak  blanks", "tab\tand\nbreak  blanks"),
    ("", ""),
]


@pytest.fixture(scope="module")
def rewriter():
    counts = {}
    for text, _ in TEXTS:
        for c in text:
            counts[c] = counts.get(c, 0) + 1
    for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ ":
        counts[c] = counts.get(c, 0) + 50
    counts["å"] = 1
    counts["å"] = 5
    counts[""] = 10_000
    return Rewriter(lookalike_classes(counts))


@pytest.mark.parametrize("text, plain", TEXTS)
def test_one_form(rewriter, text, plain):
    assert rewriter(text) == (text if plain is None else plain)
    assert rewriter(rewriter(text)) == rewriter(text)


def test_long_text_and_none(rewriter):
    assert rewriter(None) is None
    long = "сod " * 50_000
    assert rewriter(long) == "cod " * 50_000


def test_classes_are_transitive():
    sets = UnionFind()
    for a, b in [("a", "b"), ("b", "c"), ("x", "y")]:
        sets.union(a, b)
    assert sorted(map(sorted, sets.classes())) == [["a", "b", "c"], ["x", "y"]]
    top = {m: t for t, ms in lookalike_classes({"А": 2, "Ａ": 1, "A": 9}) for m in ms}
    assert top["А"] == top["Ａ"] == "A"


def test_fields_with_nulls_repeats_and_clashing_columns(spark):
    schema = "record_sequence int, title string, authors string, text string, field_name string"
    rows = [(1, "сod", None, "x", "y"), (1, "сod", None, "x", "y"), (2, None, "Holm A", None, None), (3, "", "plain", None, None), (4, "plain", "plain", None, None)]
    df = spark.createDataFrame(rows + [(9, "cod " * 20, "Holm A", None, None)], schema)
    fitted = fit_rewriter(df, ["title", "authors"])
    got = sorted(map(tuple, affected_fields(df, "record_sequence", ["title", "authors"], fitted).collect()))
    assert got == [(1, "title"), (2, "authors")]
    clean = df.select(rewritten(F.col("title"), fitted).alias("t")).where("record_sequence = 1").distinct().collect()
    assert [r.t for r in clean] == ["cod"]
    empty = spark.createDataFrame([], T._parse_datatype_string(schema))
    assert affected_fields(empty, "record_sequence", ["title", "authors"], fit_rewriter(empty, ["title", "authors"])).count() == 0


def test_statistics_count_all_rows(spark):
    df = spark.createDataFrame([("ab",), (None,), ("áb",)], "t string")
    counts = {r.token: r.n for r in token_statistics(df, ["t"]).collect()}
    assert counts["a"] == 2 and counts["b"] == 2 and counts["á"] == 1
    assert unicodedata.normalize("NFC", "á") == "á"


def test_plain_member_wins_at_any_count():
    composed, apart = "\u00e5", "a\u030a"
    for scale in (1, 1_000, 1_000_000):
        top = {m: t for t, ms in lookalike_classes({composed: 2 * scale, apart: 5 * scale, "A": scale, "\u0410": 9 * scale, "\ufb01": 3 * scale}) for m in ms}
        assert top[apart] == composed and top["\u0410"] == "A" and top["\ufb01"] == "fi"


def test_stacked_marks_are_counted_in_pairs_and_compose():
    from skerry.llm.lookalikes import marked_letters

    assert marked_letters("ế") == ["ê", "ế"]
    assert all(len(x) == 2 for x in marked_letters("e" + "́̂̃" * 400))
    counts = {t: 1 for text in ("ế", "ệ") for t in (*text, *marked_letters(text))}
    plain = Rewriter(lookalike_classes(counts))
    assert plain("ế") == "ế" and plain("ệ") == "ệ"
