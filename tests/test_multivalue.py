import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.operators.multivalue import authors_array, path_key, paths_array, split_authors, split_paths, split_to_rows


@pytest.mark.parametrize(
    "text, values",
    [
        ("Berg, Anna | Holm, O. P.", ["Berg, Anna", "Holm, O. P."]),
        ("Berg, Anna |  | Holm, O. |", ["Berg, Anna", "Holm, O."]),
        ("Berg A, Holm OP & de la Mar F", ["Berg A", "Holm OP", "de la Mar F"]),
        ("Berg, A., Holm, O. P. and de la Mar, F.", ["Berg, A.", "Holm, O. P.", "de la Mar, F."]),
        ("Berg, Anna; and Olav Holm", ["Berg, Anna", "Olav Holm"]),
        ('["Berg, Anna", "Holm, Olav \\"Ole\\""]', ["Berg, Anna", 'Holm, Olav "Ole"']),
        ('"Berg, Anna";Olav Holm;"Holm, Samuel ""Sam"""', ["Berg, Anna", "Olav Holm", 'Holm, Samuel "Sam"']),
        ('"Berg, Anna","Holm A"', ["Berg, Anna", "Holm A"]),
        ("Anna Berg / Holm, Olav\tMar, F.\nOle Dal", ["Anna Berg", "Holm, Olav", "Mar, F.", "Ole Dal"]),
        ("Office of Food and Markets Lund", ["Office of Food and Markets Lund"]),
        ("Off. Food & Mkts. Lund | Berg A", ["Off. Food & Mkts. Lund", "Berg A"]),
        ("Institute of Fish Health, Lund | Berg A", ["Institute of Fish Health, Lund", "Berg A"]),
        ("Anna Berg & Office of Feed and Nutrition Lund", ["Anna Berg", "Office of Feed and Nutrition Lund"]),
        ("NIMADEGA, PHILIP DE LA; BERG A", ["NIMADEGA, PHILIP DE LA", "BERG A"]),
        ("", []),
        (" | ;", []),
        (None, []),
        ("Anna Berg", ["Anna Berg"]),
    ],
)
def test_authors(text, values):
    assert split_authors(text) == values


def test_paths_with_delimiters_in_names():
    known = frozenset(map(path_key, ["Sea > Offshore; exposed > Cost | price", "Sea > Nets > Cost"]))
    assert split_paths("Sea > Offshore; exposed > Cost | price; Sea>Nets>Cost", known) == ["Sea > Offshore; exposed > Cost | price", "Sea>Nets>Cost"]
    assert split_paths('"Sea > Offshore; exposed > Cost | price" | Sea > Nets > Cost', known) == ["Sea > Offshore; exposed > Cost | price", "Sea > Nets > Cost"]
    assert split_paths('["Sea > Nets > Cost", "Sea > Nets > Cost"]', known) == ["Sea > Nets > Cost"] * 2
    assert split_paths("A > B > C > Treatment; other; D > E > F > G") == ["A > B > C > Treatment; other", "D > E > F > G"]


def test_rows_with_nulls_ties_empty_and_clashing_columns(spark):
    schema = "k int, authors string, pos string, item string"
    df = spark.createDataFrame([(1, "Berg, A.; Berg, A.", "x", None), (2, None, None, "y"), (3, "", "z", ""), (1, "Berg, A.; Berg, A.", "x", None), (4, "Ole Dal | " * 3000, None, None)], schema)
    rows = split_to_rows(df, "k", authors_array(F.col("authors")), "authors")
    assert rows.columns == ["field_name", "row_key", "pos", "item"]
    got = sorted(tuple(r) for r in rows.where("row_key < 4").collect())
    assert got == [("authors", 1, 1, "Berg, A.")] * 2 + [("authors", 1, 2, "Berg, A.")] * 2
    assert rows.where("row_key = 4").count() == 3000
    empty = spark.createDataFrame([], T._parse_datatype_string(schema))
    assert split_to_rows(empty, "k", paths_array(F.col("authors")), "f").count() == 0


@pytest.mark.parametrize(
    "text, values",
    [
        ("Institute (Bergen; Oslo); Holm, A.", ["Institute (Bergen; Oslo)", "Holm, A."]),
        ('[["Holm, A."; "Berg, B."], "Lund, C."]', ["Holm, A.", "Berg, B.", "Lund, C."]),
        (r"Holm\; Berg, A.; Lund, C.", ["Holm; Berg, A.", "Lund, C."]),
        ("Holm (A; Berg, B.", ["Holm (A", "Berg, B."]),
        ('{"Holm; A", "Berg, B."}', ["Holm; A", "Berg, B."]),
        ("Group ((a; b); [c; d]); Berg, B.", ["Group ((a; b); [c; d])", "Berg, B."]),
        ("[]; Berg, B.", ["Berg, B."]),
    ],
)
def test_depth_and_escapes_in_every_state(text, values):
    assert split_authors(text) == values


def test_long_paths_are_joined_up_to_the_longest_known_one():
    long = "; ".join(f"level {i}" for i in range(14))
    known = frozenset([path_key(long), path_key("short")])
    assert split_paths(f"{long}; short", known) == [long, "short"]
