import random
import re

import pytest

from pyspark.sql import types as T

from skerry.llm.components import connected_components
from skerry.llm.editdist import distance, probes, segments
from skerry.llm.history import History, _same_people, name_keys, publications, same_publication

SCHEMA = "record_sequence int, batch_no int, title string, authors string, doi string, abstract string, key string"
WORDS = "salmon lice feed cage growth light trial water oxygen smolt pen net fjord farm disease vaccine gill score wild stock".split()


def text(seed, n=6):
    rng = random.Random(seed)
    return ". ".join(" ".join(rng.choice(WORDS) for _ in range(9)) + f" {rng.randint(100, 999)}" for _ in range(n)) + "."


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_index_finds_every_string_within_the_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(4, 14)))
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            p = rng.randrange(len(b) + 1)
            b[p : p + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        b = "".join(b)
        for t in (1, 2, 3):
            if len(b) > t and len(a) > t and levenshtein(a, b) <= t:
                assert set(segments(a, t)) & set(probes(b, t))
                assert distance(a, b, t) <= t


def test_distance_counts_swaps_and_stops():
    assert distance("gregory", "grgeory", 1) == 1
    assert distance("abc", "xyz", 1) == 2
    assert distance("", "ab", 3) == 2


def test_batches_against_history(spark):
    a, b = text(1), text(2)
    lost = a.split(". ", 1)[1]
    rows = [
        (10, 0, "Light and growth in pens: a trial", "Berg, Anna", "10.1/a", a),
        (11, 0, "Other title", "Holm, O.", None, b),
        (20, 1, "LIGHT AND GROWTH IN PENS – A TRIAL", "Berg, Anna", "10.1/a", None),
        (21, 1, "Light and growth in pens", "A. Berg", None, lost),
        (22, 2, "Light and grwoth in pens: a trial [version 2]", "Bergg, Anna", "10.9/z", a.replace("oxygen", "oxigen", 1)),
        (23, 2, "Light and growth in pens. Part II: a trial", "Berg, Anna", "10.1/b", a),
        (24, 2, "Light and growth in pens: a trial", "Berg, Anna", "10.1/c", text(3)),
        (25, 2, None, "Berg, Anna", "10.1/a", a),
        (26, None, "Light and growth in pens: a trial", "Berg, Anna", "10.1/a", a),
        (27, 3, "Other title", "Holm, O.", None, b),
        (27, 3, "Other title", "Holm, O.", None, b),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], SCHEMA)
    got = sorted({(r.record_sequence, r.first_sequence, r.first_batch) for r in publications(df).collect()})
    assert got == [(10, 10, 0), (11, 11, 0), (20, 10, 0), (21, 10, 0), (22, 10, 0), (23, 23, 2), (24, 24, 2), (27, 11, 0)]


def test_boilerplate_abstracts_need_near_titles(spark):
    note = "No abstract was supplied by the publisher of this record at all."
    rng = random.Random(5)
    made = ["".join(rng.choice("abdefgiklmnoprstuv") for _ in range(9)) for _ in range(500)]
    rows = [(i, i % 3, " ".join(made[i * 5 : i * 5 + 5]), f"{made[i * 5 + 400]}, A.", None, note, "k") for i in range(20)]
    rows += [(200, 0, "Deep water smolts under blue light", "Holm, O.", None, note, "k"), (201, 2, "Deep water smolt under blue light", "Holm, O.", None, note, "k")]
    got = publications(spark.createDataFrame(rows, SCHEMA), hot=5).where("first_sequence <> record_sequence").collect()
    assert [(r.first_sequence, r.record_sequence) for r in got] == [(200, 201)]


def test_empty_table(spark):
    assert publications(spark.createDataFrame([], T._parse_datatype_string(SCHEMA))).count() == 0


def test_components_of_chains_loops_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (1, 0), (300, 299)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {299: 299, 300: 299}
    assert connected_components(spark.createDataFrame([], T._parse_datatype_string("a int, b int"))).count() == 0


def test_rule():
    a = ("light growth pens|berg", "", "berg anna", "one two three four five\nsix seven eight nine ten")
    assert same_publication(a, a)
    assert not same_publication(a, ("light growth pens|berg", "ii", *a[2:]))
    assert not same_publication(a, (*a[:3], ""))


def test_one_shared_segment_is_enough(spark):
    a = "smolts grew faster in closed pens under green light than in open pens during the whole long winter season\nwild stock was sampled twice before the trial began and once after it had come to an end in spring".split("\n")
    b = [a[0].replace("closed", "clozed"), a[1].replace("wild", "wyld").replace("spring", "sprinng")]
    rows = [(1, 0, "Light and growth in pens", "Berg, Anna", None, ". ".join(a) + ".", "k"), (2, 1, "Light and growth in pens", "Berg, Anna", "10.1/b", ". ".join(b) + ".", "k")]
    got = publications(spark.createDataFrame(rows, SCHEMA)).where("first_sequence <> record_sequence").collect()
    assert [(r.first_sequence, r.record_sequence) for r in got] == [(1, 2)]


def test_boilerplate_abstracts_with_a_lost_subtitle(spark):
    note = "No abstract was supplied by the publisher of this record at all."
    title = "Deep water smolts under blue light"
    rng = random.Random(7)
    made = ["".join(rng.choice("abdefgiklmnoprstuv") for _ in range(9)) for _ in range(100)]
    rows = [(i, i % 3, " ".join(made[i * 4 : i * 4 + 4]), f"{made[i + 80]}, A.", None, note, "k") for i in range(20)]
    rows += [(200, 0, f"{title}: a long trial in the fjords of the far north", "Holm, O.", None, note, "k"), (201, 2, title, "Holm, O.", None, note, "k")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = publications(df, hot=5).where("first_sequence <> record_sequence").collect()
    assert [(r.first_sequence, r.record_sequence) for r in got] == [(200, 201)]


def result(df):
    return sorted((r.record_sequence, r.batch_no, r.first_sequence, r.first_batch) for r in df.collect())


def batches_of_records():
    rng = random.Random(13)
    rows = []
    for i in range(60):
        title = " ".join(rng.choice(WORDS) for _ in range(6)) + f" {i}"
        for k in range(rng.randint(1, 4)):
            body = text(i).replace("oxygen", "oxigen", 1) if k % 2 else text(i)
            rows.append((1000 * k + i, rng.randint(0, 2), title.upper() if k == 2 else title, f"Berg{i}, Anna", f"10.1/{i}" if k < 2 else None, body, "k"))
    return rows


def test_sessions_continue_one_history(spark, tmp_path):
    rows = batches_of_records()
    want = result(publications(spark.createDataFrame(rows, SCHEMA)))
    assert sum(r[0] != r[2] for r in want) > 30
    path = f"file://{tmp_path}/history"
    for batch in range(3):  # each batch is delivered to a session of its own
        history = History(spark.newSession(), path)
        assert history.deliver(spark.createDataFrame([r for r in rows if r[1] == batch], SCHEMA)) == [batch]
        history.accept([batch])
        history.verify()
    assert result(history.publications()) == want
    # a batch that failed before its last table was written is accepted again
    import shutil

    shutil.rmtree(tmp_path / "history" / "accepted" / "batch=2")
    shutil.rmtree(tmp_path / "history" / "links" / "batch=2")
    again = History(spark, path)
    assert again.waiting() == [2]
    again.accept([2])
    again.verify()
    assert result(again.publications()) == want


@pytest.mark.parametrize("hot", [1, 10_000])
def test_result_does_not_depend_on_what_counts_as_hot(spark, hot, monkeypatch):
    from skerry.llm import history

    monkeypatch.setattr(history, "CROWDED", 1)
    note = "No abstract was supplied by the publisher of this record at all."
    stock = [f"In this study we looked at salmon of many kinds {i}." for i in range(2)]
    rng = random.Random(17)
    rows = []
    for i in range(40):  # one stock title and abstract, many authors
        rows.append((i, i % 2, "Editorial of the journal", f"{rng.choice('BCDF')}{rng.choice('aeiou')}{rng.choice('lmnr')}{rng.choice('aeiou')}{i:03d}sen, A.", None, note, "k"))
    for i in range(40):
        title = " ".join(rng.choice(WORDS) for _ in range(7)) + f" {i}"
        body = f"{stock[i % 2]} {text(i, 2)}"
        rows += [(100 + i, 0, title + ": a long trial of the far north", f"Holm{i}, O.", None, body, "k"), (200 + i, 1, title, f"Hollm{i}, O.", None, f"{stock[i % 2]} {text(i, 1)}", "k")]
    rows += [(300, 1, "Editorial of the journal", None, None, note, "k"), (301, 1, "Editorial of the journal", "Ruud, Per", None, note, "k"), (302, 1, "Editorial of the jurnal", "Ruuud, Per", None, note, "k")]
    brute = {r[0]: r[0] for r in rows}
    from skerry.llm.history import contents
    from skerry.llm.lookalikes import Rewriter

    facts = contents(spark.createDataFrame(rows, SCHEMA), Rewriter([])).collect()

    def root(x):
        while brute[x] != x:
            x = brute[x]
        return x

    for a in facts:
        for b in facts:
            if a.record_sequence < b.record_sequence and same_publication((a.form, a.series, a.people, a.body), (b.form, b.series, b.people, b.body)):
                x, y = sorted((root(a.record_sequence), root(b.record_sequence)))
                brute[y] = x
    got = {r[0]: r[2] for r in result(publications(spark.createDataFrame(rows, SCHEMA), hot=hot))}
    assert got == {x: root(x) for x in brute}


def test_name_keys_lose_no_pair():
    rng = random.Random(19)
    for _ in range(4000):
        a, b = ("\n".join(" ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 2))) for _ in "ab")
        if _same_people(a, b):
            assert name_keys(a, True) & name_keys(b, False), (a, b)


def test_no_join_is_broadcast_by_the_size_of_its_files(spark, monkeypatch):
    """Files of a few MB hold a million record numbers, which as hash tables take the driver's memory: what is broadcast is counted."""
    from skerry.llm import components, history

    joins = []

    def note(df):
        joins.extend(x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if re.search(r"\bJoin (Inner|Left)", x))

    write = History._write
    monkeypatch.setattr(History, "_write", lambda self, df, *a: (note(df), write(self, df, *a))[1])
    for module in (history, components):
        monkeypatch.setattr(module, "materialize", lambda df, name, f=module.materialize: (note(df), f(df, name))[1])
    monkeypatch.setattr(history, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame(batches_of_records(), SCHEMA)
    got = publications(df, hot=1)
    note(got)
    assert len(joins) > 20 and [x for x in joins if "strategy=" not in x] == []
    monkeypatch.undo()
    assert result(got) == result(publications(df))
