import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from skerry.llm import names
from skerry.llm.components import connected_components
from skerry.llm.leakage import best_run, leaked_items, plain_words
from skerry.llm.names import align_given, align_organisations, entities, organisation_keys, organisation_tokens, read_name, spelling_pairs, spellings
from skerry.llm.packing import differencing, exchange, pack_block, packed, settle, token_counts
from skerry.llm.residue import residue, residue_kinds
from skerry.llm.truncation import Endings, fit_endings, length_rows, significant_lengths, truncated

NOUNS = "salmon lice feed cage growth light trial water oxygen smolt".split()


def sentence(rng):
    return f"{'Later on, ' * (rng.random() < 0.5)}{' '.join(rng.choices(NOUNS, k=rng.randint(0, 12)))}, the {rng.choice(NOUNS)} in the {rng.choice(NOUNS)} changed the {rng.choice(NOUNS)} by {rng.randint(10, 99)} percent."


def empty(spark, ddl):
    return spark.createDataFrame([], T._parse_datatype_string(ddl))


# problem 1


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        text = " ".join(sentence(rng) for _ in range(rng.randint(2, 9)))
        source = "cut" if i % 3 == 0 else "whole"
        if source == "cut" and len(text) > 200:
            text = text[:200]
        rows.append((i, source, text, text, None))
    rows += [(2000, "whole", None, None, "x"), (2001, "whole", " ", "", "x"), (2002, "whole", "The salmon in the cage chan...", None, "x"), (2003, "whole", rows[1][2].rstrip("."), None, "x"), (2004, "whole", rows[1][2] + " Keywords: lice, feed", None, None)]
    rows.append((2005, "whole", rows[1][2] + " The oxygen in the", None, None))
    return spark.createDataFrame(rows, "record_sequence int, source_file string, abstract string, abstract_raw string, reason string")


def test_limits_are_significant_lengths_only(records):
    found = {(r.source_file, r.length) for r in significant_lengths(length_rows(records)).where("measure = 'raw_chars'").collect()}
    assert found == {("cut", 200)}


def test_cut_records_and_reasons(records):
    got = {r.record_sequence: r.reason for r in truncated(records).collect()}
    want = {r.record_sequence for r in records.where("source_file = 'cut' and length(abstract) = 200 and trim(abstract) not like '%.'").collect()}
    assert {k for k, v in got.items() if v == "limit"} == want
    assert {k: v for k, v in got.items() if k >= 2000} == {2002: "mark", 2005: "ending"}


def test_no_records_and_long_ones(spark):
    ddl = "record_sequence int, source_file string, abstract string, abstract_raw string"
    assert truncated(empty(spark, ddl)).count() == 0
    long = spark.createDataFrame([(1, None, "fish " * 50_000 + "…", None), (1, None, "fish " * 50_000 + "…", None)], ddl)
    assert [r.reason for r in truncated(long).collect()] == ["mark"] * 2


def test_endings_model():
    rng = random.Random(2)
    model = fit_endings([" ".join(sentence(rng) for _ in range(6)) for _ in range(150)])
    assert model.score("lice cage, the feed in the water changed the light by 44 percent") > 0 > model.score("lice cage, the feed in the water changed the lig")
    assert isinstance(fit_endings([]), Endings)


# problem 6


def test_readings():
    assert read_name("de la Mar, Anna B.") == [("delamar", "anna b")]
    assert read_name("Mar, Anna de la") == [("delamar", "anna")]
    assert read_name("Berg KEL") == [("berg", "k e l")]
    assert read_name("K.-E. Berg") == [("berg", "k e")]
    assert read_name('Berg, Samuel "Sam"') == [("berg", "samuel")]
    assert read_name("Anna van Berg") == [("vanberg", "anna")]
    assert ("berg", "anna") in read_name("Anna Berg") and ("berg", "anna") in read_name("Berg Anna")


def test_alignment():
    assert align_given("samuel b", "s b") < 1 and align_given("sam", "samuel") < 1 and align_given("grgory", "gregory") < 1
    assert align_given("anna", "astrid") > 1 and align_given("robert m", "m") > 1 and align_given("a b", "a c") > 1
    a = " ".join(organisation_tokens("Office of Food and Markets Lund"))
    assert align_organisations(a, " ".join(organisation_tokens("Off. Food & Mkts. Lund"))) < 2
    assert align_organisations(a, " ".join(organisation_tokens("Office of Fish Health Lund"))) > 2


def test_spellings_are_linked(spark):
    same = [["Holm, Samuel B.", "S. B. Holm", "Holm SB", "Samuel Holm", "Sam Holm", "HOLM, SAMUEL B.", "Hoolm, Samuel"], ["Holm, Anna", "Anna Holm", "Holm A"], ["Office of Food and Markets Lundvik", "Off. Food & Mkts. Lundvik", "Office of Food and Markets, Lundvik", "Lundvik Office of Food and Markets"], ["Office of Fish Health Lundvik"], ["Bergström, Åsa", "Bergstrom, Asa"]]
    rows = [(" | ".join(g), None, "n") for g in same for _ in range(2)] + [("Holm, Samuel B.",) + (None, "n")] * 5 + [(None, "x", "n"), ("", "x", "n")]
    df = spark.createDataFrame(rows, "authors string, name string, entity string")
    got = {tuple(r) for r in spelling_pairs(entities(spellings(df, "authors"))).collect()}
    assert got == {(a, b) for g in same for a in g for b in g if a < b}
    assert entities(empty(spark, "name string, n bigint")).count() == 0


def test_no_link_that_aligns_is_left_out(spark):
    """Against all pairs: each name's parent is the best of higher rank that aligns with it."""
    rows = [("Holm, James Alan", 5), ("Holm, John Adam", 2), ("Holm, J. Adam", 1), ("Berg, Karl Olaf", 1), ("Berg, Karl Oskar", 1), ("Berg, K. Olaf", 1), ("Berg, K. Oskra", 1), ("Lind, P. Eva", 3), ("Lind, P. Ena", 3)]
    rows += [("Institute of Marine Research", 4), ("Inst. for Mar. Res.", 1), ("Centre for Salmon Laboratory", 4), ("Ctr. for Salmon Lab.", 1), ("Office of Food and Markets Aldvik", 3), ("Office of Food and Markets Baldvik", 1), ("Office of Ofod and Amrkets Laboratory", 1), ("Office of Food and Markets Laboratory", 2)]
    got = {tuple(r) for r in spelling_pairs(entities(spark.createDataFrame(rows, "name string, n bigint"))).collect()}
    same = [{"Holm, John Adam", "Holm, J. Adam"}, {"Berg, Karl Olaf", "Berg, K. Olaf"}, {"Berg, Karl Oskar", "Berg, K. Oskra"}, {"Lind, P. Eva", "Lind, P. Ena"}, {"Institute of Marine Research", "Inst. for Mar. Res."}, {"Centre for Salmon Laboratory", "Ctr. for Salmon Lab."}]
    same += [{"Office of Food and Markets Aldvik", "Office of Food and Markets Baldvik"}, {"Office of Ofod and Amrkets Laboratory", "Office of Food and Markets Laboratory"}]
    assert got == {(a, b) for g in same for a in g for b in g if a < b}


def test_keys_meet_wherever_names_align():
    rng = random.Random(12)

    def slip(w: str) -> str:
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "q" + w[i:], w[:i] + "q" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :], w[:3], w])

    words = "office institute marine research bergen food markets laboratory oslo health".split()
    for _ in range(3000):
        a = rng.sample(words, rng.randint(2, 8))
        b = [slip(w) if rng.random() < 0.5 else w for w in rng.sample(a, len(a))]
        if align_organisations(" ".join(a), " ".join(b)) < 2:
            assert set(organisation_keys(" ".join(a))) & set(organisation_keys(" ".join(b))), (a, b)


def test_exploded_keys_are_never_broadcast(spark):
    df = spark.createDataFrame([("Holm, Anna", 2), ("Holm, A.", 1)], "name string, n bigint")
    before, plans = connected_components, []
    try:
        names.connected_components = lambda links: plans.append(links._jdf.queryExecution().executedPlan().toString()) or before(links)
        entities(df)
    finally:
        names.connected_components = before
    assert plans and not re.search(r"BroadcastHashJoin \[key", plans[0])


# problem 7


def best_fit(sizes, capacity):
    """The plain method, to compare with: the largest items first, each where it leaves the least room."""
    out, room = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fits = [(r, w) for w, r in enumerate(room) if r >= sizes[i]]
        w = min(fits)[1] if fits else len(out)
        if not fits:
            out.append([])
            room.append(capacity)
        out[w].append(i)
        room[w] -= sizes[i]
    return out


def test_differencing_keeps_every_item_and_balances():
    rng = random.Random(3)
    for _ in range(60):
        sizes = [rng.randint(0, 50) for _ in range(rng.randint(0, 40))]
        k = rng.randint(1, 12)
        windows = differencing(sizes, k)
        assert len(windows) == k and sorted(i for w in windows for i in w) == list(range(len(sizes)))
        sums = [sum(sizes[i] for i in w) for w in windows]
        assert max(sums, default=0) - min(sums, default=0) <= max(sizes, default=0)
        for pack in (pack_block(sizes, 60), best_fit(sizes, 60)):
            assert sorted(i for w in pack for i in w) == list(range(len(sizes))) and all(sum(sizes[i] for i in w) <= 60 for w in pack)


def test_packing_tables(spark):
    rng = random.Random(4)
    counts = spark.createDataFrame([(i, rng.randint(0, 90), "x") for i in range(300)] + [(900, 1000, "x"), (901, None, "x"), (902, 100, "x"), (902, 100, "x")], "doc_id bigint, n_tokens int, container_id string")
    caps = spark.createDataFrame([(1, 100), (2, 256), (2, 256), (3, None), (4, 0)], "capacity_id int, capacity_tokens int")
    rows = packed(counts, caps, block_items=50).collect()
    assert {r.capacity_id for r in rows} == {1, 2}
    for cap in (100, 256):
        mine = [r for r in rows if r.capacity_tokens == cap]
        assert sum(r.piece_tokens for r in mine) == sum(r.n_tokens or 0 for r in counts.collect())
        fill = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.piece_tokens
        assert max(fill.values()) <= cap
        assert all(fill[r.container_id] == r.container_tokens for r in mine if r.doc_id != 902)
        assert len({r.doc_id for r in mine}) == 303 and {r.doc_id for r in mine if r.piece_no > 1} <= {900}
    assert packed(counts.limit(0), caps).count() == 0 and packed(counts, caps.limit(0)).count() == 0


def test_token_counts(spark):
    got = {r.doc_id: r.n_tokens for r in token_counts(spark.createDataFrame([(1, "salmon in the sea"), (2, ""), (3, None), (4, "fish " * 20_000)], "doc_id bigint, text string")).collect()}
    assert got[1] > 3 and got[2] == got[3] == 0 and got[4] >= 20_000


# problem 8


def test_leaks(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghiklmnoprst") for _ in range(6)) for _ in range(400)]
    passages = [" ".join(rng.choice(vocab) for _ in range(40)) for _ in range(6)]
    shared = "Read the passage below and answer the question that follows it with great care today."
    items = spark.createDataFrame([(i, f"{shared}\n{p}.", "a") for i, p in enumerate(passages)] + [(77, None, "a"), (78, "", "a")], "item_id bigint, text string, doc_id string")
    w = [p.split() for p in passages]
    changed = w[1][:30]
    changed[7], changed[16] = "zzz", changed[16][:-1] + "q"
    filler = lambda n: " ".join("x" + rng.choice(vocab) for _ in range(n))
    docs = [
        (1, f"{filler(50)} <b>{' '.join(w[0][:20]).upper()}</b> {filler(9)}"),
        (2, f"{filler(3)} {', '.join(changed)} {filler(2000)}"),
        (3, f"{filler(30)} {' '.join(w[2][:11])} {filler(30)}"),
        (4, f"{shared} {filler(40)}"),
        (5, f"{' '.join(w[3][5:25])}. {filler(5)} {' '.join(w[4])}"),
        (5, f"{' '.join(w[3][5:25])}. {filler(5)} {' '.join(w[4])}"),
        (6, None),
        (7, ""),
        (8, f"{filler(30_000)} {' '.join(w[5][10:32])}"),
    ]
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, item_id int"), items).collect()}
    assert got == {(1, 0), (2, 1), (5, 3), (5, 4), (8, 5)}
    assert leaked_items(empty(spark, "doc_id bigint, text string"), items).count() == 0
    assert leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), items.limit(0)).count() == 0


def test_runs():
    a = "a b c d e f g h i j k l m n o p".split()
    assert best_run(a, a, [(0, 0)]) == (16, 16)
    b = a[:8] + ["x"] + a[8:]
    assert best_run(a, b, [(0, 0)])[1] == 16
    assert plain_words("A&nbsp;fin-\ngerling <i>x</i>") == ["a", "fin", "gerling", "x"]


# problem 9

RESIDUE = [
    "Growth at {{ site_name }} was high.", "Growth at ${site} was high.", "The [INSERT DATE] trial", "[TODO: add value]", "Dear [FIRST NAME], hello", "See [[table 2 here]] for it", "<Enter project title>", "%TITLE% by %AUTHOR%",
    "Made by __COMPANY__ today", "##HEADLINE##", "<<FARM>> grew", "«Title» «Summary»", "{% block summary %}", "<%= region %>", "Lorem ipsum dolor sit amet", "Your text goes here.", "xxxxx xxxx xxx xxxx.",
    "404 Not Found", "HTTP Status 500", "Internal Server Error", "Access denied. You cannot read this.", "Please enable JavaScript to view this page.", "Fish grew. This content requires cookies to display.", "Page introuvable", "Insert methods paragraph here.", "Traceback (most recent call last):\n x",
]
CLEAN = [
    "We write the pen set as {a, b, c} and the site set as {1, ..., 8}.", "Costs rose from $A to $B per kg.", "Dates in brackets [spring, 2010] refer to stocking.", "A template of 54 questions was filled in.", "The page limit was not found to affect replies.",
    "The counter is a JavaScript tool that staff found easy.", "78 percent returned error 404 and were replaced.", "Access denied to inspectors was a common complaint.", "Placeholder pens were moored.", "A trial [in press] of <i>Salmo</i>", "Write `{{ name }}` where the name belongs, as the tutorial says; the rest of the text is about fish in pens and their feed.", "", "n = 404 Not a fish",
]


@pytest.mark.parametrize("text", RESIDUE)
def test_residue_is_found(text):
    assert residue_kinds(text)


@pytest.mark.parametrize("text", CLEAN)
def test_texts_about_it_are_clean(text):
    assert not residue_kinds(text)


def test_residue_table(spark):
    filler = ["Lorem ipsum vastor neris cundo lares.", "Lorem vastor neris cundo lares alia.", "Ipsum neris cundo lares alia vastor."]
    rows = [(i, f) for i, f in enumerate(filler)] + [(10, "Vastor neris cundo lares vastor alia."), (11, "Fish grow in the sea and eat feed."), (12, None), (13, ""), (14, "fish " * 30_000 + "{{ x }}"), (14, "fish " * 30_000 + "{{ x }}")]
    got = sorted(r.doc_id for r in residue(spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, kinds string")).collect())
    assert got == [0, 1, 2, 10, 14, 14]
    assert residue(empty(spark, "doc_id bigint, text string")).count() == 0


def test_windows_of_few_items_are_nearly_as_few_as_by_best_fit():
    rng = random.Random(11)
    sizes = [min(511, max(1, int(rng.lognormvariate(5.2, 0.7)))) for _ in range(1500)]
    windows = pack_block(sizes, 512)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert max(sum(sizes[i] for i in w) for w in windows) <= 512
    assert len(windows) <= 1.01 * len(best_fit(sizes, 512))


def test_exchange_and_settle_lose_nothing():
    rng = random.Random(12)
    for _ in range(50):
        sizes = sorted((rng.randint(1, 60) for _ in range(rng.randint(2, 40))), reverse=True)
        k = max(1, -(-sum(sizes) // 60))
        windows = differencing(sizes, k, sum(2 * s > 60 for s in sizes) if sum(2 * s > 60 for s in sizes) <= k else 0)
        trial = [list(w) for w in windows]
        if exchange(np.array(sizes), trial, 60):
            assert max(sum(sizes[i] for i in w) for w in trial) <= 60
        assert sorted(i for w in trial for i in w) == list(range(len(sizes)))
        done, left = settle(sizes, [list(w) for w in windows], 60, 2)
        assert sorted([i for w in done for i in w] + left) == list(range(len(sizes)))
        assert all(58 <= sum(sizes[i] for i in w) <= 60 for w in done)


@pytest.mark.parametrize("n, changed", [(15, 2), (16, 2), (18, 2), (40, 5)])
def test_short_leaks_with_changed_words(spark, n, changed):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(60)) + ".") for i in range(40)]
    docs, want = [], set()
    for d in range(60):
        i = rng.randrange(40)
        source = items[i][1].rstrip(".").split()
        at = rng.randrange(60 - n + 1)
        part = source[at : at + n]
        for e in range(1, changed + 1):
            part[e * n // (changed + 1)] = "changed"
        body = [rng.choice(words) for _ in range(rng.choice((20, 400, 2000, 11_000)))]
        cut = rng.randrange(len(body))
        docs.append((d, " ".join(body[:cut] + part + body[cut:])))
        want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == want


def test_blocks_of_items_give_the_same_leaks(spark, monkeypatch):
    from skerry.llm import leakage

    rng = random.Random(4)
    words = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30)) + ". This stock sentence stands in all of the items and says nothing about any of them at all.") for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(50)) + " " + items[i][1][:150]) for i in range(12)]
    sides = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    one = sorted(map(tuple, leaked_items(*sides).collect()))
    monkeypatch.setattr(leakage, "BLOCK", 5)
    assert sorted(map(tuple, leaked_items(*sides).collect())) == one and [r[:2] for r in one] == [(i, i) for i in range(12)]


def test_tail_of_the_binomial():
    from fractions import Fraction
    from math import comb

    from skerry.llm.truncation import hash_below, upper_tail

    for n, r, p in [(5, 20, 0.1), (3, 10, 0.25), (250, 1000, 0.2), (900, 2000, 0.4), (1, 5, 0.01), (20, 20, 0.5)]:
        q = Fraction(round(p * 100), 100)
        exact = float(sum(comb(r, i) * q**i * (1 - q) ** (r - i) for i in range(n, r + 1)))
        assert abs(upper_tail(np.array([n]), np.array([r]), np.array([p]))[0] / exact - 1) < 1e-8
    assert upper_tail(np.array([2]), np.array([100]), np.array([0.5]))[0] == 1
    spread = upper_tail(np.array([60_000_000]), np.array([10**9]), np.array([0.0599]))[0]
    assert 0 < spread < 1e-10
    # a sample of 4,000 of five billion rows takes its share of the hashes
    share = 4_000 / 5e9
    assert abs((hash_below(share) + 2**63) / 2**64 / share - 1) < 1e-6 and hash_below(1.0) == 2**63 - 1


def test_grammars_of_formats_and_sheets():
    from skerry.llm.residue import residue_kinds

    assert residue_kinds("Growth of %(year)d fish from %s week six") == ["printf"]
    assert residue_kinds("At the site #REF! and more") == ["sheet"]
    assert residue_kinds("Growth rose by 5 %s and 100%s, 40 % in all; #4 in a list") == []
    assert residue_kinds("The proxy did not respond in time.") == ["status"]


def test_common_words_are_no_filler(spark):
    from skerry.llm.residue import filler_vocabulary

    rows = [(i, "Lorem ipsum velit sanit the cage. The cage was cleaned.") for i in range(5)] + [(10 + i, "The cage was cleaned in spring.") for i in range(40)]
    assert filler_vocabulary(spark.createDataFrame(rows, "doc_id bigint, text string")) == ["ipsum", "lorem", "sanit", "velit"]
    assert filler_vocabulary(spark.createDataFrame(rows[5:], "doc_id bigint, text string")) == []
