"""One consistent form for text that looks the same but has other characters (problem 2).

Look-alike *classes* are found by union-find over code points and short strings: width and
ligature forms, composed and decomposed accents, blanks, invisible characters (the class of
the empty string) and letters of other scripts with the shape of Latin ones.  A plain
member (ASCII, composed) represents its class; among several the most frequent over all rows does.  Text is
rewritten greedily, longest match first, with one Aho-Corasick automaton over all other members, until
nothing changes.

Letters of another script are rewritten only in words that also hold Latin letters, or whose
letters all have Latin shapes in a field without other words of that script; a single Greek
letter standing alone is a symbol.  Typographic dashes, hyphens, quotes, tabs and line breaks
are left as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skerry.functions.arrow import map_lists

# Letters of other scripts beside the Latin letter of the same shape.
SHAPES = """
А A  В B  Е E  К K  М M  Н H  О O  Р P  С C  Т T  У Y  Х X  І I  Ѕ S  Ј J  Ԛ Q  Ԝ W  Ѵ V  Ү Y
а a  е e  о o  р p  с c  у y  х x  і i  ѕ s  ј j  ԛ q  ԝ w  ѵ v  һ h  ԁ d  ӏ l
Α A  Β B  Ε E  Ζ Z  Η H  Ι I  Κ K  Μ M  Ν N  Ο O  Ρ P  Τ T  Υ Y  Χ X
ο o  ν v  ι i  ρ p  υ u  χ x  κ k  ϲ c  ϳ j
Օ O  օ o  ս u  հ h  ո n
ɑ a  ɡ g
"""
# Characters without a look of their own beside those of category Cf.
UNSEEN = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)]
#: Compatibility forms that are the same letters in another dress.
FORMS = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>")
#: Strings counted for the frequency of what a ligature stands for.
LIGATURES = ("ff", "fi", "fl", "ffi", "ffl", "st")

_SEQUENCE = re.compile(r"[^\W\d_][\u0300-\u036f]+")
_STATS = "token string, n bigint"


def shape_pairs() -> list[tuple[str, str]]:
    flat = SHAPES.split()
    return list(zip(flat[::2], flat[1::2], strict=True))


def marked_letters(sequence: str) -> list[str]:
    """Each mark of a letter with several beside the letter composed so far: pairs of one letter and one mark,
    of which there are no more than Unicode has, however marks are stacked."""
    out, letter = [], unicodedata.normalize("NFKC", sequence[0])[-1]
    for mark in sequence[1:]:
        out.append(letter + mark)
        composed = unicodedata.normalize("NFC", letter + mark)
        letter = composed if len(composed) == 1 else letter
    return out


def token_statistics(df: DataFrame, columns: list[str]) -> DataFrame:
    """``token, n``: every code point, letter with a combining mark and ligature spelling of the
    columns with its number of occurrences over all rows, and the number of code points in all
    as the count of the empty string.  NULLs count nothing."""

    def count(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        n: Counter[str] = Counter()
        for batch in batches:
            for values in batch:
                text = "\n".join(x for x in values if x is not None)
                n.update(text)
                n[""] += len(text)
                if not text.isascii():
                    n.update(x for found in _SEQUENCE.findall(text) for x in marked_letters(found))
                for x in LIGATURES:
                    n[x] += text.count(x)
        yield list(n.items())

    return map_lists(df.select(*columns), count, _STATS).groupBy("token").agg(F.sum("n").cast("bigint").alias("n"))


class UnionFind:
    """Disjoint sets of strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def union(self, a: str, b: str) -> None:
        self.parent[self.find(a)] = self.find(b)

    def classes(self) -> list[list[str]]:
        out: dict[str, list[str]] = {}
        for x in self.parent:
            out.setdefault(self.find(x), []).append(x)
        return list(out.values())


def _plain(token: str) -> str | None:
    """What plainly typed text has for this look, by the character's own properties."""
    if len(token) > 1:
        composed = unicodedata.normalize("NFC", token)
        return composed if composed != token else None
    kind = unicodedata.category(token)
    if kind == "Cf" or ord(token) in UNSEEN:
        return ""
    if kind == "Zs":
        return " " if token != " " else None
    form = unicodedata.decomposition(token)
    if form.startswith(FORMS) and (kind[0] in "LN" or form.startswith("<wide>")) and kind != "No":
        return unicodedata.normalize("NFKC", token)
    if form and form[0] != "<" and len(form.split()) == 1:
        return unicodedata.normalize("NFC", token)
    return None


def lookalike_classes(counts: dict[str, int]) -> list[tuple[str, list[str]]]:
    """Classes of the counted tokens: representative (a plain form where there is one, whatever the counts;
    of several ASCII before others, then the most frequent; ties: the smaller string) and the other members."""
    sets = UnionFind()
    plain: set[str] = {"", " "}
    other_looks: set[str] = set()
    for token in counts:
        if token and (to := _plain(token)) is not None and to != token:
            sets.union(token, to)
            plain.add(to)
            other_looks.add(token)
    for other, latin in shape_pairs():
        sets.union(other, latin)
        plain.add(latin)
        other_looks.add(other)
    plain -= other_looks
    out = []
    for members in sets.classes():
        top = min(members, key=lambda x: (x not in plain, not x.isascii(), -counts.get(x, 0), len(x), x))
        out.append((top, sorted(x for x in members if x != top)))
    return sorted(out)


def _script(c: str) -> str:
    if c < "ɐ":
        return "LATIN"
    name = unicodedata.name(c, "")
    return "LATIN" if name.startswith(("LATIN", "FULLWIDTH LATIN")) else name.split(" ")[0]


class Rewriter:
    """Rewrites text to the representatives of its look-alike classes."""

    def __init__(self, classes: list[tuple[str, list[str]]]) -> None:
        self.to = {m: top for top, members in classes for m in members}
        self.to.pop("", None)
        self.shaped = {m for m, top in self.to.items() if len(m) == 1 and len(top) == 1 and m.isalpha() and top.isalpha() and _script(m) != "LATIN"}
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def _matches(self, text: str) -> list[tuple[int, str]]:
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for m in self.to:
                self._automaton.add_word(m, m)
            self._automaton.make_automaton()
        return [(end - len(m) + 1, m) for end, m in self._automaton.iter_long(text)]

    def _foreign(self, text: str, at: int) -> bool:
        """The letter at ``at`` belongs to a word of its own script, or is a symbol."""
        a = b = at
        inside = lambda c: c.isalpha() or unicodedata.category(c) in ("Mn", "Cf")
        while a and inside(text[a - 1]):
            a -= 1
        while b < len(text) and inside(text[b]):
            b += 1
        letters = [c for c in text[a:b] if c.isalpha()]
        script = _script(text[at])
        if any(_script(c) == "LATIN" for c in letters):
            return False
        if len(letters) == 1 and script == "GREEK":
            return True
        return any(c.isalpha() and c not in self.shaped and _script(c) == script for c in text) or not any(_script(c) == "LATIN" for c in text if c.isalpha())

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        while True:  # a representative is never rewritten, so every pass leaves fewer members to rewrite
            out, at = [], 0
            for start, m in self._matches(text):
                if m in self.shaped and self._foreign(text, start):
                    continue
                out += [text[at:start], self.to[m]]
                at = start + len(m)
            if not out:
                break
            text = "".join(out) + text[at:]
        return text


def fit_rewriter(df: DataFrame, columns: list[str]) -> Rewriter:
    """The rewriter for these columns, its representatives chosen by their counts over all rows.

    What reaches the driver is one row per distinct code point or short string, at most the
    size of Unicode's tables however many rows there are."""
    return Rewriter(lookalike_classes({r["token"]: r["n"] for r in token_statistics(df, columns).collect()}))


def rewritten(col: Column, rewriter: Rewriter) -> Column:
    """The column in one consistent form; NULL stays NULL.  Plain ASCII never leaves the JVM's
    side unread: it is passed through as it is."""

    @F.pandas_udf(T.StringType())
    def rewrite(s: pd.Series) -> pd.Series:
        return s.map(rewriter, na_action="ignore")

    return F.when(col.rlike(r"[^\x00-\x7F]"), rewrite(col)).otherwise(col)


def affected_fields(df: DataFrame, key: str, columns: list[str], rewriter: Rewriter) -> DataFrame:
    """``key, field_name`` of each field that the rewriter changes.

    NULL, empty and plain fields give no row; a key with repeated rows gives one row a field."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in columns]))
    long = df.select(key, fields.alias("f")).select(key, "f.*").where(F.col("text").rlike(r"[^\x00-\x7F]"))
    return long.where(~rewritten(F.col("text"), rewriter).eqNullSafe(F.col("text"))).select(key, "field_name").distinct()
