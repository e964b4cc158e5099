"""Dictionary terms in text: exact character spans, token n-grams and the rules for overlaps.

Everything a text needs is computed in arrays on its own row, so finding and resolving spans
shuffles nothing; dictionaries are small literals."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.arrow import map_lists

#: Words with inner hyphens and apostrophes, or single other characters.
TOKEN = r"[\p{L}\p{N}]+(?:[-'’][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]"


def regex_escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\]\[{}()+*^$|\\?.\-])", r"\\$1")


def dictionary(rows: list[dict]) -> Column:
    """A small dictionary as a literal array of structs; every row needs ``term``."""
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])


def with_spans(df: DataFrame, text: Column, terms: Column, out: str, policy: str = "none") -> DataFrame:
    """``df`` with ``out``: the occurrences of dictionary terms in ``text`` that a policy keeps.

    Terms are found whatever the case between characters that are not ASCII letters, digits or "_"; a
    term's own occurrences do not overlap.  Each is ``start, end`` (from 1, inclusive, in code
    points), ``matched`` and the ``entry``, in the order (start, longer first, entry).

    Policies: ``containment`` - spans inside a strictly longer one are dropped; ``none``.  The greedy
    rules are in ``term_spans``.

    The steps are columns of their own, so that nothing is computed once per use.
    """
    t = F.coalesce(text, F.lit(""))
    pattern = lambda e: F.concat(F.lit("(?i)(?<![A-Za-z0-9_])"), regex_escape(e["term"]), F.lit("(?![A-Za-z0-9_])"))
    df = df.withColumn("_present", F.filter(terms, lambda e: F.contains(F.lower(t), F.lower(e["term"]))))
    df = df.withColumn("_hits", F.transform("_present", lambda e: F.struct(e.alias("entry"), F.transform(F.split(t, pattern(e), -1), lambda p: F.char_length(p)).alias("gaps"))))
    n = lambda h: F.char_length(h["entry"]["term"])

    def place(h: Column, i: Column) -> Column:
        start = F.aggregate(F.slice(h["gaps"], 1, i), F.lit(1), lambda acc, g: acc + g) + (i - 1) * n(h)
        return F.struct(start.alias("start"), (start + n(h) - 1).alias("end"), F.substring(t, start, n(h)).alias("matched"), h["entry"].alias("entry"))

    found = F.transform(F.filter("_hits", lambda h: F.size(h["gaps"]) > 1), lambda h: F.transform(F.sequence(F.lit(1), F.size(h["gaps"]) - 1), lambda i: place(h, i)))
    df = df.withColumn("_spans", F.flatten(found))
    ordered = F.transform("_spans", lambda s: F.struct(s["start"].alias("a"), (s["start"] - s["end"]).alias("b"), s["entry"].alias("c"), s.alias("s")))
    df = df.withColumn("_m", F.transform(F.array_sort(ordered), lambda k: k["s"]))
    return _resolved(df, out, policy).drop("_present", "_hits", "_spans", "_m")


def greedy_keep(starts: list[int], ends: list[int], strict: bool) -> list[int]:
    """Places kept of spans (ends exclusive) when each span still kept drops those that overlap it and are not longer (``strict``:
    that are shorter).  A span that is dropped later has dropped its victims all the same."""
    alive = [True] * len(starts)
    for i in range(len(starts)):
        if alive[i]:
            n = ends[i] - starts[i]
            for j in range(len(starts)):
                if j != i and alive[j] and starts[j] < ends[i] and ends[j] > starts[i]:
                    m = ends[j] - starts[j]
                    alive[j] = m >= n if strict else m > n
    return [i for i, ok in enumerate(alive) if ok]


def _resolved(df: DataFrame, out: str, policy: str) -> DataFrame:
    m = F.col("_m")
    length = lambda s: s["end"] - s["start"]
    if policy == "none":
        return df.withColumn(out, m)
    if policy == "containment":
        return df.withColumn(out, F.filter(m, lambda s: ~F.exists(m, lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (length(o) > length(s)))))
    raise ValueError(policy)


_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def lowered(text: str) -> str:
    """Lower case of the same length: letters whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class TermFinder:
    """Occurrences of many terms in one pass over a text, by one automaton."""

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def __call__(self, text: str) -> list[tuple[int, int, int]]:
        """``start, -end, term`` (its place in the list), sorted; a term's own occurrences do not overlap."""
        if self._automaton is None:
            import ahocorasick

            by_form: dict[str, list[int]] = {}
            for i, t in enumerate(self.terms):
                by_form.setdefault(lowered(t), []).append(i)
            self._automaton = ahocorasick.Automaton()
            for form, places in by_form.items():
                if form:
                    self._automaton.add_word(form, (len(form), places))
            self._automaton.make_automaton()
        if not len(self._automaton):
            return []
        out, last = [], {}
        for end, (n, places) in self._automaton.iter(lowered(text)):
            start, end = end - n + 1, end + 1
            if (start and text[start - 1] in _WORD) or (end < len(text) and text[end] in _WORD):
                continue
            for i in places:
                if start >= last.get(i, 0):
                    last[i] = end
                    out.append((start, -end, i))
        return sorted(out)


def term_spans(df: DataFrame, key: str, fields: list[str], terms: list[str], policy: str = "greedy") -> DataFrame:
    """``key, spans``: occurrences of the terms in the fields (``source, term`` (its place in ``terms``),
    ``start, end, matched``), as a policy keeps them.

    ``all`` keeps every one.  ``greedy``: in the order (start, longer first, term) each span still kept drops the
    others that overlap it and are not longer (``greedy_ties``: are shorter).  Terms are found whatever the case
    between characters that are not ASCII letters, digits or "_".  NULL and empty texts have no spans.

    One automaton finds all terms; the rule is a fold over the few spans of one text.  Both run in Arrow
    batches, nothing is shuffled.
    """
    finder = TermFinder(terms)

    def find(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for k, *texts in batches:
            out = []
            for row in zip(k, *texts, strict=True):
                spans = []
                for source, text in zip(fields, row[1:], strict=True):
                    if not text:
                        continue
                    found = finder(text)
                    kept = range(len(found)) if policy == "all" else greedy_keep([f[0] for f in found], [-f[1] for f in found], policy == "greedy_ties")
                    spans += [{"source": source, "term": found[j][2], "start": found[j][0] + 1, "end": -found[j][1], "matched": text[found[j][0] : -found[j][1]]} for j in kept]
                out.append((row[0], spans))
            yield out

    kind = dict(df.dtypes)[key]
    return map_lists(df.select(key, *fields), find, f"{key} {kind}, spans array<struct<source:string,term:int,start:int,end:int,matched:string>>")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def context(toks: Column, start: Column, length: Column, width: int) -> Column:
    """The tokens around a match, ``width`` on each side."""
    first = F.greatest(F.lit(1), start - width)
    return F.array_join(F.slice(toks, first, start + length + width - first), " ")
