"""Splitting fields that hold several values (problem 3).

A field is read by a quote-aware finite-state tokenizer.  Its states are *outside*,
*inside a quoted value* and *after a closing quote*.  Escapes (a backslash before a quote, bracket or
delimiter, doubled quotes) are known in every state, and brackets are tracked by a stack: one that opens at
the start of a value opens a list, whose values are split too, one inside a value belongs to it.  Only
delimiters outside quotes and outside brackets of a value end it; a bracket without a partner is a character
like any other.  Two small grammars settle what the delimiters leave open:

* ``authors`` - commas and "and"/"&" inside an unquoted stretch are read as person lists
  ("Family, Given", "Family AB", "Family, A. B."), organisations keep theirs;
* ``paths`` - stretches are joined until they form a known hierarchy path.

The tokenizer runs per row in an Arrow-batched UDF; positions come from ``posexplode``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTES = {'"': '"', "“": "”", "„": "“"}

# Words by which organisations are known, in full and shortened.
ORG_HEADS = frozenset(
    "office off research res station stn foundation found laboratory lab institute inst centre center ctr "
    "university univ college coll department dept agency council ministry school faculty society association "
    "group board authority directorate commission bureau academy museum hospital company consortium".split()
)
# Particles that belong to a family name.
PARTICLES = frozenset("de la le van von der den del della di da dos du el al bin ibn ten ter vander zu zur".split())

_INVISIBLE = re.compile(r"[­​-‏⁠﻿]")
_STRONG = re.compile(r"\|+|[;\n\t\r]|(?<=\s)/(?=\s)")
_WEAK = re.compile(r"\s*,\s*(?:and|AND|&)\s+|\s+(?:and|AND|&)\s+|\s*,\s*")
_LEAD = re.compile(r"\s*(?:and|AND|&)\s+")
_INITIALS = re.compile(r"(?:[^\W\d_]\.?[\s\-‐.]*){1,5}")
_OPEN_ORG = re.compile(r"(?:\b(?:of|for)|\b[\w.]+\.?)\s+[\w.]+$", re.I)


def _is_initials(piece: str) -> bool:
    s = _INVISIBLE.sub("", piece).strip()
    return bool(s) and bool(_INITIALS.fullmatch(s)) and s.upper() == s and len(re.sub(r"\W", "", s)) <= 4


def _words(piece: str) -> list[str]:
    return _INVISIBLE.sub("", piece).split()


def _is_short_form(words: list[str]) -> bool:
    """Family name followed by a block of initials: "Family AB"."""
    if len(words) < 2:
        return False
    last, capitals = words[-1].replace("-", ""), all(w.isupper() for w in words)
    if not (last.isalpha() and last.isupper()) or capitals and last.casefold() in PARTICLES:
        return False
    return len(last) <= (3 if capitals else 4)


def _is_org(words: list[str]) -> bool:
    low = [w.strip("().,").casefold() for w in words]
    return len(words) > 1 and (any(w in ORG_HEADS for w in low) or any(w in ("of", "for") for w in low[1:-1]) or low[-1] == "for")


def _is_family(words: list[str]) -> bool:
    """A family name on its own: one word, or particles before the last word."""
    if len(words) == 1:
        return True
    return len(words) <= 4 and all(w.casefold() in PARTICLES or (w[:1].islower() and len(w) <= 5) for w in words[:-1])


def split_people(text: str) -> list[str]:
    """Values of one unquoted stretch of an author field, commas and "and" read as a list of names."""
    if (lead := _LEAD.match(text)) and lead.end() < len(text):
        text = text[lead.end() :]
    cuts = list(_WEAK.finditer(text))
    if not cuts:
        return [text.strip()] if text.strip() else []
    spans, seps, at = [], [], 0
    for m in cuts:
        if text.count("(", at, m.start()) > text.count(")", at, m.start()):
            continue
        spans.append((at, m.start()))
        seps.append("," if "," in m.group() and not re.search(r"and|AND|&", m.group()) else "+")
        at = m.end()
    spans.append((at, len(text)))
    seps.append("")
    keep = [i for i, (a, b) in enumerate(spans) if text[a:b].strip()]
    spans, seps = [spans[i] for i in keep], [seps[i] for i in keep]
    words = [_words(text[a:b]) for a, b in spans]
    out, i, n = [], 0, len(spans)
    while i < n:
        a, b = spans[i]
        j = i
        if _is_org(words[i]):
            if seps[j] == "+" and j + 1 < n and _open_topic(words[i]):
                j += 1
            if seps[j] == "," and j + 1 < n and len(words[j + 1]) == 1 and not _is_initials(text[slice(*spans[j + 1])]):
                after = j + 2 < n and seps[j + 1] == "," and (_is_initials(text[slice(*spans[j + 2])]))
                if not after:
                    j += 1
        elif not _is_short_form(words[i]) and seps[i] == "," and i + 1 < n:
            nxt = text[slice(*spans[i + 1])]
            if _is_initials(nxt) or (_is_family(words[i]) and not _is_short_form(words[i + 1]) and len(words[i + 1]) <= 5 and not _is_org(words[i + 1])):
                j = i + 1
        out.append(text[a : spans[j][1]].strip())
        i = j + 1
    return [x for x in out if x]


def _open_topic(words: list[str]) -> bool:
    """The organisation's topic is still open: "Office of Food" before "and Markets"."""
    low = [w.strip("().,").casefold() for w in words]
    for k in ("of", "for"):
        if k in low:
            return low.index(k) == len(low) - 2
    heads = [i for i, w in enumerate(low) if w in ORG_HEADS]
    return bool(heads) and heads[-1] == len(low) - 2


_PAIRS = {"(": ")", "[": "]", "{": "}"}
_ESCAPED = frozenset("\\\"'“”„()[]{};,|/")
_SPECIAL = re.compile(r'["“„\\(\[{]')
_COMMA_QUOTE = re.compile(r',\s*"')
_DELIMITER = re.compile(r"\s*(?:,|;|\|+|/(?=\s))")
_LINE = re.compile(r"[ ]*[\n\t\r]")


def _partners(text: str) -> dict[int, int]:
    """Places of the brackets that have a partner, each with its partner's, outside quoted values and escapes."""
    out: dict[int, int] = {}
    stack: list[int] = []
    i, n, last = 0, len(text), ""
    while i < n:
        c = text[i]
        if c == "\\" and text[i + 1 : i + 2] in _ESCAPED:
            i += 2
            continue
        if c in QUOTES and not last.isalnum():
            close = text.find(QUOTES[c], i + 1)
            while close > 0 and (text[close - 1] == "\\" or not _ends(text, close + 1, n)):
                close = text.find(QUOTES[c], close + 1)
            if close > 0:
                i = close + 1
                continue
        if c in _PAIRS:
            stack.append(i)
        elif c in ")]}":
            for k in range(len(stack) - 1, -1, -1):
                if _PAIRS[text[stack[k]]] == c:
                    out[stack[k]], out[i] = i, stack[k]
                    del stack[k:]
                    break
        if not c.isspace():
            last = c
        i += 1
    return out


def tokenize(text: str) -> list[tuple[str, bool]]:
    """Stretches between delimiters outside quotes and brackets, each with whether it was quoted.

    A quote opens a value only at its start; it closes only before a delimiter, a closing
    bracket or the end, so quotes inside a name stay part of it.
    """
    if not _SPECIAL.search(text):
        return [(x, False) for x in _STRONG.split(text)]
    partner = _partners(text)
    out: list[tuple[str, bool]] = []
    i, n = 0, len(text)
    lists: list[int] = []  # ends of the lists that are open
    inner = 0  # end of the bracket inside the value that is open
    start, cut = 0, []  # of the value read now, and the backslashes in it that only escape
    fresh = True  # nothing of the value has been read

    def give(end: int) -> None:
        nonlocal cut
        out.append(("".join(text[a + 1 : b] for a, b in zip([start - 1, *cut], [*cut, end], strict=True)), False))
        cut = []

    while i < n:
        c = text[i]
        if lists and i == lists[-1]:
            give(i)
            lists.pop()
            m = _DELIMITER.match(text, i + 1) or _LINE.match(text, i + 1)
            i = start = m.end() if m else i + 1
            fresh = True
            continue
        if c == "\\" and i + 1 < n and text[i + 1] in _ESCAPED and text[i + 1] != "\\":
            cut.append(i)
            i, fresh = i + 2, False
            continue
        if fresh and c in QUOTES:
            end = lists[-1] if lists else n
            close, j, buf = QUOTES[c], i + 1, []
            while j < end:
                c = text[j]
                if c == "\\" and j + 1 < end and text[j + 1] in "\"'\\“”":
                    buf.append(text[j + 1])
                    j += 2
                elif c == close:
                    if text[j + 1 : j + 2] == close and close == '"' and not _closes(text, j + 1, end, len(buf)):
                        buf.append(c)
                        j += 2
                    elif text[j + 1 : j + 3] == close * 2 and close == '"':
                        buf.append(c)
                        j += 2
                    elif _ends(text, j + 1, end):
                        break
                    else:
                        buf.append(c)
                        j += 1
                else:
                    buf.append(c)
                    j += 1
            out.append(("".join(buf), True))
            i = j + 1
            m = _DELIMITER.match(text, i, end) or _LINE.match(text, i, end)
            i = start = m.end() if m else i
            fresh = True
            continue
        if fresh and c in "[{" and i in partner and _list_like(text, i, partner[i]):
            lists.append(partner[i])
            i = start = i + 1
            continue
        if c in _PAIRS and i in partner and partner[i] > inner:
            inner = partner[i]
        if i >= inner:
            if m := _STRONG.match(text, i):
                give(i)
                i = start = m.end()
                fresh = True
                continue
            if c == "," and (lists or _COMMA_QUOTE.match(text, i, n) and any(q for _, q in out)):
                give(i)
                i = start = i + 1
                fresh = True
                continue
        fresh = fresh and c in " ,\n\r\t"
        i += 1
    give(n)
    return out


def _list_like(text: str, at: int, end: int) -> bool:
    """A bracket at the start of a value opens a list if the value ends with it."""
    return _ends(text, end + 1, len(text))


_AFTER = re.compile(r"\s*(?:$|[,;|\n\t\r\]]|/\s|and\s|&\s)")


def _ends(text: str, at: int, n: int) -> bool:
    return bool(_AFTER.match(text[at:n]))


def _closes(text: str, at: int, n: int, held: int) -> bool:
    """An empty quoted value: the second of two quotes ends it."""
    return held == 0 and _ends(text, at + 1, n)


def split_authors(text: str | None) -> list[str]:
    """Persons and organisations of one author field, as they stand, in order."""
    if text is None:
        return []
    out = []
    for part, quoted in tokenize(text):
        part = part.strip()
        if not part:
            continue
        out += [part] if quoted else split_people(part)
    return [x for x in out if any(c.isalnum() for c in x)]


_ALNUM = re.compile(r"[\W_]+")
_LEVEL = re.compile(r">+|»|→|::|\\")


def path_key(path: str) -> str:
    """Letters and digits of a path: the same for every way of writing its level marks."""
    return _ALNUM.sub("", path).casefold()


def split_paths(text: str | None, known: frozenset[str] = frozenset(), levels: int = 4) -> list[str]:
    """Hierarchy paths of one field.  Stretches are joined until they are a path in ``known``
    (keys of ``path_key``); unknown ones are joined by their number of level marks."""
    if text is None:
        return []
    out: list[str] = []
    run: list[tuple[int, int]] = []
    joined = text
    parts = tokenize(text)
    if not any(q for _, q in parts):
        at = 0
        for part, _ in parts:
            at = text.index(part, at)
            run.append((at, at + len(part)))
            at += len(part)
        return _join_paths(joined, run, known, levels)
    for part, quoted in parts:
        if quoted:
            if path_key(part) in known or not known:
                out.append(part.strip())
            else:
                out += split_paths(part, known, levels) if '"' not in part else [part.strip()]
        elif part.strip():
            out += _join_paths(part, _spans(part), known, levels)
    return _mend(out, known)


def _spans(text: str) -> list[tuple[int, int]]:
    spans, at = [], 0
    for m in _STRONG.finditer(text):
        spans.append((at, m.start()))
        at = m.end()
    return [*spans, (at, len(text))]


def _mend(values: list[str], known: frozenset[str]) -> list[str]:
    """Neighbours in a quoted list that only together are a known path."""
    out, i = [], 0
    while i < len(values):
        if known and path_key(values[i]) not in known:
            key, longest = path_key(values[i]), max(map(len, known))
            for j in range(i + 1, len(values)):
                key += path_key(values[j])
                if len(key) > longest:
                    out.append(values[i])
                    break
                if key in known:
                    out.append("; ".join(values[i : j + 1]))
                    i = j
                    break
            else:
                out.append(values[i])
        else:
            out.append(values[i])
        i += 1
    return [x for x in out if any(c.isalnum() for c in x)]


def _join_paths(text: str, spans: list[tuple[int, int]], known: frozenset[str], levels: int) -> list[str]:
    spans = [(a, b) for a, b in spans if text[a:b].strip()]
    out, i, n, longest = [], 0, len(spans), max(map(len, known), default=0)
    while i < n:
        best, key = None, ""
        for j in range(i, n):
            key += path_key(text[slice(*spans[j])])
            if len(key) > longest:
                break
            if key in known:
                best = j
        if best is None:
            best = i
            marks = len(_LEVEL.findall(text[slice(*spans[i])]))
            while best + 1 < n and ((m := len(_LEVEL.findall(text[slice(*spans[best + 1])]))) == 0 or (marks < levels - 1 and marks + m <= levels - 1)):
                marks += m
                best += 1
        out.append(text[spans[i][0] : spans[best][1]].strip())
        i = best + 1
    return [x for x in out if any(c.isalnum() for c in x)]


def _unwrap(values: Iterable[str]) -> list[str]:
    return [x.strip() for x in values if x.strip()]


def authors_array(col: Column) -> Column:
    """Array of the values of an author field; an empty array for NULL or empty text."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _unwrap(split_authors(x)))

    return split(col)


def paths_array(col: Column, known_paths: Iterable[str] = (), levels: int = 4) -> Column:
    """Array of the hierarchy paths of a field; ``known_paths`` is a small fixed vocabulary."""
    known = frozenset(path_key(p) for p in known_paths if p)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _unwrap(split_paths(x, known, levels)))

    return split(col)


def split_to_rows(df: DataFrame, key: str, values: Column, field_name: str) -> DataFrame:
    """One row per value: ``field_name, row_key, pos, item``.

    NULL fields and fields without a value give no row; repeated values keep one row each,
    told apart by ``pos`` (from 1).  Columns other than the key are not carried along.
    """
    return df.select(F.col(key).cast("bigint").alias("row_key"), F.posexplode(values).alias("p", "item")).select(
        F.lit(field_name).alias("field_name"), "row_key", (F.col("p") + 1).cast("int").alias("pos"), "item"
    )
