"""Template residue, filler and messages of servers, programs and browsers (problem 9).

Unfilled placeholders are found by one small grammar for each kind of delimiter, messages by
patterns for whole phrases in several languages, filler by its words: the vocabulary of filler
is learned over all documents from the sentences around well-known filler words, and a sentence
made of that vocabulary is filler.  A match inside a code block, or one that its sentence quotes
or talks about, is discounted unless such matches make up much of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.arrow import map_lists

# What placeholders may say between their delimiters.
_SLOT = r"(?:insert|todo|tbd|tbc|to do|add|enter|your|type|choose|describe|replace|write|citation|reference|author|table|figure|image|photo|caption|value|name|first name|last name|full name|date|place|site|site name|sender|recipient|address|e-?mail|phone|company|organi[sz]ation|title|subtitle|number|amount|url|link)"
# One grammar for each kind of delimiter.
PLACEHOLDERS = {
    "double brace": r"\{\{[^{}\n]{1,80}\}\}",
    "brace percent": r"\{%-?\s*\w[^%\n]{0,80}%\}",
    "angle percent": r"<%[=-]?[^%\n]{1,80}%>",
    "dollar brace": r"\$\{[\w.]{1,40}\}",
    "dollar pair": r"\$[A-Za-z_]\w{1,30}\$",
    "brace name": r"(?<![\w\\{$])\{(?:\d{1,2}|[a-z][a-z0-9]*(?:[_.][a-z0-9]+)*)\}(?!\})(?<!\{.\})|(?<![\w\\{$])\{\d\}(?!\})",
    "percent": r"%{1,2}[A-Z][A-Z_]{2,30}%{1,2}",
    "underscore": r"(?<!\w)__[A-Z][A-Z_]{1,30}__(?!\w)",
    "at": r"@@?[A-Z][A-Z_]{1,30}@@?(?!\w)",
    "hash": r"##[A-Z][A-Z_]{1,30}##",
    "double angle": r"<<\s*[A-Za-z][\w ]{1,40}>>",
    "guillemet": r"«[A-Za-zÀ-ÿ]+(?:_[A-Za-z]+)*»",
    "double square": r"\[\[[^\[\]\n]{2,60}\]\]",
    "square": rf"\[(?i:{_SLOT})(?i:\s+(?:here|to (?:come|confirm|follow|add|be [\w ]{{1,30}})|text|[a-z ]{{1,30}} here|name|date|title|of [a-z ]{{1,20}}|[A-Z ]{{2,20}}))?(?::[^\[\]\n]{{0,40}})?\]",
    "printf": r"(?<![\w%])(?<!\d )%(?:\(\w{1,30}\))?[sdifr](?!\w)",
    "sheet": r"#(?:REF!|NAME\?|VALUE!|DIV/0!|NULL!|NUM!|N/A\b)",
    "angle": r"<(?i:enter|insert|describe|type|your|add|choose|write|name of|replace)\b[^<>\n]{0,80}>",
}
# Phrases of filler and of instructions to the author.
PHRASES = {
    "filler": r"(?i)\blorem ipsum\b|\b(?:text|title|heading|content|caption|subtitle|description|paragraph|name)\s*(?:\d+\s+)?goes here\b|\bx{3,}(?:\W+x{2,}){2,}|\bsample (?:paragraph|text)\b[.:]|\bthis is (?:sample|dummy|placeholder|filler) text\b|\b(?:undefined\s+){2,}|\bundefined undefined\b|\[object object\]|\b(?:NaN\s+){2,}",
    "instruction": r"(?im)\breplace this (?:text|paragraph|with)\b|(?:^|(?<=[.!?]\s))(?:insert|add|enter|write|type|describe|put|paste)\s[^.!?\n]{0,60}(?:\bhere\b|\(max(?:imum)?\.? \d+ (?:words|characters)\))|\bto be (?:added|completed|filled in|written) by the author\b|^\s*(?:title|authors?|abstract|summary|date|keywords?)\s*:\s*(?:tbd|tbc|todo|n\.?n\.?|xxx)\b|\bclick here to (?:add|edit|enter) (?:text|title)",
    "status": r"(?im)\b(?:400|401|403|404|405|408|410|429|500|501|502|503|504)\s+(?:bad request|unauthorized|forbidden|not found|method not allowed|request time-?out|gone|too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)\b|\bhttp (?:status|error)(?: code)?\s*:?\s*[45]\d\d\b|(?:^|(?<=[.!?]\s))(?:error|fehler|erreur|feil)\s+[45]\d\d\s*[:–-]|\((?:fehler|erreur|feil|error) \d{3,4}\)|\binternal server error\b|\bserver error \(\d+\)|\b(?:server|host|proxy|gateway|service) (?:has )?(?:met|encountered) an unexpected (?:condition|error)\b|\bserver is (?:temporarily|currently) unable to (?:service|handle|process)\b|\b(?:host|server|proxy|gateway) (?:did not|didn't|failed to) (?:answer|respond|reply)\b|\b(?:proxy|nginx|apache)/\d",
    "missing": r"(?im)\bcould(?: not|n't) be found on this server\b|\boops!|\bwe can(?:not|'t) find that \w+|\bthis \w+ has moved or no longer exists\b|^\s*(?:page not found|seite nicht gefunden|page introuvable|página no encontrada|siden ble ikke funnet|siden finnes ikke)\b|\bn'existe plus à cette adresse\b|(?<=[.!?]\s)(?:page introuvable|seite nicht gefunden|página no encontrada|siden ble ikke funnet)\b",
    "blocked": r"(?im)\b(?:access|permission) denied\s*[.!:]|\byou (?:do not|don't) have permission to\b|\btoo many requests from your\b|\bchecking your browser\b|\bverify (?:that )?you are (?:a )?human\b|\byour session has (?:expired|timed out)\b|\bsign in (?:again )?to continue\b|\bplease (?:log|sign) in to (?:view|continue|read)\b|\byour (?:ip|request|account) (?:address )?has been blocked\b|\bare you a robot\b|\bcomplete the captcha\b",
    "program": r"(?m)^\s*Traceback \(most recent call last\)|\b(?:Key|Value|Type|Name|Index|Attribute|Runtime|Import)Error: |\b(?:[a-z]+\.){1,5}[A-Z]\w*(?:Exception|Error)\b|^\s+at (?:[a-z]\w*\.)+[A-Z]\w*\.\w+\(|(?i:\bfatal error:|\bdatabase error:|\bundefined (?:variable|index|offset)\b[^\n]{0,60}\bon line \d+|\bcould not connect to server\b|\bmemory size exhausted\b|\bsegmentation fault\b|\bparse error:|\bsyntax error,)",
    "loading": r"(?im)\[?\bfailed to load\b[^.\n]{0,40}[.\]]|\b(?:error|fehler|erreur): [^.\n]{0,50}could not be loaded|\bis temporarily unavailable; (?:please )?reload\b|^\s*loading\b[^.\n]{0,30}\.\.\.\s*$|(?<=[.!?]\s)loading(?: \w+){0,3}\s?\.\.\.|\bplease reload the page\b",
    "scripts": r"(?i)\b(?:enable|turn on|activate|switch on|allow) (?:javascript|scripts|cookies)\b|\b(?:needs|requires?) (?:javascript|scripts|cookies)(?: (?:to|and|or|in order)\b|\.)|\b(?:javascript|scripts|cookies) (?:is|are|must be) (?:required|disabled|blocked|switched off|turned off|enabled)\b|\bdoes not support (?:javascript|scripts)\b|\bscripts or cookies are blocked\b|\bactivar javascript\b|\bactive[rz]? (?:le )?javascript\b|\baktivieren sie (?:bitte )?javascript\b|\b(?:slå|skru) på javascript\b|\baktiver javascript\b|\bactive (?:las )?cookies\b|\bhabilit(?:e|ar) javascript\b",
}
# Words by which a sentence quotes or explains what it shows.
_ABOUT = re.compile(r"(?i)\b(?:message|messages|says|said|reads|shows?|shown|displays?|displayed|such as|e\.g\.|for example|syntax|called|written as|the words?|the string|the phrase|the text|returned|tutorial|documentation|notation|denotes?|we write|stands for|answered|replied|reported)\b")
_QUOTED = {'"': '"', "“": "”", "„": "“", "‘": "’", "`": "`", "'": "'"}
_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]+`|<(pre|code)\b.*?</\1>", re.S)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+")
#: Share of a text's characters that discounted matches need to count after all.
DENSE = 0.3
#: Share of the sentences with a well-known filler word in which a word must stand to be a candidate, and the
#: number of them at least.
LEARN, LEARN_LEAST = 0.01, 3
#: Share of a candidate's documents in which it must stand beside a well-known filler word.
BESIDE = 0.2

_PATTERNS = [(k, re.compile(p)) for k, p in (PLACEHOLDERS | PHRASES).items()]
# Lower-case strings of which a text with a match has at least one, by kind.
_NEEDS = {
    "double brace": ["{{"],
    "brace percent": ["{%"],
    "angle percent": ["<%"],
    "dollar brace": ["${"],
    "dollar pair": ["$"],
    "brace name": ["{"],
    "percent": ["%"],
    "underscore": ["__"],
    "at": ["@"],
    "hash": ["##"],
    "double angle": ["<<"],
    "guillemet": ["«"],
    "double square": ["[["],
    "square": ["["],
    "printf": ["%s", "%d", "%i", "%f", "%r", "%("],
    "sheet": ["#"],
    "angle": ["<"],
    "filler": ["lorem", "goes here", "xxx", "sample paragraph", "sample text", "this is ", "undefined", "[object", "nan"],
    "instruction": ["replace this", " here", "(max", "by the author", "tbd", "tbc", "todo", ": xxx", ": n"],
    "status": ["bad request", "unauthorized", "forbidden", "not found", "time-out", "timeout", "gone", "too many", "server error", "not allowed", "not implemented", "bad gateway", "unavailable", "http", "error", "fehler", "erreur", "feil", "unexpected condition", "unexpected error", "unable to service", "unable to handle", "unable to process", *[f"{a} {b}" for a in ("did not", "didn't", "failed to") for b in ("answer", "respond", "reply")], "proxy/", "nginx/", "apache/"],
    "missing": ["on this server", "oops", "find that", "no longer exists", "not found", "nicht gefunden", "introuvable", "no encontrada", "ikke funnet", "finnes ikke", "n'existe plus"],
    "blocked": ["denied", "have permission", "too many requests", "checking your", "you are", "session has", "to continue", "sign in", "log in", "been blocked", "a robot", "captcha"],
    "program": ["traceback", "error", "exception", "\tat ", " at ", "on line", "to server", "exhausted", "segmentation"],
    "loading": ["failed to load", "be loaded", "reload", "loading"],
    "scripts": ["javascript", "scripts", "cookies"],
}


def _about(text: str, a: int, b: int) -> bool:
    """The sentence around the match quotes it or talks about it."""
    start = max(text.rfind("\n", 0, a), text.rfind(". ", 0, a), text.rfind("! ", 0, a), text.rfind("? ", 0, a)) + 1
    before, after = text[start:a].rstrip(), text[b : b + 3].lstrip()
    quoted = bool(before) and before[-1] in _QUOTED and _QUOTED[before[-1]] in text[b : b + 60]
    return (quoted and len(before) > 2) or bool(after[:1] in "\"”'" and _ABOUT.search(before)) or bool(re.search(r"(?i)\b(?:message|placeholder|syntax|string|phrase|tag|token)s?\W*$", before))


def residue_kinds(text: str, filler: frozenset[str] = frozenset()) -> list[str]:
    """Kinds of residue in a text, without those that are only talked about."""
    fences = [m.span() for m in _FENCE.finditer(text)] if "`" in text or "~~~" in text or "<pre" in text or "<code" in text else []
    kinds, doubtful, covered = [], [], 0
    low = text.lower()
    for kind, pattern in _PATTERNS:
        if not any(x in low for x in _NEEDS[kind]):
            continue
        for m in pattern.finditer(text):
            if any(a <= m.start() < b for a, b in fences) or _about(text, *m.span()):
                doubtful.append(kind)
                covered += len(m.group())
            else:
                kinds.append(kind)
                break
    if filler and len(filler.intersection(low.split())) >= 3:
        for s in _SENTENCE.split(text):
            ws = [w.casefold() for w in _WORD.findall(s)]
            if len(ws) >= 4 and sum(w in filler for w in ws) >= 0.8 * len(ws):
                kinds.append("filler")
                break
    if not kinds and covered > DENSE * len(text.strip()):
        kinds = doubtful
    return sorted(set(kinds))


_KNOWN = r"\b(?:lorem|ipsum)\b"


def filler_vocabulary(documents: DataFrame) -> list[str]:
    """Words that stand beside well-known filler words, and hardly anywhere else in all documents.

    A candidate stands in at least a share ``LEARN`` of the sentences that hold a well-known filler word, so
    there are at most 1 / ``LEARN`` times as many as such a sentence has different words on average,
    whatever the number of documents.  Of its documents, counted over the whole table, at least a share
    ``BESIDE`` must have it beside such a word.  Without known filler the vocabulary is empty."""
    low = F.lower("text")
    words = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"[\p{L}]+"), F.lit(0)))
    near = documents.where(low.contains("lorem") | low.contains("ipsum")).select("doc_id", F.explode(F.split(low, r"(?<=[.!?])\s+|\n+")).alias("s")).where(F.col("s").rlike(_KNOWN))
    beside = near.select("doc_id", "s", F.explode(words(F.col("s"))).alias("w")).groupBy("w").agg(F.count("*").alias("k"), F.count_distinct("doc_id").alias("d"))
    least = max(LEARN_LEAST, LEARN * near.count())
    candidates = {r["w"]: r["d"] for r in beside.where(F.col("k") >= least).collect()}
    if not candidates:
        return []
    known = F.array(*[F.lit(w) for w in sorted(candidates)])
    held = documents.select(F.explode(F.array_intersect(F.split(low, r"[^\p{L}]+"), known)).alias("w")).groupBy("w").count()
    return sorted(r["w"] for r in held.collect() if candidates[r["w"]] >= BESIDE * r["count"])


def residue(documents: DataFrame) -> DataFrame:
    """``doc_id, kinds`` of every document with template residue, filler or a message.

    Needs ``doc_id, text``; other columns are ignored.  NULL and empty texts are no cases, repeated
    rows give a row each, an empty table none.  Whole texts are searched, whatever their length.
    """
    filler = frozenset(["lorem", "ipsum", *filler_vocabulary(documents)])

    def find(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            yield [(doc, kinds) for doc, text in zip(*batch, strict=True) if (kinds := residue_kinds(text, filler))]

    return map_lists(documents.select("doc_id", "text").where("trim(text) <> ''"), find, "doc_id bigint, kinds array<string>")
