"""Evaluation passages inside corpus documents (problem 8).

Every item is cut into all its passages of 15 words, and each passage is sketched by MinHash: the smallest
hashes of its 13 three-word shingles.  The share of a sketch that a document holds estimates how much of the
passage the document contains, and a passage is a candidate where the estimate reaches a threshold.
Documents are partitioned by size: the longer one is, the more chance hits it has, so the larger
the sketch and the higher the threshold.  With one word in eight changed a passage keeps at least 7 of its
13 shingles, so of a sketch of k at least k - 6 are held: the thresholds lose no such passage.

Candidates are verified exactly, on the words: enough of the passage's shingles must stand close together,
and are then extended over single changed, added or misspelled words to the longest run.  Sentences that stand
in several items count for nothing, and a run needs shingles that only this item has, so phrases that
several items share (question frames) are no leak.

Items are a query set: they are taken in blocks of bounded size, each against all documents, which are read in
place, without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.arrow import map_lists
from skerry.llm.editdist import distance
from skerry.llm.records import hash64, words
from skerry.sources.tables import materialize

SHINGLE = 3
#: Words of a passage: the shortest leak that counts.
PASSAGE = 15
#: Shingles of a passage, and those that one word in eight changed can take away.
SPAN, LOST = PASSAGE - SHINGLE + 1, SHINGLE * -(-PASSAGE // 8)
#: Size classes of documents by words: size of the sketches looked up there.  The threshold is the size less ``LOST``.
SIZES = ((0, 9), (1_000, 11), (10_000, 13))
#: Shingles of a run that only its item has.
OWN = 3
#: Items of a block: as many as are sent to every task at once.
BLOCK = 5_000

_MARKUP = re.compile(r"<[^<>\n]{1,200}>|\*\*|__|~~|&(?:\w{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,5});")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐]\n\s*(?=[^\W\d_])")


def plain_words(text: str) -> list[str]:
    """Case-folded words without markup, entities, soft hyphens and end-of-line hyphens."""
    if any(x in text for x in ("<", "&", "**", "__", "~~")):
        text = _MARKUP.sub(lambda m: html.unescape(m.group()) if m.group()[0] == "&" else " ", text)
    text = text.replace("\xad", "").replace("\u200b", "")
    return words(_BREAK.sub("-", text) if "-\n" in text or "‐\n" in text else text)


def sentence_words(text: str) -> list[list[str]]:
    """The words of each sentence; sentences without any are left out."""
    return [w for s in _SENTENCE.split(text) if (w := plain_words(s))]


def shared_parts(items: DataFrame) -> DataFrame:
    """``item_id, text, sentences, shingles`` of each item: the hashes of its sentences and shingles that other
    items have too."""

    def parts(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for ids, texts in batches:
            out = []
            for i, text in zip(ids, texts, strict=True):
                ss = sentence_words(text)
                ws = [w for s in ss for w in s]
                out += [(i, True, h) for h in {hash64(" ".join(s)) for s in ss}]
                out += [(i, False, h) for h in {hash64(" ".join(ws[p : p + SHINGLE])) for p in range(len(ws) - SHINGLE + 1)}]
            yield out

    each = map_lists(items.select("item_id", "text"), parts, "item_id bigint, whole boolean, h bigint").distinct()
    held = each.groupBy("whole", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    per = each.join(held, ["whole", "h"]).groupBy("item_id").agg(F.collect_set(F.when(F.col("whole"), F.col("h"))).alias("sentences"), F.collect_set(F.when(~F.col("whole"), F.col("h"))).alias("shingles"))
    return items.join(per, "item_id", "left").select("item_id", "text", "sentences", "shingles")


class Items:
    """The words of a block of items, where each shingle stands, and the sketches of their passages."""

    def __init__(self, items: list[tuple[int, str, list[int] | None, list[int] | None]]) -> None:
        self.ids: list[int] = []
        self.words: list[list[str]] = []
        self.own: list[list[bool]] = []
        self.vocab: dict[str, int] = {}
        codes: list[int] = []
        starts = [0]
        for i, text, sentences, shingles in items:
            ws: list[str] = []
            for s in sentence_words(text):
                ws += ["\0"] * len(s) if hash64(" ".join(s)) in (sentences or ()) else s
            elsewhere = set(shingles or ())
            self.ids.append(i)
            self.words.append(ws)
            self.own.append([hash64(" ".join(ws[p : p + SHINGLE])) not in elsewhere for p in range(len(ws))])
            # places run on over the items, with a gap that no passage spans
            codes += [0 if w == "\0" else self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws] + [0] * SHINGLE
            starts.append(len(codes))
        self.starts = np.array(starts)
        self.weights = np.array([0, *(np.uint64(hash64(w) & (2**64 - 1)) for w in self.vocab)], dtype=np.uint64)
        h = self.hashes(np.array(codes, dtype=np.int64))
        order = np.argsort(h, kind="stable")
        order = order[h[order] > 0]
        self.sorted_hash, self.sorted_place = h[order], order
        # of every place the passages (by their distance back) whose sketch holds its shingle
        self.sketched = {k: np.zeros(len(h), dtype=np.int32) for _, k in SIZES}
        if len(h) >= SPAN:
            windows = np.lib.stride_tricks.sliding_window_view(h, SPAN)
            whole = np.flatnonzero((windows > 0).all(axis=1))
            ranked = np.argsort(windows[whole], axis=1, kind="stable")
            for k, bits in self.sketched.items():
                for r in range(k):
                    np.bitwise_or.at(bits, whole + ranked[:, r], np.int32(1) << ranked[:, r].astype(np.int32))

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        """Hash of each shingle; 0 where a word is not of the items."""
        if len(codes) < SHINGLE:
            return np.zeros(0, dtype=np.uint64)
        w, n = self.weights[codes], len(codes) - SHINGLE + 1
        h, ok = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=bool)
        with np.errstate(over="ignore"):
            for i in range(SHINGLE):
                h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n]
                ok &= codes[i : i + n] > 0
        h ^= h >> np.uint64(29)
        h[h == 0] = 1
        h[~ok] = 0
        return h

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the document and in the items of all shingles that both have."""
        at = np.flatnonzero(h)
        lo, hi = np.searchsorted(self.sorted_hash, h[at], "left"), np.searchsorted(self.sorted_hash, h[at], "right")
        n = hi - lo
        ends = np.cumsum(n)
        pick = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n) + np.repeat(lo, n)
        return np.repeat(at, n), self.sorted_place[pick]

    def passages(self, places: np.ndarray, size: int) -> np.ndarray:
        """Starts of the passages of which the held shingles (at ``places`` of the items) make the estimated
        containment reach the threshold of the document's size class, and the exact one that of a leak."""
        k = next(k for n, k in reversed(SIZES) if size >= n)
        least = k - LOST
        if len(places) < least:
            return places[:0]
        mask = np.zeros(len(self.sketched[k]), dtype=bool)
        mask[places] = True
        held = np.flatnonzero(mask)
        if len(held) < least or not (held[least - 1 :] - held[: len(held) - least + 1] < SPAN).any():
            return held[:0]
        at, back = np.nonzero(self.sketched[k][held][:, None] >> np.arange(SPAN) & 1)
        start = np.flatnonzero(np.bincount(held[at] - back) >= least)
        return start[np.searchsorted(held, start + SPAN) - np.searchsorted(held, start) >= SPAN - LOST]


def _forward(a: list[str], i: int, b: list[str], j: int, step: int) -> list[int]:
    """Follow the run from (i, j) in direction ``step``: the place in ``a`` of each equal word, -1 for each
    edit, until edits come too close together."""
    out: list[int] = []
    recent = 0.0
    inside = lambda x, y: 0 <= x < len(a) and 0 <= y < len(b) and a[x] != "\0"
    while inside(i, j):
        if a[i] == b[j]:
            out.append(i)
            recent = max(0.0, recent - 0.25)
            i, j = i + step, j + step
            continue
        recent += 1
        if recent > 2.5:
            break
        for di, dj in ((1, 1), (0, 1), (1, 0), (0, 2), (2, 0), (2, 2), (1, 2), (2, 1)):
            x, y = i + di * step, j + dj * step
            if inside(x, y) and a[x] == b[y] and (not inside(x + step, y + step) or a[x + step] == b[y + step] or (di, dj) == (1, 1) and len(a[i]) > 3 and distance(a[i], b[j], 2) <= 2):
                out += [-1] * max(di, dj)
                i, j = x, y
                break
        else:
            break
    return out


def best_run(a: list[str], b: list[str], hits: list[tuple[int, int]], rate: int = 8, own: list[bool] | None = None) -> tuple[int, int]:
    """Length and equal words of the longest run of ``a`` in ``b`` through one of the shingle hits
    (place in ``a``, place in ``b``) with at most one edit in about ``rate`` words and, with ``own`` (the
    shingles of ``a`` that no other item has), at least ``OWN`` of these."""
    best, done = (0, 0), set()
    for i, j in hits:
        if (i, j) in done:
            continue
        left = _forward(a, i - 1, b, j - 1, -1)
        right = _forward(a, i, b, j, 1)
        for n, x in enumerate(right):
            if x < 0:
                break
            done.add((x, j + n))
        path = left[::-1] + right
        proof = [0]
        for k, x in enumerate(path):
            proof.append(proof[-1] + (x >= 0 and (own is None or (own[x] and path[k + 1 : k + SHINGLE] == list(range(x + 1, x + SHINGLE))))))
        marks = [-1, *[k for k, x in enumerate(path) if x < 0], len(path)]
        for s in range(len(marks) - 1):
            for e in range(s + 1, len(marks)):
                n, bad = marks[e] - marks[s] - 1, e - s - 1
                if bad <= -(-n // rate) and (n, n - bad) > best and proof[max(marks[s] + 1, marks[e] - SHINGLE + 1)] - proof[marks[s] + 1] >= (0 if own is None else OWN):
                    best = (n, n - bad)
    return best


def _close(hits: list[tuple[int, int]], within: int = PASSAGE + 6, least: int = SPAN - LOST) -> list[tuple[int, int]]:
    """The hits that stand with enough others of different places in ``a`` inside ``within`` words of ``b``."""
    hits = sorted(hits, key=lambda x: x[1])
    keep: set[int] = set()
    lo, count = 0, {}
    for hi, (q, p) in enumerate(hits):
        count[q] = count.get(q, 0) + 1
        while p - hits[lo][1] > within:
            count[hits[lo][0]] -= 1
            if not count[hits[lo][0]]:
                del count[hits[lo][0]]
            lo += 1
        if len(count) >= least:
            keep.update(range(lo, hi + 1))
    return [hits[k] for k in sorted(keep)]


def leaked_items(documents: DataFrame, items: DataFrame, least: int = PASSAGE, rate: int = 8) -> DataFrame:
    """``doc_id, item_id, run_words, equal_words`` of every document that holds at least ``least`` words
    in a row of an item.

    ``documents`` needs ``doc_id, text``, ``items`` ``item_id, text``; other columns are ignored.
    NULL or empty texts hold nothing; a repeated document gives its rows each time, an empty
    table none.  Whole texts are searched, and any number of items: a block of ``BLOCK`` at a time.
    """
    known = items.select("item_id", "text").where("item_id is not null and text <> ''").distinct()
    n = known.count()
    if not n:
        return documents.sparkSession.createDataFrame([], _LEAKS)
    parts, blocks = materialize(shared_parts(known), "eval-items"), -(-n // BLOCK)
    out = None
    for k in range(blocks):
        rows = parts.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        found = _search(documents, Items(sorted(map(tuple, rows), key=lambda r: r[:2])), least, rate)
        out = found if out is None else out.unionByName(found)
    return out


_LEAKS = "doc_id bigint, item_id bigint, run_words int, equal_words int"


def _search(documents: DataFrame, known: Items, least: int, rate: int) -> DataFrame:
    def find(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        get = known.vocab.get
        for batch in batches:
            out = []
            for doc, text in zip(*batch, strict=True):
                ws = plain_words(text)
                at, places = known.hits(known.hashes(np.array([get(w, 0) for w in ws], dtype=np.int64)))
                passages = known.passages(places, len(ws))
                if not len(passages):
                    continue
                owner = np.searchsorted(known.starts, places, "right") - 1
                for n in np.unique(np.searchsorted(known.starts, passages, "right") - 1).tolist():
                    mine = owner == n
                    where = _close(list(zip((places[mine] - known.starts[n]).tolist(), at[mine].tolist(), strict=True)))
                    run, equal = best_run(known.words[n], ws, where, rate, known.own[n]) if where else (0, 0)
                    if run >= least:
                        out.append((doc, known.ids[n], run, equal))
            yield out

    return map_lists(documents.select("doc_id", "text").where("text is not null"), find, _LEAKS)
