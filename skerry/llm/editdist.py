"""Bounded edit distance, and an index of string segments that finds all strings within it."""

from __future__ import annotations

from skerry.llm.records import hash64


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of ``a`` and ``b`` is at most ``most``."""
    return distance(a, b, most) <= most


def distance(a: str, b: str, most: int) -> int:
    """The edit distance (insert, delete, replace, swap of neighbours), or ``most`` + 1 beyond it.

    Common ends are cut off first; then only a band of the table is filled."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    far = most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        row = [far] * (len(b) + 1)
        if x <= most:
            row[0] = x
        lo, hi = max(1, x - most), min(len(b), x + most)
        best = row[0]
        for y in range(lo, hi + 1):
            d = min(last[y - 1] + (a[x - 1] != b[y - 1]), last[y] + 1, row[y - 1] + 1)
            if before and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                d = min(d, before[y - 2] + 1)
            row[y] = d
            best = min(best, d)
        if best > most and min(last) > most:
            return far
        before, last = last, row
    return min(last[-1], far)


def _cuts(length: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of each of ``parts`` segments of a string, the longer ones last."""
    short, extra = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = short + (i >= parts - extra)
        out.append((at, n))
        at += n
    return out


def segments(text: str, most: int) -> list[int]:
    """Index keys of a string: each of its ``most`` + 1 segments with its place and the length of
    the string.  Strings within distance ``most`` share a key with one of ``probes``."""
    return [hash64(f"{len(text)} {i} {text[at : at + n]}") for i, (at, n) in enumerate(_cuts(len(text), most + 1))]


def probes(text: str, most: int) -> list[int]:
    """Keys under which every indexed string within distance ``most`` of ``text`` is found: for each
    possible length and segment the substrings at the starts that an alignment with at most
    ``most`` edits allows (bounded from both ends)."""
    out = []
    for length in range(max(1, len(text) - most), len(text) + most + 1):
        shift = len(text) - length
        for i, (at, n) in enumerate(_cuts(length, most + 1)):
            lo = max(0, at - i, at + shift - (most - i))
            hi = min(len(text) - n, at + i, at + shift + (most - i))
            for start in range(lo, hi + 1):
                out.append(hash64(f"{length} {i} {text[start : start + n]}"))
    return list(dict.fromkeys(out))
