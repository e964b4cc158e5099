"""Forms of a bibliographic record in which writing differences are gone: words, DOI, sentences."""

from __future__ import annotations

import re
from urllib.parse import unquote

import xxhash

from skerry.operators.multivalue import split_authors

_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ`´](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_DOI_PREFIX = re.compile(r"^(?:https?\W{0,4})?(?:www\.)?(?:dx\.)?(?:doi\.org/*)?\s*(?:doi)?[\s:=/]*", re.I)
_DOI_END = " \t\r\n.,;:)]}>\"'/"
_NO_WORD = re.compile(r"[^\w\n]+|_+")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"')\]]*\s+|[\r\n]+")


def hash64(data: bytes | str) -> int:
    """A signed 64-bit hash, the same in every task."""
    h = xxhash.xxh64_intdigest(data)
    return h - (1 << 64) if h >> 63 else h


def hash128(data: bytes) -> bytes:
    """A hash of 128 bits, the same in every task: equal hashes mean equal data at any number of records."""
    return xxhash.xxh3_128_digest(data)


def words(text: str | None) -> list[str]:
    """Case-folded words in text order; apostrophes inside a word are dropped."""
    if not text:
        return []
    text = text.casefold()
    return _WORD.findall(text if text.isascii() and "'" not in text and "`" not in text else _APOSTROPHE.sub("", text))


def author_words(text: str | None) -> list[str]:
    """Words of all values of an author field, without the conjunctions between them."""
    return [w for item in split_authors(text) for w in words(item)]


def bare_doi(text: str | None) -> str:
    """A DOI without prefix, percent encoding, trailing marks and case; "" if there is none."""
    if not text or not text.strip():
        return ""
    return _DOI_PREFIX.sub("", unquote(text).strip()).strip().rstrip(_DOI_END).casefold()


def sentences(text: str | None) -> list[str]:
    """The sentences of a text as case-folded words with single blanks; empty ones are left out."""
    if not text:
        return []
    lines = _NO_WORD.sub(" ", _SENTENCE.sub("\n", _APOSTROPHE.sub("", text.casefold()))).split("\n")
    return [s for x in lines if (s := x.strip())]


def same_words(a: list[str], b: list[str]) -> bool:
    """Equal words whatever their order, a word and its hyphen parts ("short day", "shortday") being equal."""
    if sorted(a) == sorted(b):
        return True
    left: dict[str, int] = {}
    for w in a:
        left[w] = left.get(w, 0) + 1
    only_b = []
    for w in b:
        if left.get(w, 0):
            left[w] -= 1
        else:
            only_b.append(w)
    only_a = []
    for w in reversed(a):
        if left.get(w, 0):
            left[w] -= 1
            only_a.append(w)
    only_a.reverse()
    return "".join(only_a) == "".join(only_b)
