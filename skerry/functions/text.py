"""Text normalisation as column expressions, all on the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that become more than one letter in ASCII.
EXPANDED = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ĳ": "ij", "Ĳ": "IJ"}
# Letters with a stroke, which have no decomposition.
STROKED = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ħ": "h", "Ħ": "H", "ł": "l", "Ł": "L", "ŧ": "t", "Ŧ": "T", "ı": "i"}


def ascii_pairs() -> tuple[str, str]:
    """Accented Latin letters and their base letters, for ``translate``."""
    pairs = dict(STROKED)
    for code in [*range(0xC0, 0x180), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


_FROM, _TO = ascii_pairs()


def squish(c: Column) -> Column:
    """Trimmed, every run of white space one blank."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_na(c: Column) -> Column:
    """Squished; "NA" is NULL."""
    return F.nullif(squish(c), F.lit("NA"))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def clean_html(c: Column) -> Column:
    """Text without tags and the common entities, NULL if nothing is left.  The ampersand is decoded
    before the angle brackets, so a doubly escaped tag becomes text."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " ")
    for entity, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return empty_to_null(squish(t))


def latin_ascii(c: Column) -> Column:
    """Latin letters without accents."""
    t = F.translate(c, _FROM, _TO)
    for letter, plain in EXPANDED.items():
        t = F.replace(t, F.lit(letter), F.lit(plain))
    return t


def normalise_title(c: Column) -> Column:
    """Lower-case ASCII words of a title."""
    return squish(F.regexp_replace(latin_ascii(F.lower(c)), "[^a-z0-9]+", " "))


def title_key(c: Column) -> Column:
    """Like ``normalise_title`` with entities dropped; "" for NULL."""
    t = F.regexp_replace(F.lower(latin_ascii(F.coalesce(c, F.lit("")))), "&[a-z]+;", " ")
    return squish(F.regexp_replace(t, "[^a-z0-9]+", " "))


def bare_doi(c: Column) -> Column:
    """Lower case without resolver address and "doi:"."""
    t = F.regexp_replace(F.lower(clean_na(c)), r"^https?://(dx\.)?doi\.org/", "")
    return F.trim(F.regexp_replace(t, r"^doi:\s*", ""))


def normalise_doi(c: Column) -> Column:
    """A bare DOI, NULL where it has not the form of one."""
    t = bare_doi(c)
    return F.when(t.rlike(r"^10\.\d{4,9}/\S+$"), t)


def year_of(c: Column) -> Column:
    """The first year from 1800 to 2099 in a text."""
    return F.nullif(F.regexp_extract(c, r"((?:18|19|20)\d{2})", 1), F.lit("")).try_cast("int")


def word_count(c: Column) -> Column:
    """Number of words between white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(c, F.lit(r"\S+")), F.lit(0))


def first_author_key(c: Column) -> Column:
    """ASCII words of the first author."""
    first = F.split(F.coalesce(c, F.lit("")), r"\s*\|\s*|\s*;\s*", 2)[0]
    return squish(F.regexp_replace(F.lower(latin_ascii(first)), "[^a-z0-9]+", " "))


def title_token_key(key: Column, n: int = 8) -> Column:
    """The first words of a title key, sorted and without repeats."""
    return F.array_join(F.array_sort(F.array_distinct(F.slice(F.filter(F.split(key, " "), lambda x: x != ""), 1, n))), " ")


def screening_text(title: Column, abstract: Column) -> Column:
    """Title twice behind its marker, then the abstract."""
    t, a = F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))
    return squish(F.concat_ws(" ", F.lit("TITLE_TITLE"), t, F.lit("TITLE_TITLE"), t, F.lit("ABSTRACT"), a))


def collapse_unique(c: Column, sep: str = "; ") -> Column:
    """Aggregate: the distinct non-empty values in byte order, NULL if there are none."""
    return empty_to_null(F.array_join(F.array_sort(F.collect_set(empty_to_null(c))), sep))


def collapse_ordered(value: Column, order: Column, sep: str = "; ") -> Column:
    """Aggregate: the distinct values in the order of their first occurrence."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.array_join(F.array_distinct(F.transform(F.filter(rows, lambda r: r["v"].isNotNull()), lambda r: r["v"])), sep)


def true(c: Column) -> Column:
    """TRUE only where the flag is TRUE: NULL counts as FALSE."""
    return F.coalesce(c, F.lit(False))


def in_set(c: Column, values: list) -> Column:
    """Membership that is FALSE, not NULL, for NULL."""
    return F.coalesce(c.isin(values), F.lit(False))


def not_in_set(c: Column, values: list) -> Column:
    """TRUE for what is not among the values, NULL included."""
    return ~in_set(c, values)


def shorten(c: Column, width: int) -> Column:
    """At most ``width`` characters, cut texts ending in an ellipsis."""
    return F.when(F.char_length(c) > width, F.concat(F.rtrim(F.substring(c, 1, width - 1)), F.lit("…"))).otherwise(c)


def around(c: Column, start: Column, end: Column, width: int) -> Column:
    """The characters from ``width`` before ``start`` to ``width`` after ``end`` (from 1, inclusive), squished."""
    first = F.greatest(F.lit(1), start - width)
    return squish(F.substring(c, first, end + width - first + 1))


def split_columns(c: Column, pattern: str, names: list[str]) -> list[Column]:
    """The parts of a text as columns, NULL where there are fewer; further ones are dropped."""
    parts = F.split(c, pattern)
    return [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(names)]


def set_text(c: Column, sep: str = ";") -> Column:
    """A separated list as a text that is equal for equal sets: trimmed, lower case, sorted, no repeats, no blanks."""
    items = F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), sep), lambda x: squish(x))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(items, lambda x: x != ""))), "; ")
