"""Column expressions for lists kept in one text: sets, terms, columns, windows, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.text import squish


def normalised_set(c: Column) -> Column:
    """Values between semicolons in lower case, each once, sorted and joined again; "" for NULL and blank texts.
    An empty value between two semicolons counts as a value."""
    items = F.transform(F.split(c, r"\s*;\s*"), lambda x: F.lower(squish(x)))
    return F.when(F.coalesce(squish(c), F.lit("")) == "", F.lit("")).otherwise(F.array_join(F.array_sort(F.array_distinct(items)), "; "))


def distinct_folded(items: Column) -> Column:
    """The items of an array in their order, of those that differ in letter case only the first."""
    folded = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def shorten_terms(c: Column, most: int = 10) -> Column:
    """The first ``most`` different terms of a list with semicolons; "" for NULL."""
    terms = F.filter(F.split(F.coalesce(c, F.lit("")), r";\s*"), lambda x: x != "")
    return F.array_join(F.slice(distinct_folded(terms), 1, most), "; ")


def context_window(text: Column, start: Column, end: Column, width: int = 100) -> Column:
    """The text from ``width`` characters before a span to as many after it; places count from 1 and include
    the end."""
    first = F.greatest(F.lit(1), start - width)
    return squish(F.substring(text, first, F.least(F.char_length(text), end + width) - first + 1))


def percent_encode(c: Column) -> Column:
    """Every byte but letters, digits and ``-._~`` as %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def split_columns(c: Column, separator: str, names: list[str]) -> list[Column]:
    """The parts of a text as columns: missing ones at the end are NULL, what is too many stays in the last."""
    parts = F.split(c, separator, len(names))
    return [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]


def numbered(prefix: str, n: Column, digits: int = 3) -> Column:
    """An identifier such as TOPIC_007."""
    return F.concat(F.lit(f"{prefix}_"), F.when(n < 10**digits, F.lpad(n.cast("string"), digits, "0")).otherwise(n.cast("string")))
