"""Collapsing records that differ in form only (problem 4).

Each record gets *canonical bytes* that no difference of form changes: counts of the letters of
its title and authors, other letters sorted, and the bare DOI.  Copies are then counted by
recursive radix partitioning: a bucket is a prefix of the canonical bytes, and a bucket with more
than ``capacity`` entries is split by further bytes until each fits.  Within a bucket a trie
over the bytes counts them in terminal counters; an exact word check tells apart texts whose
letters agree by chance.

Equal entries are counted by partial aggregation before anything is shuffled, so a text that makes up
a third of all rows reaches its bucket as one counted entry; rows find their group again by
the 128-bit fingerprint of their entry, the few entries with a large part of all rows without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.arrow import map_lists
from skerry.llm.lookalikes import Rewriter, fit_rewriter
from skerry.llm.records import author_words, bare_doi, hash128, same_words, words
from skerry.sources.tables import materialize, release

#: Letters in the order in which they tell texts apart best.
_ORDER = "nitrsloedcmphufgbywkvjxzqa0123456789"
_AT = {c: i for i, c in enumerate(_ORDER)}
_STRIDE = 8
_FORMS = "record_sequence int, fp binary, canon binary, form string"
#: Entries with more than this part of all rows meet their rows by broadcast: fewer than its inverse.
HOT = 0.001


def _letters(ws: list[str]) -> bytes:
    counts, rest = bytearray(len(_ORDER)), []
    for c in "".join(ws):
        if (i := _AT.get(c)) is None:
            rest.append(c)
        elif counts[i] < 255:
            counts[i] += 1
    return bytes(counts) + "".join(sorted(rest)).encode()


def canonical(title: list[str], authors: list[str], doi: str | None) -> tuple[bytes, str, bytes]:
    """Canonical bytes, the words (title, then authors after a bar) in text order, and the
    fingerprint (128 bits) of both with the words sorted."""
    canon = _letters(title) + b"|" + _letters(authors) + b"|" + bare_doi(doi).encode()
    key = " ".join(sorted(title)) + "|" + " ".join(sorted(authors))
    return canon, " ".join(title) + "|" + " ".join(authors), hash128(canon + key.encode())


def canonical_rows(df: DataFrame, rewriter: Rewriter) -> DataFrame:
    """``record_sequence, fp, canon, form`` of every record with a title."""

    def make(batches: Iterator[list[list]]) -> Iterator[list[tuple]]:
        for batch in batches:
            out = []
            for seq, title, authors, doi in zip(*batch, strict=True):
                canon, form, fp = canonical(words(rewriter(title)), author_words(rewriter(authors)), doi)
                out.append((seq, fp, canon, form))
            yield out

    return map_lists(df.select("record_sequence", "title", "authors", "doi").where("title is not null and trim(title) <> ''"), make, _FORMS)


def combined(rows: DataFrame) -> DataFrame:
    """``fp, canon, form, n, first_sequence``: equal entries with their count and smallest record."""
    return rows.groupBy("fp", "canon", "form").agg(F.count("*").alias("n"), F.min("record_sequence").alias("first_sequence"))


def radix_buckets(entries: DataFrame, capacity: int, step: int = 2) -> DataFrame:
    """``entries`` with a ``bucket``: the shortest prefix of ``canon`` (in steps of ``step`` bytes)
    that at most ``capacity`` entries share.  What one entry's whole bytes share stays together."""
    done, still, depth, longest = [], entries, step, None
    while True:
        still = still.withColumn("bucket", F.substring("canon", 1, depth))
        big = still.groupBy("bucket").agg(F.count("*").alias("k")).where(F.col("k") > capacity).select("bucket")
        big = materialize(big, "radix")
        if big.isEmpty():
            release(big)
            done.append(still)
            break
        done.append(still.join(big, "bucket", "left_anti"))
        still = still.join(big, "bucket", "left_semi")
        depth += step
        if longest is None:
            longest = entries.agg(F.max(F.octet_length("canon"))).first()[0]
        if depth > longest + step:
            done.append(still)
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


class Trie:
    """Tries over byte strings with counters at the end of each string."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, key: bytes, form: str, fp: bytes, n: int, first: int) -> None:
        node = self.root
        for i in range(0, len(key), _STRIDE):
            node = node.setdefault(key[i : i + _STRIDE], {})
        node.setdefault(None, []).append((form, fp, n, first))

    def terminals(self) -> Iterator[list[tuple[str, bytes, int, int]]]:
        stack = [self.root]
        while stack:
            for edge, child in stack.pop().items():
                if edge is None:
                    yield child
                else:
                    stack.append(child)


def _classes(entries: list[tuple[str, bytes, int, int]]) -> list[list[tuple[str, bytes, int, int]]]:
    """Entries of one terminal by equal words."""
    forms: dict[bytes, list] = {}
    for e in entries:
        forms.setdefault(e[1], []).append(e)
    out: list[tuple[list[list[str]], list]] = []
    for same in forms.values():
        parts = [x.split() for x in same[0][0].split("|")]
        for heads, members in out:
            if all(same_words(a, b) for a, b in zip(heads, parts, strict=True)):
                members += same
                break
        else:
            out.append((parts, list(same)))
    return [m for _, m in out]


def _count_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    for row in zip(pdf.canon, pdf.form, pdf.fp, pdf.n, pdf.first_sequence, strict=True):
        trie.add(*row)
    out = []
    for entries in trie.terminals():
        for members in _classes(entries):
            n, first = sum(e[2] for e in members), min(e[3] for e in members)
            held: dict[bytes, int] = {}
            for _, fp, k, _ in members:
                held[fp] = held.get(fp, 0) + k
            out += [(fp, k, first, n) for fp, k in held.items()]
    return pd.DataFrame(out, columns=["fp", "n", "first_sequence", "copies"])


def count_buckets(bucketed: DataFrame) -> DataFrame:
    """``fp, n, first_sequence, copies`` of every entry of ``radix_buckets``: the rows of the
    entry, the smallest record and the number of records of its group."""
    return bucketed.groupBy("bucket").applyInPandas(_count_bucket, "fp binary, n bigint, first_sequence int, copies bigint")


def copy_groups(rows: DataFrame, capacity: int = 20_000) -> DataFrame:
    """``count_buckets`` of the entries of ``rows`` (of ``canonical_rows``)."""
    return count_buckets(radix_buckets(materialize(combined(rows), "entries"), capacity))


def with_groups(rows: DataFrame, groups: DataFrame, key: str, values: list[str], total: int, hot: float = HOT) -> DataFrame:
    """``rows`` with the ``values`` of their ``key`` in ``groups`` (one row a key), NULL for those that have none.

    ``n`` is the number of rows of a key.  Keys with more than a share ``hot`` of the ``total`` rows, fewer than
    1 / ``hot``, are broadcast and their rows stay where they are; the other keys are shuffled, and spread evenly."""
    often = F.col("n") > F.lit(hot * total)
    most = F.broadcast(groups.where(often).select(key, *values))
    rest = rows.join(most.select(key), key, "left_anti").join(groups.where(~often).select(key, *values).hint("merge"), key, "left")
    return rows.join(most, key).unionByName(rest)


def copies(df: DataFrame, capacity: int = 20_000, rewriter: Rewriter | None = None) -> DataFrame:
    """``record_sequence, first_sequence, copies`` of every record with a title.

    Expects ``record_sequence, title, authors, doi``; other columns are ignored.  NULL authors
    and DOIs equal empty ones, NULL or blank titles give no row.  Repeated rows count as copies
    but keep one row each.  Rows meet their group by fingerprint; single records need no partner.
    """
    rewriter = rewriter or fit_rewriter(df, ["title", "authors"])
    rows = materialize(canonical_rows(df, rewriter), "canonical")
    groups = materialize(copy_groups(rows, capacity).where("copies > 1"), "copy-groups")
    joined = with_groups(rows.select("record_sequence", "fp"), groups, "fp", ["first_sequence", "copies"], rows.count())
    return joined.select("record_sequence", F.coalesce("first_sequence", "record_sequence").alias("first_sequence"), F.coalesce("copies", F.lit(1)).alias("copies"))
