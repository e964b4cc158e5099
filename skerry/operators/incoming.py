"""New records against master records: exact title, DOI, and near titles within blocks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from skerry.sources.tables import materialize

#: Blocks of near titles and the columns that name them.
BLOCKS = ["year", "author_key", "title_prefix", "token_key"]
#: Letters counted together, seven to a number; a count of more than ``MOST`` goes on among the blanks.
LETTERS = [*"abcdefghijklmnopqrstuvwxyz01234567", "89"]
MOST = 51
#: Parts of a year's new titles, each compared with all the year's masters in a task of its own.
YEAR_PARTS = 8


def jaro_winkler_pair(a: str, b: str, weight: float = 0.1) -> float:
    """Jaro similarity raised by the common prefix of up to four characters."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, hits = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                hits.append(c)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (c for c, t in zip(b, taken, strict=True) if t), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * weight * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Similarity of two texts, 0 for NULL or empty ones."""

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler_pair(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


def _letters(title: Column) -> Column:
    """How often each letter and digit of a title key occurs: numbers of seven counts of a byte each (``l0``, ``l1``
    and on), and how many characters these leave out (``blanks``)."""
    counts = [F.least(F.length(title) - F.length(F.replace(title, F.lit(c), F.lit("")) if len(c) == 1 else F.translate(title, c, "")), F.lit(MOST)).cast("bigint") for c in LETTERS]
    packed = [sum((F.shiftleft(c, 8 * k) for k, c in enumerate(counts[i : i + 7])), F.lit(0).cast("bigint")).alias(f"l{i // 7}") for i in range(0, len(counts), 7)]
    return F.struct(*packed, (F.length(title) - sum(counts, F.lit(0))).cast("int").alias("blanks"))


def _start(title: Column) -> Column:
    """The first four characters of a title key as a number, the first in the highest byte."""
    return sum((F.shiftleft(F.coalesce(F.ascii(F.substring(title, k + 1, 1)), F.lit(0)).cast("bigint"), 24 - 8 * k) for k in range(4)), F.lit(0).cast("bigint"))


def _common(la: list[Column], lb: list[Column]) -> Column:
    """How many letters two titles have in common, of the numbers of ``_letters``.  Seven counts are compared at once: the top
    bit of a byte tells whether the first count is at least the second one."""
    top, low = F.lit(0x80808080808080), F.lit(0x00FF00FF00FF00FF)
    least = F.lit(0).cast("bigint")
    for x, y in zip(la, lb, strict=True):
        gap = x.bitwiseOR(top) - y
        least = least + (x - gap.bitwiseAND(gap.bitwiseAND(top) - F.shiftrightunsigned(gap.bitwiseAND(top), 7)))
    # bytes become pairs of bytes, whose sum is the remainder by 65535
    return (least.bitwiseAND(low) + F.shiftrightunsigned(least, 8).bitwiseAND(low)) % 65535


def _may_reach(x: dict[str, Column], y: dict[str, Column], least: float) -> Column:
    m = _common(*[[t[f"l{k}"] for k in range(-(-len(LETTERS) // 7))] for t in (x, y)]) + F.least(x["blanks"], y["blanks"])
    unlike = x["start"].bitwiseXOR(y["start"])
    # with p common characters in front: jaro + p / 10 (1 - jaro) >= least, where jaro is at most (m / n + m / n' + 1) / 3;
    # m stands in it once, as Java compiles no method beyond a certain size
    share = [3 * (least - 1e-9 - p * 0.1) / (1 - p * 0.1) - 1 for p in range(5)]
    enough = F.when(unlike == 0, share[4]).when(unlike < 1 << 8, share[3]).when(unlike < 1 << 16, share[2]).when(unlike < 1 << 24, share[1]).otherwise(share[0])
    # a threshold of s allows no less than 1 - 3 (1 - s) / 0.6 of the longer title
    ratio = 1 - (1 - least) / 0.6 * 3
    return (F.least(x["n"], y["n"]) >= F.greatest(x["n"], y["n"]) * ratio - 1e-9) & (m * (x["n"] + y["n"]) >= enough * x["n"] * y["n"])


def may_reach(a: Column, b: Column, la: Column, lb: Column, least: float) -> Column:
    """Whether two titles with letter counts ``la`` and ``lb`` can be ``least`` similar: the letters they have in
    common bound the matches of Jaro, the common prefix the rest.  Loses no pair, and needs no Python."""
    sides = [{f: letters[f] for f in ("blanks", *(f"l{k}" for k in range(-(-len(LETTERS) // 7))))} | {"n": F.length(t), "start": _start(t)} for t, letters in ((a, la), (b, lb))]
    return _may_reach(*sides, least)


def near_pairs(new: DataFrame, master: DataFrame, least: float) -> DataFrame:
    """``new_id, master_id, rank, similarity`` of the pairs of at least ``least`` similar titles in one of the
    ``BLOCKS``; ``rank`` is the first of their common blocks, from 0.

    All pairs of a block are compared by their letter counts, which loses none; only those that can be similar enough are shuffled
    and read as texts.  A block is joined by one short row for each title, whatever its words.
    """
    blocks = F.array(*[F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.xxhash64(F.lit(i), F.col(c).cast("string"))) for i, c in enumerate(BLOCKS)])
    titled = [t.where("title_key <> ''").select("id", F.lit(side).alias("side"), F.col("title_key").alias("t"), blocks.alias("b"), F.length("title_key").alias("n"), _start(F.col("title_key")).alias("start"), _letters(F.col("title_key")).alias("l")).select("id", "side", "t", "b", "n", "start", "l.*") for side, t in enumerate((new, master))]
    titled = materialize(titled[0].unionByName(titled[1]), "titles")
    facts = titled.select(*[c for c in titled.columns if c not in ("t", "b")], F.posexplode("b").alias("rank", "block")).where("block is not null")
    of_year = F.col("rank") == 0
    part = F.pmod(F.xxhash64("id"), F.lit(YEAR_PARTS)).cast("int")
    left = facts.where("side = 0").withColumn("part", F.when(of_year, part).otherwise(0))
    right = facts.where("side = 1").withColumn("part", F.explode(F.when(of_year, F.sequence(F.lit(0), F.lit(YEAR_PARTS - 1))).otherwise(F.array(F.lit(0)))))
    # few bytes, much work: a given number of partitions is left as it is
    tasks = 2 * int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [c for c in facts.columns if c not in ("side", "block")]
    left, right = (t.select(F.xxhash64("block", "part").alias(f"{side}_key"), *[F.col(c).alias(f"{side}_{c}") for c in columns]).repartition(tasks, f"{side}_key") for side, t in (("a", left), ("b", right)))
    x, y = ({c: F.col(f"{side}_{c}") for c in columns} for side in "ab")
    pairs = left.join(right.hint("merge"), (F.col("a_key") == F.col("b_key")) & _may_reach(x, y, least))
    pairs = pairs.groupBy(F.col("a_id").alias("new_id"), F.col("b_id").alias("master_id")).agg(F.min("a_rank").alias("rank"))
    for side, who, t in ((0, "new_id", "t"), (1, "master_id", "m_t")):
        pairs = pairs.join(titled.where(F.col("side") == side).select(F.col("id").alias(who), F.col("t").alias(t)), who)
    return pairs.withColumn("similarity", jaro_winkler(F.col("t"), F.col("m_t"))).where(F.col("similarity") >= least).select("new_id", "master_id", "rank", "similarity")


def match_incoming(new: DataFrame, master: DataFrame, possible: float = 0.965, probable: float = 0.985, with_doi: float = 0.90) -> DataFrame:
    """The best match of each new record: ``new_id, status, basis, master_id, similarity``.

    Both sides need ``id, title_key, doi_key, year, author_key, title_prefix, token_key``.  Order of tiers: exact
    title; DOI with a similar title; near title that shares year, author, prefix or first words; DOI
    where a title is missing; DOI with another title.  Ties go to the smallest master id.  Of equal titles
    under one key only the smallest master goes on, so repeated masters do not multiply, and similarity is
    computed once a pair; near titles are compared once for all records that repeat a title with the same blocks.
    """
    masters = master.groupBy("title_key").agg(F.min("id").alias("master_id"))
    exact = new.where("title_key <> ''").join(masters.where("title_key <> ''"), "title_key").select(F.col("id").alias("new_id"), "master_id", F.lit(1).alias("priority"), F.lit("duplicate").alias("status"), F.lit("exact title").alias("basis"), F.lit(1.0).alias("similarity"))
    by_doi = master.where("doi_key is not null").groupBy("doi_key", F.col("title_key").alias("m_title")).agg(F.min("id").alias("master_id"))
    asked = new.where("doi_key is not null").select(F.col("id").alias("new_id"), "title_key", "doi_key")
    doi = asked.select("title_key", "doi_key").distinct().join(by_doi, "doi_key").withColumn("similarity", jaro_winkler(F.col("title_key"), F.col("m_title")))
    missing = (F.col("title_key") == "") | (F.col("m_title") == "")
    doi = doi.withColumn("priority", F.when(F.col("similarity") >= with_doi, 2).when(missing, 5).otherwise(6))
    # of one DOI and title the best master is the same for all new records
    best = doi.groupBy("doi_key", "title_key").agg(F.min(F.struct("priority", (-F.col("similarity")).alias("s"), "master_id")).alias("x")).select("doi_key", "title_key", "x.*")
    status = F.when(F.col("priority") == 2, "duplicate").when(F.col("priority") == 5, "possible_duplicate").otherwise("doi_conflict_review")
    doi = asked.join(best, ["doi_key", "title_key"]).select("new_id", "master_id", "priority", status.alias("status"), F.lit("doi").alias("basis"), (-F.col("s")).alias("similarity"))
    rest = new.join(exact.select(F.col("new_id").alias("id")), "id", "left_anti")
    # records with one title and the same blocks meet the same masters: the first of them is compared, with the first of such masters
    alike = ["title_key", *BLOCKS]
    rest = rest.where("title_key <> ''").select("id", *alike, F.min("id").over(W.partitionBy(*alike)).alias("like"))
    rest = materialize(rest, "like-titles")
    near = near_pairs(rest.where("id = like").drop("like").distinct(), master.where("title_key <> ''").groupBy(*alike).agg(F.min("id").alias("id")), possible)
    # of these the best is the same for all that are alike
    near = near.groupBy("new_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "master_id", "rank")).alias("x")).select(F.col("new_id").alias("like"), (-F.col("x.s")).alias("similarity"), "x.master_id", "x.rank")
    near = rest.select(F.col("id").alias("new_id"), "like").distinct().join(near, "like")
    basis = F.element_at(F.array(*[F.lit(b) for b in ("same year", "same author", "title prefix", "first words")]), F.col("rank") + 1)
    near = near.select("new_id", "master_id", F.when(F.col("similarity") >= probable, 3).otherwise(4).alias("priority"), F.when(F.col("similarity") >= probable, "probable_duplicate").otherwise("possible_duplicate").alias("status"), basis.alias("basis"), "similarity")
    found = exact.unionByName(doi).unionByName(near)
    order = W.partitionBy("new_id").orderBy("priority", F.desc("similarity"), "master_id")
    top = found.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "priority")
    return new.select(F.col("id").alias("new_id")).join(top, "new_id", "left").withColumn("status", F.coalesce("status", F.lit("new")))
