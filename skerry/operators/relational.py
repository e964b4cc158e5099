"""Relational helpers: first rows, groups, samples, profiles - each with an explicit order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skerry.sources.tables import materialize


def require_columns(df: DataFrame, columns: list[str]) -> None:
    """Raise if a column is missing; looks at the schema only."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def distinct_keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order; NULL keys form one group."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def top_per_group(df: DataFrame, keys: list[str], order: list[str | Column], n: int = 1) -> DataFrame:
    """At most ``n`` rows of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def keep_max_in_group(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the largest value of their group, ties included: the maxima are joined back, so no group is held
    in one task.  NULL keys and values give no rows."""
    top = df.groupBy(*keys).agg(F.max(value).alias(value))
    return df.join(top, [*keys, value], "left_semi").select(df.columns)


def add_count(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    """Rows with the size of their group: an aggregate joined back, so no group is held in one task."""
    counts = df.groupBy(*keys).agg(F.count("*").alias(name))
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(counts[k]) for k in keys])
    return df.join(counts, on).select(df["*"], counts[name])


def drop_general_if_specific(df: DataFrame, keys: list[str], is_general: Column) -> DataFrame:
    """Rows of a group without the general ones where a specific one exists."""
    w = W.partitionBy(*keys)
    return df.withColumn("_s", F.bool_or(~is_general).over(w)).where(~is_general | ~F.col("_s")).drop("_s")


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """``field, n_missing, percent``: NULLs of each column, from one pass."""
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["_n"], columns, "field", "n_missing").select("field", "n_missing", F.round(100.0 * F.col("n_missing") / F.col("_n"), 4).alias("percent"))


def hash_order(key: str, seed: int) -> Column:
    """An order that looks random and is the same in every run and engine."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))


def sample_up_to(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in hash order, or all if there are fewer."""
    return df.orderBy(hash_order(key, seed), key).limit(n)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each stratum in hash order."""
    return top_per_group(df, [stratum], [hash_order(key, seed), key], n)


def batch_numbers(df: DataFrame, key: str, size: int, range_rows: int = 1_000_000) -> DataFrame:
    """``batch`` from 1 in the order of an integer key, ``size`` rows each.

    Numbers run within ranges of the key, of about ``range_rows`` rows each, offset by the ranges before them, so
    the order is global without one task that sorts everything."""
    spread = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n")).first()
    buckets = max(256, -(-spread["n"] // range_rows))
    if spread is None or spread["lo"] is None:
        return df.withColumn("batch", F.lit(None).cast("bigint"))
    width = max(1, -(-(spread["hi"] - spread["lo"] + 1) // buckets))
    ranged = df.withColumn("_b", ((F.col(key) - spread["lo"]) / width).cast("int"))
    sizes = ranged.groupBy("_b").agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_before", F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).drop("_n")
    place = F.row_number().over(W.partitionBy("_b").orderBy(key)) + F.col("_before")
    return ranged.join(F.broadcast(sizes), "_b").withColumn("batch", F.ceil(place / size)).drop("_b", "_before")


def incomplete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with a NULL in any of the columns."""
    return df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]))


def filter_case(df: DataFrame, cases: list[tuple[Column, Column]], otherwise: Column) -> DataFrame:
    """Rows that meet the predicate of the first case whose condition they meet; NULL predicates drop the row."""
    chosen = reduce(lambda w, c: w.when(*c), cases[1:], F.when(*cases[0])) if cases else None
    return df.where(otherwise if chosen is None else chosen.otherwise(otherwise))


def add_distinct_count(df: DataFrame, keys: list[str], value: str, name: str, count_null: bool = False) -> DataFrame:
    """Rows with the number of different values in their group; NULL counts as one only with ``count_null``."""
    n = F.count_distinct(value)
    counts = df.groupBy(*keys).agg((n + F.max(F.col(value).isNull().cast("int")) if count_null else n).alias(name))
    on = reduce(lambda a, b: a & b, [df[k].eqNullSafe(counts[k]) for k in keys])
    return df.join(counts, on).select(df["*"], counts[name])


def union_distinct(*parts: DataFrame) -> DataFrame:
    """The different rows of all parts, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in an order that looks random and is the same in every run."""
    return df.orderBy(hash_order(key, seed), key)


def disjoint_strata(df: DataFrame, key: str, strata: dict[str, Column], n: int, seed: int, fill: str = "fill") -> DataFrame:
    """``df`` with ``stratum``: up to ``n`` rows of each stratum, one after another, none twice; what short strata
    lack is filled from all other rows.  Needs a unique key.  A condition that is NULL is not met."""
    taken = None
    for name, condition in [*strata.items(), (fill, F.lit(True))]:
        want = n if name != fill else n * len(strata) - (taken.count() if taken is not None else 0)
        pool = df.where(F.coalesce(condition, F.lit(False)))
        if taken is not None:  # at most n rows a stratum
            pool = pool.join(F.broadcast(taken.select(key)), key, "left_anti")
        part = materialize(sample_up_to(pool, key, want, seed).withColumn("stratum", F.lit(name)), "stratum")
        taken = part if taken is None else taken.unionByName(part)
    return taken


def second_largest(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys, name``: the second largest value of each group, repeats counted, NULL if there is none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys).orderBy(F.desc(value))
    ranked = counts.withColumn("_r", F.row_number().over(w)).where("_r <= 2")
    second = F.coalesce(F.max(F.when((F.col("_r") == 1) & (F.col("_n") > 1), F.col(value))), F.max(F.when(F.col("_r") == 2, F.col(value))))
    return df.select(*keys).distinct().join(ranked.groupBy(*keys).agg(second.alias(name)), keys, "left")


def expect_none(df: DataFrame, condition: Column, what: str) -> None:
    """Raise if rows meet the condition."""
    if n := df.where(condition).count():
        raise ValueError(f"{n} rows: {what}")
