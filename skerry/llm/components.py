"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.sources.tables import materialize, release


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) of all nodes of ``links`` (columns ``a``, ``b``).

    Alternates large-star and small-star steps (every node hands the smallest node it knows to
    its neighbours), which keeps the link table no larger than it was and needs a number of
    rounds that grows with the logarithm of the longest chain.  A node with many links is
    aggregated by partial minima, its neighbours are never gathered in one task.  Joins merge: links are two
    numbers, so tables that Spark takes for small have too many rows to be broadcast.  Loops and
    repeated links do no harm; an empty table has no components.  Links that have not settled after ``rounds``
    rounds are an error, never a partial result.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: neighbours above a node go to its smallest neighbour
        star = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        star = star.unionByName(least.where("m <> u").select("u", F.col("m").alias("v"))).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, edges = edges, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(last)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"links not settled after {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
