"""How assigned sets and scores compare with what is known to be right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ratio(a: Column, b: Column, empty: Column | None = None) -> Column:
    """a / b, or ``empty`` (NULL) where b is 0."""
    r = F.when(b != 0, a / b)
    return r.otherwise(empty) if empty is not None else r


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def record_metrics(gold: DataFrame, predicted: DataFrame, key: str, code: str) -> DataFrame:
    """Per record of ``gold`` ∪ ``predicted``: true and false positives, misses, precision (1 if both sets are
    empty), recall (1 without gold), F1 and whether the sets are equal."""
    both = gold.select(key, code).distinct().withColumn("g", F.lit(1)).join(predicted.select(key, code).distinct().withColumn("p", F.lit(1)), [key, code], "full")
    per = both.groupBy(key).agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    precision = ratio(F.col("tp"), F.col("tp") + F.col("fp"), F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(0.0))
    per = per.withColumn("precision", precision).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"), F.lit(1.0)))
    return per.withColumn("f1", f1(F.col("precision"), F.col("recall"))).withColumn("exact", (F.col("fp") == 0) & (F.col("fn") == 0))


def code_metrics(gold: DataFrame, predicted: DataFrame, key: str, code: str) -> DataFrame:
    """The same for each code over all records."""
    both = gold.select(key, code).distinct().withColumn("g", F.lit(1)).join(predicted.select(key, code).distinct().withColumn("p", F.lit(1)), [key, code], "full")
    per = both.groupBy(code).agg(F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    return per.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def micro_macro(per_record: DataFrame) -> DataFrame:
    """One row: micro precision, recall and F1 of the summed counts, and the means over records."""
    one = per_record.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.avg(F.col("exact").cast("double")).alias("exact_share"))
    one = one.withColumn("micro_precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("micro_recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return one.withColumn("micro_f1", f1(F.col("micro_precision"), F.col("micro_recall")))


def disagreements(gold: DataFrame, predicted: DataFrame, key: str, code: str) -> DataFrame:
    """``key, code, kind``: codes that are missing or extra."""
    g, p = gold.select(key, code).distinct(), predicted.select(key, code).distinct()
    return g.join(p, [key, code], "left_anti").withColumn("kind", F.lit("missing")).unionByName(p.join(g, [key, code], "left_anti").withColumn("kind", F.lit("extra")))


#: Ranges of thresholds that are summed apart.
RANGES = 200


def threshold_sweep(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Counts and rates at every distinct score as threshold (positive at or above it).

    The sums run down within ``RANGES`` ranges of scores, offset by the ranges above, so no task sorts all scores."""
    per = scored.groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label)).alias("pos"), F.count_if(~F.col(label)).alias("neg"))
    splits = per.agg(F.percentile_approx("threshold", [i / RANGES for i in range(1, RANGES)], 10 * RANGES)).first()[0] or []
    per = per.withColumn("_b", F.size(F.filter(F.array(*[F.lit(x) for x in sorted(set(splits))]), lambda x: x < F.col("threshold"))))
    ranges = per.groupBy("_b").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    above = W.orderBy(F.desc("_b"))
    ranges = ranges.select("_b", (F.sum("_p").over(above) - F.col("_p")).alias("_p"), (F.sum("_n").over(above) - F.col("_n")).alias("_n"))
    down = W.partitionBy("_b").orderBy(F.desc("threshold"))
    total = per.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    out = per.join(F.broadcast(ranges), "_b").withColumn("tp", F.sum("pos").over(down) + F.col("_p")).withColumn("fp", F.sum("neg").over(down) + F.col("_n")).crossJoin(F.broadcast(total))
    out = out.withColumn("fn", F.col("p") - F.col("tp")).withColumn("tn", F.col("n") - F.col("fp"))
    rates = [("sensitivity", "tp", "fn"), ("specificity", "tn", "fp"), ("precision", "tp", "fp"), ("npv", "tn", "fn")]
    return out.select("threshold", "tp", "fp", "fn", "tn", *[ratio(F.col(a), F.col(a) + F.col(b)).alias(name) for name, a, b in rates])


def operating_thresholds(sweep: DataFrame, sensitivity: float = 0.99, precision: float = 0.95) -> DataFrame:
    """``exclude_below``: the largest threshold that keeps the sensitivity (0 if none); ``include_from``: the smallest
    that keeps the precision with a true positive (1 if none).

    Where they cross, ``include_from`` becomes the larger of ``exclude_below`` + 0.05 and the first quartile of the
    positives' scores, at most 1.  ``sweep`` is read twice."""
    low = F.coalesce(F.max(F.when(F.col("sensitivity") >= sensitivity, F.col("threshold"))), F.lit(0.0))
    high = F.coalesce(F.min(F.when((F.col("precision") >= precision) & (F.col("tp") > 0), F.col("threshold"))), F.lit(1.0))
    found = sweep.agg(low.alias("exclude_below"), high.alias("include_from"), F.max("tp").alias("n"))
    # interpolated quartile: the positive of rank r from below is at the largest threshold that keeps n - r of them
    place = (F.col("n") - 1) * 0.25
    lo, hi = (F.max(F.when(F.col("tp") >= F.col("n") - r(place), F.col("threshold"))) for r in (F.floor, F.ceil))
    quartile = sweep.select("threshold", "tp").crossJoin(F.broadcast(found.select("n"))).groupBy("n").agg(lo.alias("lo"), hi.alias("hi")).select((F.col("lo") + (F.col("hi") - F.col("lo")) * (place - F.floor(place))).alias("q"))
    mended = F.least(F.lit(1.0), F.greatest(F.col("exclude_below") + 0.05, F.coalesce("q", F.lit(0.0))))
    return found.join(F.broadcast(quartile), F.lit(True), "left").select("exclude_below", F.when(F.col("include_from") <= F.col("exclude_below"), mended).otherwise(F.col("include_from")).alias("include_from"))


def version_outcomes(first: DataFrame, second: DataFrame, gold: DataFrame, key: str, code: str) -> DataFrame:
    """``key, first_set, second_set, gold_set, outcome, review_required`` of every record of the three: how the
    second version's set compares with the first one's and the right one.  Without a right set the outcome asks
    for inspection; sets are sorted and joined by "; "."""
    sets = [d.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(code)), "; ").alias(n)) for d, n in ((first, "first_set"), (second, "second_set"), (gold, "gold_set"))]
    both = sets[0].join(sets[1], key, "full").join(sets[2], key, "full").fillna("", ["first_set", "second_set", "gold_set"])
    a, b = F.col("first_set") == F.col("gold_set"), F.col("second_set") == F.col("gold_set")
    outcome = (
        F.when(F.col("gold_set") == "", "No gold standard").when(a & b, "Unchanged correct").when(b, "Improved").when(a, "Regressed")
        .when(F.col("first_set") == F.col("second_set"), "Unchanged incorrect").otherwise("Changed but still incorrect")
    )
    return both.withColumn("outcome", outcome).withColumn("review_required", F.col("outcome").isin("No gold standard", "Regressed", "Changed but still incorrect"))
