"""Places in text by token n-grams, their resolution, and what they say about a record."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skerry.functions.text import collapse_unique
from skerry.operators.spans import context, tokens

#: First words of names up to which they are a set that every row's tokens are tested against; with more of
#: them every token starts a candidate.
FIRST_WORDS = 20_000
#: Gazetteer rows up to which it is broadcast; a larger one is joined by shuffle.
BROADCAST_NAMES = 200_000


def match_places(df: DataFrame, key: str, fields: list[str], gazetteer: DataFrame, width: int = 12) -> DataFrame:
    """Mentions of gazetteer places: ``key, source, token_start, token_end, token_length, matched_text,
    context`` and the gazetteer's columns.  A place of several areas gives several rows.

    Names are looked up by an equi-join of lower-case n-grams, up to the longest name's number of tokens; where
    ``requires_case`` the spelling must be the gazetteer's.  Only tokens that begin a name start n-grams, and
    the few rows that do carry their context along, so the text itself is never shuffled.  NULL texts and
    blank names match nothing.
    """
    names = gazetteer.where("trim(place) <> ''").withColumn("_ngram", F.array_join(tokens(F.lower("place")), " ")).withColumn("_size", F.size(tokens(F.col("place"))))
    size = names.agg(F.max("_size"), F.count("*")).first()
    first = names.select(F.split_part("_ngram", F.lit(" "), F.lit(1)).alias("w")).distinct().limit(FIRST_WORDS + 1).collect()
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("source"), tokens(F.col(f)).alias("toks")) for f in fields])).alias("f")).select(key, "f.*")
    begins = F.transform("toks", lambda t, i: F.when(F.lower(t).isin([r[0] for r in first]), i + 1)) if len(first) <= FIRST_WORDS else F.sequence(F.lit(1), F.size("toks"))
    starts = long.where(F.size("toks") > 0).withColumn("_starts", F.filter(begins, lambda p: p.isNotNull())).where(F.size("_starts") > 0)
    runs = starts.select(key, "source", "toks", F.explode("_starts").alias("token_start"))
    runs = runs.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(size[0] or 1), F.size("toks") - F.col("token_start") + 1))).alias("token_length"))
    runs = runs.withColumn("ngram", F.array_join(F.slice("toks", F.col("token_start"), F.col("token_length")), " ")).withColumn("_ngram", F.lower("ngram"))
    small = F.broadcast(names) if size[1] <= BROADCAST_NAMES else names
    # the context is cut out first, so a shuffled join would carry it alone
    runs = runs.withColumn("context", context(F.col("toks"), F.col("token_start"), F.col("token_length"), width)).drop("toks")
    hits = runs.join(small, "_ngram").where(~F.col("requires_case") | (F.col("ngram") == F.col("place")))
    return hits.select(
        key, "source", "token_start", (F.col("token_start") + F.col("token_length") - 1).alias("token_end"), "token_length", F.col("ngram").alias("matched_text"), "context", *gazetteer.columns,
    )


def outermost(mentions: DataFrame, key: str) -> DataFrame:
    """Mentions that no strictly longer one of the same field contains: the mentions of a field meet once, and a
    name's place in them is settled in the array."""
    rest = [c for c in mentions.columns if c not in (key, "source")]
    held = mentions.groupBy(key, "source").agg(F.collect_list(F.struct(*rest)).alias("m"))
    longer = lambda o, s: (o["token_start"] <= s["token_start"]) & (o["token_end"] >= s["token_end"]) & (o["token_length"] > s["token_length"])
    return held.select(key, "source", F.inline(F.filter("m", lambda s: ~F.exists("m", lambda o: longer(o, s))))).select(mentions.columns)


def best_priority(mentions: DataFrame, key: str) -> DataFrame:
    """Of each span the rows of the highest priority, ties included."""
    w = W.partitionBy(key, "source", "token_start", "token_end").orderBy(F.desc("priority"))
    return mentions.withColumn("_r", F.rank().over(w)).where("_r = 1").drop("_r")


def drop_by_context(mentions: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Mentions whose context meets none of the patterns."""
    return mentions.where(~reduce(lambda a, b: a | b, [F.col("context").rlike(p) for p in patterns.values()]))


def summarise_places(records: DataFrame, mentions: DataFrame, key: str) -> DataFrame:
    """One row for every record: its places and areas, their numbers, and whether to review it."""
    per = mentions.groupBy(key).agg(
        collapse_unique(F.col("place")).alias("places"), collapse_unique(F.col("area")).alias("areas"), F.count("*").alias("n_mentions"), F.count_distinct("area").alias("n_areas"), F.bool_or("ambiguous").alias("ambiguous")
    )
    out = records.select(key).join(per, key, "left").fillna(0, ["n_mentions", "n_areas"])
    return out.withColumn("review_required", F.coalesce(F.col("ambiguous"), F.lit(False)) | (F.col("n_areas") > 1)).drop("ambiguous")


def score_rules(mentions: DataFrame, key: str, rules: list[tuple[str, str, float]], title_score: float) -> DataFrame:
    """Weighted evidence of each area: rule scores of its contexts, the title's own, and a bonus of 2 for
    each further mention, 6 at most.  6 assigns, from 3 it is borderline."""
    total = F.when(F.col("source") == "title", F.lit(title_score)).otherwise(F.lit(0.0))
    for _, pattern, score in rules:
        total = total + F.when(F.col("context").rlike(pattern), F.lit(float(score))).otherwise(F.lit(0.0))
    per = mentions.withColumn("score", total).groupBy(key, "area").agg(F.sum("score").alias("raw_score"), F.count("*").alias("n_mentions"))
    per = per.withColumn("score", F.col("raw_score") + F.least(F.greatest(F.col("n_mentions") - 1, F.lit(0)) * 2, F.lit(6)))
    return per.withColumn("decision", F.when(F.col("score") >= 6, "assign").when(F.col("score") >= 3, "borderline").otherwise("reject"))


def primary_area(mentions: DataFrame, key: str, study: str, entity: str, artefact: str) -> DataFrame:
    """The areas at the best tier of evidence: title, study cue, entity cue, other; artefacts are dropped.
    One is assigned, two are both assigned, of more the best-ranked; more than one asks for review."""
    c: Column = F.col("context")
    tier = F.when(F.col("source") == "title", 1).when(c.rlike(study), 2).when(c.rlike(entity), 3).when(c.rlike(artefact), 99).otherwise(4)
    per = mentions.withColumn("tier", tier).where("tier < 99").groupBy(key, "area").agg(F.min("tier").alias("tier"), F.count_if(F.col("source") == "title").alias("n_title"), F.count_if(F.col("tier") <= 3).alias("n_strong"), F.count("*").alias("n_mentions"))
    w = W.partitionBy(key)
    best = per.withColumn("best", F.min("tier").over(w)).where(F.col("tier") == F.col("best"))
    best = best.withColumn("n_best", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy("tier", F.desc("n_title"), F.desc("n_strong"), F.desc("n_mentions"), "area")))
    return best.where((F.col("n_best") <= 2) | (F.col("rank") == 1)).select(key, "area", "tier", "n_mentions", (F.col("n_best") > 1).alias("review_required"))
