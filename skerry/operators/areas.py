"""Which of the areas a record mentions it is about, and the gazetteers that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skerry.functions.text import collapse_unique, squish
from skerry.operators.relational import expect_none, filter_case

# Phrases in the words around a place, in lower case.
ARTEFACTS = """
copyright | all rights reserved | creative commons | published by | publisher | springer | elsevier | wiley | taylor & francis
translate with | translation | language selector | software | version | manufacturer | manufactured by | supplied by | provided by
purchased from | equipment | instrument | microscope | camera | reader | incubator | analyser | analyzer
"""
LOCATIONS = """
conducted in | conducted at | study was carried out in | study was undertaken in | study was performed in | study area | study site
study sites | sampled in | sampled from | samples were collected in | samples were collected from | collected in | collected from
obtained in | obtained from | farms in | farm in | fish farms in | aquaculture farms in | sites in | site in | located in | reared in
raised in | cultured in | produced in | originating from | originated from | surveyed in | interviewed in | fieldwork in | case study in
"""
ENTITIES = """
stakeholder | stakeholders | farmer | farmers | producer | producers | company | companies | industry | industries | farm | farms
hatchery | hatcheries | population | populations | community | communities | river | rivers | lake | lakes | site | sites
"""
BACKGROUND = """
previous studies in | previous research in | reported in | reported from | compared with | compared to | unlike | elsewhere in
for example in | such as | including
"""
FISH = ["salmon", "trout", "char", "grayling", "fish"]
# Names that are never places, kinds of names matched in any case, compass words.
BLOCKED = """
along bay can central east eastern field green lake lice male marine mobile much north northern normal orange reading river south
southern spring tank union west western young black white brown culture growth fish salmon trout
""".split()
ANY_CASE = ["country", "country name", "country variant", "country abbreviation", "demonym", "constituent country", "territory", "subnational region", "marine region", "transnational marine region", "cross-border region"]
COMPASS = "america north south east west northern southern eastern western northeast northwest southeast southwest".split()


def phrases(text: str) -> list[str]:
    """The phrases of a list above."""
    return [p.strip() for line in text.strip().splitlines() for p in line.split("|")]


def has_any(c: Column, listed: list[str]) -> Column:
    """Whether a lower-case text has one of the phrases in it."""
    return F.exists(F.array(*[F.lit(p) for p in listed]), lambda p: F.contains(c, p))


def strict_areas(mentions: DataFrame, key: str, is_region: Column) -> DataFrame:
    """``key, areas, n_areas, reason, review_required, review_reason``: at most one area of an abstract, all areas of a
    title.

    ``mentions`` has ``source, area, context, matched_text``; ``is_region`` marks mentions of regions, which are no areas.
    Mentions in publishers' or suppliers' phrases, and those that describe fish ("X salmon"), are dropped.  Areas in the
    title override the abstract.  A title with a region and no area, and an exact tie of the best areas
    of an abstract (tier of evidence, substantial mentions, all mentions), assign none and ask for review.  Records without
    any area left give no row.  A NULL area or context is no mention.
    """
    c = F.lower("context")
    of_fish = F.exists(F.array(*[F.lit(f) for f in FISH]), lambda f: F.contains(c, F.concat(F.lower("matched_text"), F.lit(" "), f)))
    region = F.coalesce(is_region, F.lit(False))
    title = F.col("source") == "title"
    tier = F.when(title, 1).when(has_any(c, phrases(LOCATIONS)), 2).when(has_any(c, phrases(ENTITIES)) & ~has_any(c, phrases(BACKGROUND)), 3).when(has_any(c, phrases(BACKGROUND)), 5).otherwise(4)
    kept = mentions.where((region & title) | (~region & ~has_any(c, phrases(ARTEFACTS)) & ~of_fish & F.col("area").isNotNull()))
    rows = kept.select(key, F.when(~region, F.col("area")).alias("area"), title.alias("title"), tier.alias("tier"))
    per = rows.groupBy(key, "area").agg(F.min("tier").alias("tier"), F.count_if("title").alias("n_title"), F.count_if(F.col("tier") <= 3).alias("n_strong"), F.count("*").alias("n"))
    of = W.partitionBy(key)
    area = F.col("area").isNotNull()
    per = per.withColumn("titled", F.count_if(area & (F.col("n_title") > 0)).over(of)).withColumn("scope", F.bool_or(~area).over(of))
    best = W.partitionBy(key, area).orderBy("tier", F.desc("n_strong"), F.desc("n"))
    per = per.withColumn("rank", F.rank().over(best)).withColumn("ties", F.count_if(area & (F.col("rank") == 1)).over(of)).where(area)
    by_title = (F.col("titled") > 0) & (F.col("n_title") > 0)
    chosen = by_title | ((F.col("titled") == 0) & ~F.col("scope") & (F.col("rank") == 1) & (F.col("ties") == 1))
    reason = (
        F.when(by_title & (F.col("titled") == 1), "one area in the title").when(by_title, "areas named together in the title")
        .when(F.col("tier") == 2, "study location").when(F.col("tier") == 3, "study entity").when(F.col("tier") == 4, "dominant mention").otherwise("strongest evidence")
    )
    review = F.when((F.col("titled") == 0) & F.col("scope"), "title names a region").when((F.col("titled") == 0) & (F.col("ties") > 1), "best areas are tied")
    per = per.withColumn("chosen", F.when(chosen, F.col("area"))).withColumn("reason", F.when(chosen, reason)).withColumn("review", review)
    out = per.groupBy(key).agg(collapse_unique(F.col("chosen")).alias("areas"), F.count_distinct("chosen").alias("n_areas"), collapse_unique(F.col("reason")).alias("reason"), F.max("review").alias("review_reason"))
    return out.select(key, "areas", "n_areas", "reason", F.col("review_reason").isNotNull().alias("review_required"), "review_reason")


def study_areas(mentions: DataFrame, key: str, strong: list[str], background: list[str], artefacts: list[str]) -> DataFrame:
    """``key, area, evidence, reason, n_unresolved``: all areas of a title; areas of an abstract in a strong context, or the
    only one of a record without area in its title, outside a background context.

    ``n_unresolved`` counts the record's other areas; a record where no area is taken has one row with a NULL area.
    The phrases are lower-case; mentions in artefacts, and NULL areas, are dropped first.
    """
    c = F.lower("context")
    rows = mentions.where(F.col("area").isNotNull() & ~has_any(c, artefacts)).select(key, "area", (F.col("source") == "title").alias("title"), has_any(c, strong).alias("strong"), has_any(c, background).alias("background"))
    inside = ~F.col("title")
    per = rows.groupBy(key, "area").agg(F.bool_or("title").alias("title"), F.bool_or(inside).alias("inside"), F.bool_or(inside & F.col("strong")).alias("strong"), F.bool_or(inside & ~F.col("background")).alias("plain"))
    of = W.partitionBy(key)
    per = per.withColumn("titled", F.bool_or("title").over(of)).withColumn("n_inside", F.count_if("inside").over(of))
    reason = (
        F.when(F.col("title"), "named in the title").when(F.col("titled") & F.col("strong"), "further area of the study").when(F.col("strong"), "area of the study")
        .when(~F.col("titled") & (F.col("n_inside") == 1) & F.col("plain"), "only area of the abstract")
    )
    per = per.withColumn("reason", reason).withColumn("n_unresolved", F.count_if(F.col("reason").isNull()).over(of)).withColumn("n_taken", F.count("reason").over(of)).withColumn("_row", F.row_number().over(of.orderBy("area")))
    per = per.where(F.col("reason").isNotNull() | ((F.col("n_taken") == 0) & (F.col("_row") == 1)))
    taken = F.col("reason").isNotNull()
    return per.select(key, F.when(taken, F.col("area")).alias("area"), F.when(F.col("title"), "title").when(taken, "abstract").alias("evidence"), "reason", "n_unresolved")


def filter_gazetteer(gazetteer: DataFrame) -> DataFrame:
    """A gazetteer (``place, kind, population``) without ordinary words and risky short names, with ``requires_case``:
    towns need five letters and 100,000 inhabitants or two words, first-order divisions five letters or two words."""
    words, letters = F.size(F.split(squish(F.col("place")), " ")), F.char_length("place")
    kept = gazetteer.withColumn("requires_case", ~F.coalesce(F.col("kind").isin(ANY_CASE), F.lit(False))).where(~F.lower(squish(F.col("place"))).isin(BLOCKED))
    towns = F.col("kind").isin("populated place", "populated place variant")
    return filter_case(kept, [(towns, (letters >= 5) & ((F.col("population") >= 100_000) | (words >= 2))), (F.startswith("kind", F.lit("admin1")), (letters >= 5) | (words >= 2))], F.lit(True))


def apply_review(gazetteer: DataFrame, review: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gazetteer (``place, area, kind``) without the rows a review (the same and ``decision``: keep or remove)
    removes, and the log of decided rows.  Other decisions, and two for one name, are errors; undecided rows
    stay."""
    on = ["_name", "area", "kind"]
    name = F.lower(squish(F.col("place")))
    asked = review.select(name.alias("_name"), "area", "kind", F.lower(squish(F.col("decision"))).alias("decision")).distinct()
    expect_none(asked, ~F.coalesce(F.col("decision").isin("keep", "remove"), F.lit(False)), "the decision is neither keep nor remove")
    expect_none(asked.groupBy(*on).agg(F.count("*").alias("n")), F.col("n") > 1, "two decisions for one name")
    both = gazetteer.withColumn("_name", name).join(asked, on, "left").withColumn("review_decision", F.coalesce("decision", F.lit("not observed")))
    out = both.select(*gazetteer.columns, "review_decision")
    return out.where("review_decision <> 'remove'"), out.where("review_decision <> 'not observed'")


def with_regions(gazetteer: DataFrame, regions: DataFrame, overrides: DataFrame) -> DataFrame:
    """The gazetteer (``place, area, priority, ...``) with ``region``: compass words are dropped, regions (``place, region``)
    added without area at priority 200, overrides (``place, area``) at 250 in place of all rows of their name."""
    name = F.lower(squish(F.col("place")))
    kept = gazetteer.where(~name.isin(COMPASS)).join(overrides.select(name.alias("_n")).distinct(), name == F.col("_n"), "left_anti").withColumn("region", F.lit(None).cast("string"))
    added = regions.select("place", "region", F.lit(200).alias("priority"))
    exact = overrides.select("place", "area", F.lit(250).alias("priority"))
    return kept.unionByName(added, allowMissingColumns=True).unionByName(exact, allowMissingColumns=True)


def canonical_names(mentions: DataFrame, code: str, name: str, names: DataFrame) -> DataFrame:
    """``mentions`` with one ``name`` for each ``code``: the one of the table ``names``, else the smallest that the mentions
    have."""
    own = mentions.where(F.col(code).isNotNull()).groupBy(code).agg(F.min(name).alias("_own"))
    known = own.join(names.select(code, F.col(name).alias("_given")), code, "left").select(code, F.coalesce("_given", "_own").alias("_name"))
    return mentions.join(known, code, "left").withColumn(name, F.coalesce("_name", name)).drop("_name").select(mentions.columns)
