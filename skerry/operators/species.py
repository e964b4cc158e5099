"""Species mentions, the filter for generic ones, and record-level assignment."""

from __future__ import annotations

import csv
import io
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skerry.functions.text import not_in_set
from skerry.operators.relational import require_columns
from skerry.operators.spans import dictionary, term_spans

# Species, their names and whether they are farmed.
SPECIES = """
species_id,preferred_name,scientific_name,synonym,synonym_type,is_farmed_candidate,default_group
SAL_SALAR,Atlantic salmon,Salmo salar,Atlantic salmon,common,TRUE,salmon
SAL_SALAR,Atlantic salmon,Salmo salar,Salmo salar,scientific,TRUE,salmon
SAL_SALAR,Atlantic salmon,Salmo salar,S. salar,abbreviation,TRUE,salmon
ONC_MYKISS,Rainbow trout,Oncorhynchus mykiss,Rainbow trout,common,TRUE,trout
ONC_MYKISS,Rainbow trout,Oncorhynchus mykiss,Oncorhynchus mykiss,scientific,TRUE,trout
ONC_MYKISS,Rainbow trout,Oncorhynchus mykiss,O. mykiss,abbreviation,TRUE,trout
ONC_MYKISS,Rainbow trout,Oncorhynchus mykiss,Steelhead,common,TRUE,trout
ONC_MYKISS,Rainbow trout,Oncorhynchus mykiss,Steelhead trout,common,TRUE,trout
ONC_MYKISS,Rainbow trout,Oncorhynchus mykiss,Salmo gairdneri,scientific,TRUE,trout
ONC_MYKISS,Rainbow trout,Oncorhynchus mykiss,Salmo gardineri,scientific,TRUE,trout
ONC_MYKISS,Rainbow trout,Oncorhynchus mykiss,Salmo gairdnerii,scientific,TRUE,trout
ONC_TSHAWYTSCHA,Chinook salmon,Oncorhynchus tshawytscha,Chinook salmon,common,TRUE,salmon
ONC_TSHAWYTSCHA,Chinook salmon,Oncorhynchus tshawytscha,Oncorhynchus tshawytscha,scientific,TRUE,salmon
ONC_KISUTCH,Coho salmon,Oncorhynchus kisutch,Coho salmon,common,TRUE,salmon
ONC_KISUTCH,Coho salmon,Oncorhynchus kisutch,Oncorhynchus kisutch,scientific,TRUE,salmon
ONC_NERKA,Sockeye salmon,Oncorhynchus nerka,Sockeye salmon,common,TRUE,salmon
ONC_NERKA,Sockeye salmon,Oncorhynchus nerka,Oncorhynchus nerka,scientific,TRUE,salmon
ONC_KETA,Chum salmon,Oncorhynchus keta,Chum salmon,common,TRUE,salmon
ONC_KETA,Chum salmon,Oncorhynchus keta,Oncorhynchus keta,scientific,TRUE,salmon
ONC_GORBUSCHA,Pink salmon,Oncorhynchus gorbuscha,Pink salmon,common,TRUE,salmon
ONC_GORBUSCHA,Pink salmon,Oncorhynchus gorbuscha,Oncorhynchus gorbuscha,scientific,TRUE,salmon
ONC_MASOU,Masu salmon,Oncorhynchus masou,Masu salmon,common,TRUE,salmon
ONC_MASOU,Masu salmon,Oncorhynchus masou,Oncorhynchus masou,scientific,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmon,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmon farm,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmon farms,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Farmed salmon,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmon aquaculture,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmon cage,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmon cages,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmon pen,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmon pens,generic,TRUE,salmon
SAL_TRUTTA,Brown trout,Salmo trutta,Brown trout,common,FALSE,trout
SAL_TRUTTA,Brown trout,Salmo trutta,Salmo trutta,scientific,FALSE,trout
SALVELINUS_ALPINUS,Arctic char,Salvelinus alpinus,Arctic char,common,FALSE,char
SALVELINUS_ALPINUS,Arctic char,Salvelinus alpinus,Salvelinus alpinus,scientific,FALSE,char
LEP_SALMONIS,Sea louse,Lepeophtheirus salmonis,Lepeophtheirus salmonis,scientific,FALSE,parasite
LEP_SALMONIS,Sea louse,Lepeophtheirus salmonis,Sea louse,common,FALSE,parasite
CAL_ELONGATUS,Sea louse,Caligus elongatus,Caligus elongatus,scientific,FALSE,parasite
GYR_SALARIS,Gyrodactylus salaris,Gyrodactylus salaris,Gyrodactylus salaris,scientific,FALSE,parasite
UNSPEC_SALMON,Unspecified farmed salmon,,Salmonid aquaculture,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmonid farm,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmonid farms,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Farmed salmonids,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Cultured salmonids,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Salmonid industry,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Caged salmonids,generic,TRUE,salmon
UNSPEC_SALMON,Unspecified farmed salmon,,Sea pen cultured salmonids,generic,TRUE,salmon
"""
# What a dictionary may say about a synonym and about farming.
SYNONYM_TYPES = ["common", "scientific", "abbreviation", "generic"]
FLAGS = ["TRUE", "FALSE"]
# Generic phrases that are never read as the wild species nearby.
FARMING_PHRASES = ["salmon farm", "salmon farms", "farmed salmon", "salmon aquaculture", "salmon cage", "salmon cages", "salmon pen", "salmon pens"]


def species_rows(text: str = SPECIES) -> list[dict]:
    """The dictionary's rows, in order; empty fields are ""."""
    rows = csv.DictReader(io.StringIO(text.strip()))
    return [{"term": r["synonym"], "species_id": r["species_id"], "preferred_name": r["preferred_name"], "scientific_name": r["scientific_name"], "farmed": r["is_farmed_candidate"] == "TRUE"} for r in rows]


def dictionary_violations(rows: DataFrame) -> DataFrame:
    """``rule, value``: what is wrong with a species dictionary (all columns STRING), nothing if it may be used.

    Rules: no blank id, name or synonym, known flags and synonym types, no row twice, a synonym of one species
    only, one preferred and one scientific name a species.  Missing columns are an error at once."""
    needed = ["species_id", "preferred_name", "scientific_name", "synonym", "synonym_type", "is_farmed_candidate", "default_group"]
    require_columns(rows, needed)
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    found = [rows.where(blank(F.col(c))).select(F.lit(f"blank {c}").alias("rule"), F.col("species_id").alias("value")) for c in ("species_id", "preferred_name", "synonym")]
    for column, allowed in (("is_farmed_candidate", FLAGS), ("synonym_type", SYNONYM_TYPES)):
        found.append(rows.where(not_in_set(F.col(column), allowed)).select(F.lit(f"invalid {column}").alias("rule"), F.col(column).alias("value")))
    found.append(rows.groupBy(*rows.columns).count().where("count > 1").select(F.lit("repeated row").alias("rule"), F.col("synonym").alias("value")))
    for group, counted, rule in (("synonym", "species_id", "synonym of several species"), ("species_id", "preferred_name", "several preferred names"), ("species_id", "scientific_name", "several scientific names")):
        found.append(rows.groupBy(group).agg(F.count_distinct(counted).alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.col(group).alias("value")))
    return reduce(DataFrame.unionByName, found)


def detect_species(df: DataFrame, key: str, rows: list[dict] | None = None, near: int = 120) -> DataFrame:
    """``key, mentions``: species in ``title`` and ``abstract``, the longest of overlapping names, with
    ``eligible``.  A generic salmon name within ``near`` characters (between midpoints, same field)
    of a named species of *Salmo* that is not farmed is not eligible, unless it is a farming phrase."""
    rows = rows or species_rows()
    terms = dictionary([{k: v for k, v in r.items() if k != "term"} for r in rows])

    def mention(s: Column) -> Column:
        e = F.get(terms, s["term"])
        names = [e[k].alias(k) for k in ("species_id", "preferred_name", "scientific_name", "farmed")]
        return F.struct(*names, s["matched"].alias("matched_term"), s["source"].alias("source"), s["start"].alias("match_start"), s["end"].alias("match_end"))

    df = term_spans(df, key, ["title", "abstract"], [r["term"] for r in rows])
    found = F.transform("spans", mention)
    df = df.select(key, found.alias("found"))
    middle = lambda m: (m["match_start"] + m["match_end"]) / 2
    wild = F.filter("found", lambda o: o["scientific_name"].rlike(r"(?i)^Salmo\s+[a-z-]+$") & ~o["farmed"])
    df = df.withColumn("wild", wild)

    def judged(m: Column) -> Column:
        generic = F.lower(m["preferred_name"]) == "unspecified farmed salmon"
        close = F.exists("wild", lambda o: (o["source"] == m["source"]) & (F.abs(middle(o) - middle(m)) <= near))
        return m.withField("eligible", ~(generic & ~F.lower(m["matched_term"]).isin(FARMING_PHRASES) & close))

    return df.select(key, F.transform("found", judged).alias("mentions"))


def assign_species(detected: DataFrame, key: str) -> DataFrame:
    """At least one row per record: farmed species (co-primary if several), or none with the reason.

    A generic salmon gives way to any named farmed salmon; rainbow trout does not count as one."""
    eligible = F.array_distinct(F.transform(F.filter("mentions", lambda m: m["eligible"]), lambda m: F.struct(m["preferred_name"].alias("name"), m["species_id"].alias("id"), m["farmed"].alias("farmed"))))
    detected = detected.select(key, eligible.alias("eligible"))
    eligible = F.col("eligible")
    base = detected.select(key, F.filter(eligible, lambda s: s["farmed"]).alias("farmed"), F.array_sort(F.array_distinct(F.transform(F.filter(eligible, lambda s: ~s["farmed"]), lambda s: s["name"]))).alias("others"))
    specific = F.exists("farmed", lambda s: ~s["id"].isin("UNSPEC_SALMON", "ONC_MYKISS"))
    base = base.withColumn("farmed", F.array_sort(F.filter("farmed", lambda s: ~(specific & (s["id"] == "UNSPEC_SALMON")))))
    n = F.size("farmed")
    rows = base.select(key, "others", n.alias("n"), F.explode_outer("farmed").alias("s"))
    return rows.select(
        key,
        F.col("s.id").alias("farmed_species_id"),
        F.col("s.name").alias("farmed_species"),
        F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "primary").otherwise("co-primary").alias("assignment_role"),
        (F.col("n") == 0).alias("review_required"),
        F.when(F.col("n") == 1, "One eligible farmed species detected")
        .when(F.col("n") > 1, F.concat(F.col("n").cast("string"), F.lit(" eligible farmed species detected; none treated as primary")))
        .when(F.size("others") > 0, "Only non-target species detected")
        .otherwise("No eligible farmed species detected")
        .alias("assignment_reason"),
        F.nullif(F.array_join("others", "; "), F.lit("")).alias("non_target_species"),
    )
