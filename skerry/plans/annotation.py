"""Queries that annotate records with species and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.operators import areas as A
from skerry.operators import ontology as O
from skerry.operators import places as P
from skerry.operators.spans import dictionary, with_spans
from skerry.operators.species import assign_species, detect_species, species_rows
from skerry.operators.topics import assign_topics, detect_topics, topic_rows
from skerry.sources.tables import table

# A small gazetteer of rearing sites with nested, shared and case-bound names.
GAZETTEER = """
net pens | sea | 60 | false | false
open net pens | sea | 80 | false | false
sea cages | sea | 60 | false | false
submerged cages | sea | 80 | false | false
exposed ocean farms | sea | 80 | false | false
fjord farms | sea | 80 | false | false
fjord farms | coast | 79 | false | true
recirculating tanks | land | 80 | false | false
research tanks | land | 60 | false | true
flow-through raceways | land | 80 | false | false
land-based grow-out units | land | 90 | false | false
river hatcheries | river | 80 | false | false
lake smolt sites | lake | 80 | false | false
estuary pens | coast | 80 | false | false
coastal villages | coast | 60 | false | true
cold stores | market | 60 | false | false
harbour markets | market | 80 | false | false
Arctic | north | 60 | true | true
Atlantic | ocean | 60 | true | true
"""
# Cues in the words around a place.
STUDY = r"(?i)\b(?:evidence from|study|trial|survey|sampled|tagging)\b"
ENTITY = r"(?i)\b(?:farms?|hatcher(?:y|ies)|stocked|reared)\b"
ARTEFACT = r"(?i)\b(?:press|copyright|keywords)\b"
DROPPED = {"publisher": r"(?i)press\b|publish", "software": r"(?i)version|software", "convention": r"(?i)convention|treaty"}
RULES = [("study", STUDY, 4.0), ("entity", ENTITY, 2.0), ("market", r"(?i)\b(?:market|price|export|trade)", -1.0)]


def gazetteer(spark: SparkSession) -> DataFrame:
    rows = [[x.strip() for x in line.split("|")] for line in GAZETTEER.strip().splitlines()]
    return spark.createDataFrame([(n, a, int(p), c == "true", m == "true") for n, a, p, c, m in rows], "place string, area string, priority int, requires_case boolean, ambiguous boolean")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clean_records", "record_sequence", "title", "abstract")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.match_places(_records(spark, sf_dir), "record_sequence", ["title", "abstract"], gazetteer(spark))


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each dictionary term stands in each title and abstract, overlaps included."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.col(c).alias("text")) for c in ("title", "abstract")]))
    long = _records(spark, sf_dir).select("record_sequence", fields.alias("f")).select("record_sequence", "f.*")
    found = with_spans(long, F.col("text"), dictionary(species_rows()), "spans")
    rows = found.select("record_sequence", "source", F.explode("spans").alias("s"))
    return rows.groupBy("record_sequence", "source", F.lower("s.entry.term").alias("term")).agg(F.count("*").alias("n"))


def species_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species mentions, the longest of overlapping names, with whether they are eligible."""
    return detect_species(_records(spark, sf_dir), "record_sequence").select("record_sequence", F.inline("mentions"))


def species_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Farmed species of every record, with role and reason."""
    return assign_species(detect_species(_records(spark, sf_dir), "record_sequence"), "record_sequence")


def _topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topic_rows(table(spark, sf_dir, "ontology_v4", "path_id", "hierarchy_path", "alternative_standalone_cues"))
    return detect_topics(_records(spark, sf_dir), "record_sequence", ["title", "abstract"], rows)


def topic_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the terms of each ontology path stand in each title and abstract, overlaps included."""
    per = _topics(spark, sf_dir).select("record_sequence", F.inline("mentions"))
    return per.groupBy("record_sequence", "source", "path_id", F.lower("matched_term").alias("term")).agg(F.count("*").alias("n"), F.min("match_start").alias("first_start"))


def record_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics of every record; one without any is sent to review."""
    return assign_topics(_topics(spark, sf_dir), "record_sequence")


def place_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mentions(spark, sf_dir)


def place_outermost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions without those inside a longer one, of each span the highest priority."""
    m = P.best_priority(P.outermost(_mentions(spark, sf_dir), "record_sequence"), "record_sequence")
    return m.select("record_sequence", "source", "token_start", "token_end", "place", "area", "priority")


def place_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and areas of every record after the context patterns have been applied."""
    m = P.drop_by_context(P.best_priority(P.outermost(_mentions(spark, sf_dir), "record_sequence"), "record_sequence"), DROPPED)
    return P.summarise_places(_records(spark, sf_dir), m, "record_sequence")


def area_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.score_rules(P.outermost(_mentions(spark, sf_dir), "record_sequence"), "record_sequence", RULES, 6.0)


def primary_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.primary_area(P.outermost(_mentions(spark, sf_dir), "record_sequence"), "record_sequence", STUDY, ENTITY, ARTEFACT)


#: Areas of the gazetteer that are regions rather than places.
REGIONS = ["north", "ocean"]


def strict_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of the title, or the one best area of the abstract; ties and regions in the title go to review."""
    return A.strict_areas(P.outermost(_mentions(spark, sf_dir), "record_sequence"), "record_sequence", F.col("area").isin(REGIONS))


def study_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas a study was made in, with the evidence and the number of areas left open."""
    strong, background = (A.phrases(t) for t in (A.LOCATIONS, A.BACKGROUND))
    return A.study_areas(P.outermost(_mentions(spark, sf_dir), "record_sequence"), "record_sequence", strong, background, A.phrases(A.ARTEFACTS))


def area_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each name with its mentions, records and areas, and whether it looks suspicious (short, or of several areas)."""
    per = _mentions(spark, sf_dir).groupBy(F.lower("matched_text").alias("name")).agg(F.count("*").alias("n_mentions"), F.count_distinct("record_sequence").alias("n_records"), F.count_distinct("area").alias("n_areas"))
    return per.withColumn("suspicious", (F.char_length("name") <= 5) | (F.col("n_areas") > 1))


def observed_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics met in the texts as an ontology, with the terms they were met by."""
    found = _topics(spark, sf_dir).select(F.inline("mentions")).select(*O.LEVELS, F.col("matched_term").alias("term"))
    return O.build_ontology(found)


_TERMS = sorted({r["term"].lower() for r in species_rows()})
_G = ", ".join("('{}', '{}', {}, {}, {})".format(*[x.strip() for x in line.split("|")]) for line in GAZETTEER.strip().splitlines())
_TOKENS = r"regexp_extract_all(coalesce(%s, ''), '[\p{L}\p{N}]+(?:[-''’][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}]')"
_MENTIONS = f"""
    g(place, area, priority, requires_case, ambiguous) as (values {_G}),
    t as (select record_sequence, 'title' as source, {_TOKENS % 'title'} as toks from clean_records union all select record_sequence, 'abstract', {_TOKENS % 'abstract'} from clean_records),
    p as (select *, unnest(range(1, len(toks) + 1)) as token_start from t),
    n as (select *, unnest(range(1, least(3, len(toks) - token_start + 1) + 1)) as token_length from p),
    r as (select *, array_to_string(toks[token_start : token_start + token_length - 1], ' ') as ngram from n),
    m as (
        select record_sequence, source, token_start, token_start + token_length - 1 as token_end, token_length, ngram as matched_text,
            array_to_string(toks[greatest(1, token_start - 12) : token_start + token_length + 11], ' ') as context, g.*
        from r join g on lower(ngram) = lower(place) where not requires_case or ngram = place),
    o as (select * from m where not exists (select 1 from m x where x.record_sequence = m.record_sequence and x.source = m.source and x.token_start <= m.token_start and x.token_end >= m.token_end and x.token_length > m.token_length)),
    b as (select * from o qualify rank() over (partition by record_sequence, source, token_start, token_end order by priority desc) = 1)"""
_TOPICS = r"""
    l as (select path_id, list_transform(string_split(hierarchy_path, '>'), lambda x: trim(x)) as p, string_split(coalesce(alternative_standalone_cues, ''), ';') as cues from ontology_v4),
    d as (select distinct path_id, p[1] as broad_topic, p[2] as subtopic, p[3] as feature, p[4] as component, lower(trim(unnest(list_concat([p[4]], cues)))) as term from l),
    t as (select record_sequence, unnest(['title', 'abstract']) as source, unnest([title, abstract]) as text from clean_records),
    h as (select *, '(?i)\b' || regexp_escape(term) || '\b' as rx from t, d where term not in ('', 'general') and contains(lower(text), term))"""
_RX = lambda p: p.replace("'", "''")
_SCORE = " + ".join(f"case when regexp_matches(context, '{_RX(p)}') then {s} else 0.0 end" for _, p, s in RULES)

_ANY = lambda listed: "(" + " or ".join(f"contains(lower(context), '{p}')" for p in listed) + ")"
_REGION = f"area in ({', '.join(repr(r) for r in REGIONS)})"

QUERIES = {f.__name__: f for f in (term_counts, species_mentions, species_assignments, topic_mentions, record_topics, place_mentions, place_outermost, place_summary, area_scores, primary_areas, strict_areas, study_areas, area_audit, observed_ontology)}
ORACLE = {
    "term_counts": f"""
        with d(term) as (values {', '.join(f"('{t}')" for t in _TERMS)}),
            t as (select record_sequence, unnest(['title', 'abstract']) as source, unnest([title, abstract]) as text from clean_records),
            c as (select record_sequence, source, term, len(regexp_extract_all(text, '(?i)(?:\\b)' || replace(term, '.', '\\.') || '(?:\\b)')) as n from t, d where contains(lower(text), term))
        select record_sequence, source, term, n from c where n > 0""",
    "topic_mentions": f"""
        with {_TOPICS} select record_sequence, source, path_id, term, cast(len(regexp_extract_all(text, rx)) as bigint) as n,
            cast(length(regexp_extract(text, '(?is)^(.*?)' || rx, 1)) + 1 as int) as first_start from h where regexp_matches(text, rx)""",
    "record_topics": f"""
        with {_TOPICS}, f as (select distinct record_sequence, broad_topic, subtopic, feature, component from h where regexp_matches(text, rx))
        select record_sequence, broad_topic, subtopic, feature, component, f.broad_topic is null as review_required,
            case when f.broad_topic is null then 'No topic dictionary terms detected' else 'One or more topic dictionary terms detected' end as assignment_reason
        from clean_records left join f using (record_sequence)""",
    "place_mentions": f"with {_MENTIONS} select * from m",
    "place_outermost": f"with {_MENTIONS} select record_sequence, source, token_start, token_end, place, area, priority from b",
    "place_summary": f"""
        with {_MENTIONS}, k as (select * from b where {' and '.join(f"not regexp_matches(context, '{_RX(p)}')" for p in DROPPED.values())}),
            s as (select record_sequence, string_agg(distinct place, '; ' order by place) as places, string_agg(distinct area, '; ' order by area) as areas, count(*) as n_mentions, count(distinct area) as n_areas, bool_or(ambiguous) as amb from k group by all)
        select record_sequence, places, areas, coalesce(n_mentions, 0) as n_mentions, coalesce(n_areas, 0) as n_areas, coalesce(amb, false) or coalesce(n_areas, 0) > 1 as review_required
        from clean_records left join s using (record_sequence)""",
    "area_scores": f"""
        with {_MENTIONS}, s as (select record_sequence, area, case when source = 'title' then 6.0 else 0.0 end + {_SCORE} as score from o),
            a as (select record_sequence, area, cast(sum(score) as double) as raw_score, count(*) as n_mentions from s group by all),
            f as (select *, raw_score + least(greatest(n_mentions - 1, 0) * 2, 6) as score from a)
        select *, case when score >= 6 then 'assign' when score >= 3 then 'borderline' else 'reject' end as decision from f""",
    "primary_areas": f"""
        with {_MENTIONS},
            q as (select *, case when source = 'title' then 1 when regexp_matches(context, '{_RX(STUDY)}') then 2 when regexp_matches(context, '{_RX(ENTITY)}') then 3 when regexp_matches(context, '{_RX(ARTEFACT)}') then 99 else 4 end as tier from o),
            a as (select record_sequence, area, min(tier) as tier, count(*) filter (source = 'title') as n_title, count(*) filter (tier <= 3) as n_strong, count(*) as n_mentions from q where tier < 99 group by all),
            k as (select * from a qualify tier = min(tier) over (partition by record_sequence)),
            f as (select *, count(*) over (partition by record_sequence) as n_best, row_number() over (partition by record_sequence order by tier, n_title desc, n_strong desc, n_mentions desc, area) as rank from k)
        select record_sequence, area, tier, n_mentions, n_best > 1 as review_required from f where n_best <= 2 or rank = 1""",
    "strict_areas": f"""
        with {_MENTIONS},
            q as (select record_sequence, case when not {_REGION} then area end as area, source = 'title' as title, case when source = 'title' then 1 when {_ANY(A.phrases(A.LOCATIONS))} then 2 when {_ANY(A.phrases(A.ENTITIES))} and not {_ANY(A.phrases(A.BACKGROUND))} then 3 when {_ANY(A.phrases(A.BACKGROUND))} then 5 else 4 end as tier
                from o where case when {_REGION} then source = 'title' else not {_ANY(A.phrases(A.ARTEFACTS))} and not ({' or '.join(f"contains(lower(context), lower(matched_text) || ' {x}')" for x in A.FISH)}) end),
            a as (select record_sequence, area, min(tier) as tier, count(*) filter (title) as n_title, count(*) filter (tier <= 3) as n_strong, count(*) as n from q where area is not null group by all),
            f as (select record_sequence, count(*) filter (n_title > 0) as titled, record_sequence in (select record_sequence from q where area is null) as scope from a group by record_sequence),
            k as (select *, rank() over (partition by record_sequence order by tier, n_strong desc, n desc) as r from a),
            z as (select *, count(*) filter (r = 1) over (partition by record_sequence) as ties from k join f using (record_sequence)),
            c as (select *, case when titled > 0 then n_title > 0 else not scope and r = 1 and ties = 1 end as chosen from z),
            y as (select *, case when titled = 1 then 'one area in the title' when titled > 1 then 'areas named together in the title' when tier = 2 then 'study location' when tier = 3 then 'study entity' when tier = 4 then 'dominant mention' else 'strongest evidence' end as why,
                case when titled = 0 and scope then 'title names a region' when titled = 0 and ties > 1 then 'best areas are tied' end as review from c)
        select record_sequence, string_agg(area, '; ' order by area) filter (chosen) as areas, count(*) filter (chosen) as n_areas, string_agg(distinct why, '; ' order by why) filter (chosen) as reason, max(review) is not null as review_required, max(review) as review_reason from y group by 1""",
    "study_areas": f"""
        with {_MENTIONS},
            q as (select record_sequence, area, source = 'title' as title, {_ANY(A.phrases(A.LOCATIONS))} as strong, {_ANY(A.phrases(A.BACKGROUND))} as background from o where not {_ANY(A.phrases(A.ARTEFACTS))}),
            a as (select record_sequence, area, bool_or(title) as title, bool_or(not title) as inside, bool_or(not title and strong) as strong, bool_or(not title and not background) as plain from q group by all),
            h as (select *, bool_or(title) over (partition by record_sequence) as titled, count(*) filter (inside) over (partition by record_sequence) as n_inside from a),
            c as (select *, case when title then 'named in the title' when titled and strong then 'further area of the study' when strong then 'area of the study' when not titled and n_inside = 1 and plain then 'only area of the abstract' end as reason from h),
            d as (select record_sequence, count(*) filter (reason is null) as n_unresolved from c group by 1)
        select record_sequence, area, case when title then 'title' else 'abstract' end as evidence, reason, n_unresolved from c join d using (record_sequence) where reason is not null
        union all select record_sequence, null, null, null, n_unresolved from d where record_sequence not in (select record_sequence from c where reason is not null)""",
    "area_audit": f"""
        with {_MENTIONS}, a as (select lower(matched_text) as name, count(*) as n_mentions, count(distinct record_sequence) as n_records, count(distinct area) as n_areas from m group by 1)
        select *, length(name) <= 5 or n_areas > 1 as suspicious from a""",
    "observed_ontology": f"""
        with {_TOPICS}, e as (select broad_topic, subtopic, feature, component, unnest(regexp_extract_all(text, rx)) as term from h),
            u as (select broad_topic, subtopic, feature, component, min(term) as term from e where term <> '' group by broad_topic, subtopic, feature, component, lower(term)),
            v as (select broad_topic, subtopic, feature, component, count(*) as term_count, string_agg(term, '; ' order by term) as supporting_terms from u group by all)
        select 'TOPIC_' || lpad(cast(row_number() over (order by broad_topic, subtopic, feature, component) as varchar), 3, '0') as path_id, broad_topic, subtopic, feature, component,
            concat_ws(' > ', broad_topic, subtopic, feature, component) as hierarchy_path, term_count, supporting_terms from v""",
}
