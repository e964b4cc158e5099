"""Queries that compare, match and score."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as X
from skerry.operators import metrics as M
from skerry.operators.incoming import match_incoming
from skerry.operators.multivalue import paths_array
from skerry.operators.relational import hash_order
from skerry.plans.learning import classified_paths
from skerry.plans.multivalue import known_paths
from skerry.sources.ris import parse_texts, to_ris
from skerry.sources.tables import table


#: Titles whose hash is below this are for validation: a fifth of all.
VALIDATION_BELOW = "33333333333333333333333333333333"


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Gold and assigned paths of the adjudicated records, by path_id."""
    onto = table(spark, sf_dir, "ontology_v4", "path_id", "hierarchy_path").withColumn("k", F.regexp_replace(F.lower("hierarchy_path"), "[^a-z0-9]", "")).drop("hierarchy_path")
    gold = table(spark, sf_dir, "gold_standard", "record_sequence", "gold_path").withColumn("k", F.regexp_replace(F.lower("gold_path"), "[^a-z0-9]", "")).join(onto, "k").select("record_sequence", "path_id").distinct()
    results = table(spark, sf_dir, "topic_v4_llm_record", "record_sequence", "assigned_paths").join(gold.select("record_sequence").distinct(), "record_sequence", "left_semi")
    items = results.select("record_sequence", F.explode(paths_array(F.col("assigned_paths"), known_paths(spark, sf_dir))).alias("item"))
    return gold, items.withColumn("k", F.regexp_replace(F.lower("item"), "[^a-z0-9]", "")).join(onto, "k").select("record_sequence", "path_id").distinct()


def topic_record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each adjudicated record."""
    return M.record_metrics(*_sides(spark, sf_dir), "record_sequence", "path_id")


def topic_code_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.code_metrics(*_sides(spark, sf_dir), "record_sequence", "path_id")


def topic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = M.micro_macro(topic_record_metrics(spark, sf_dir))
    return one.select("tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "exact_share", "micro_precision", "micro_recall", "micro_f1")])


def topic_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.disagreements(*_sides(spark, sf_dir), "record_sequence", "path_id")


def path_version_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the best path by keywords compares with the assigned paths and the right ones."""
    gold, assigned = _sides(spark, sf_dir)
    keyed = classified_paths(spark, sf_dir).where("pos = 1").select("record_sequence", "path_id")
    keyed = keyed.join(gold.select("record_sequence").distinct(), "record_sequence", "left_semi")
    return M.version_outcomes(assigned, keyed, gold, "record_sequence", "path_id")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "clean_records", "abstract_word_count", "has_valid_doi").where("abstract_word_count is not null and has_valid_doi is not null")
    return r.select(F.least(F.col("abstract_word_count") / 200.0, F.lit(1.0)).cast("double").alias("score"), F.col("has_valid_doi").alias("label"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates at every threshold when a valid DOI is foretold by the length of the abstract."""
    return M.threshold_sweep(_scored(spark, sf_dir), "score", "label")


def operating_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.operating_thresholds(threshold_sweep(spark, sf_dir), 0.99, 0.80)


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the keys by which deliveries are compared."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "title", "authors", "doi", "batch_no", "year")
    k = r.select("batch_no", "year", F.col("record_sequence").alias("id"), X.title_key(F.col("title")).alias("title_key"), X.empty_to_null(X.bare_doi(F.col("doi"))).alias("doi_key"), X.first_author_key(F.col("authors")).alias("author_key"))
    return k.select("*", F.substring("title_key", 1, 24).alias("title_prefix"), X.title_token_key(F.col("title_key")).alias("token_key"))


def incoming_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match of each later delivery's record among the accepted history."""
    k = _screened(spark, sf_dir)
    return match_incoming(k.where("batch_no > 0"), k.where("batch_no = 0")).withColumn("similarity", F.round("similarity", 6))


def delivery_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each delivery's records by what becomes of them: matched in the history, repeated inside the delivery, for
    review, or new (the first of each title)."""
    k = _screened(spark, sf_dir)
    matched = match_incoming(k.where("batch_no > 0"), k.where("batch_no = 0")).select(F.col("new_id").alias("id"), "status")
    rows = k.where("batch_no > 0").select("id", "batch_no", "title_key").join(matched, "id")
    left = rows.where("status = 'new' and title_key <> ''").groupBy("batch_no", "title_key").agg(F.min("id").alias("first_id"))
    rows = rows.join(left, ["batch_no", "title_key"], "left")
    fate = F.when(F.col("status") != "new", F.col("status")).when(F.col("first_id") < F.col("id"), "repeated_in_delivery").when(F.col("title_key") == "", "no_title").otherwise("new")
    return rows.groupBy("batch_no", fate.alias("fate")).agg(F.count("*").alias("n"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified records with their screening keys and the label 1 where a result asks for review, once for each label."""
    label = table(spark, sf_dir, "topic_v4_llm_record", "record_sequence", "review_required").where("review_required is not null").select("record_sequence", F.col("review_required").cast("int").alias("eligibility")).distinct()
    r = table(spark, sf_dir, "clean_records", "record_sequence", "title", "abstract", "doi").join(label, "record_sequence")
    keys = r.select("record_sequence", "eligibility", X.title_key(F.col("title")).alias("title_key"), X.empty_to_null(X.bare_doi(F.col("doi"))).alias("doi_key"), F.col("abstract").isNotNull().alias("has_abstract"), F.coalesce(F.char_length("abstract"), F.lit(0)).alias("n_abstract"), F.coalesce(F.char_length("title"), F.lit(0)).alias("n_title"))
    return keys.where("title_key <> ''")


def label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose title or DOI stands under both labels."""
    r = _labelled(spark, sf_dir)
    found = None
    for key, basis in (("title_key", "exact normalised title"), ("doi_key", "exact normalised DOI")):
        both = r.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct("eligibility").alias("k")).where("k > 1").select(key)
        part = r.join(both, key, "left_semi").select("record_sequence", "eligibility", F.lit(basis).alias("conflict_basis"))
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def training_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record for each title and label, the one with the longest abstract and title, and the side of the split
    it is on: all records of a title are on one side."""
    r = _labelled(spark, sf_dir)
    order = F.struct(F.col("has_abstract").cast("int"), "n_abstract", "n_title", -F.col("record_sequence"))
    best = r.groupBy("title_key", "eligibility").agg(F.max_by("record_sequence", order).alias("record_sequence"))
    return best.withColumn("validation", hash_order("title_key", 20260) < F.lit(VALIDATION_BELOW))


def ris_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as RIS text and read again."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "type", "record_id", "title", "abstract_raw", "doi_raw", "year_raw", "journal", "authors")
    back = parse_texts(to_ris(r, "record_sequence"), "ris", ["record_sequence"])
    return back.select("record_sequence", "record_no", "record_id", "title", "doi_raw", "year_raw", "journal")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of title: retraction, withdrawal or correction notice, by the word it opens with."""
    t = F.lower(X.squish(F.coalesce("title", F.lit(""))))
    kind = F.when(t.rlike(r"^(?:retraction|retracted(?: article)?)\s*[:.\-–—]"), "retraction").when(t.rlike(r"^withdraw(?:al|n)\s*[:.\-–—]"), "withdrawal").when(t.rlike(r"^(?:correction|corrigendum|erratum)\s*[:.\-–—]"), "correction").otherwise("none")
    return table(spark, sf_dir, "clean_records", "title").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def retracted_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose DOI is known to be retracted; a lookup found twice counts once."""
    lookup = table(spark, sf_dir, "remote_lookup", "doi_for_lookup", "openalex_is_retracted", "openalex_lookup_status")
    known = lookup.where(X.true(F.col("openalex_is_retracted")) & (F.col("openalex_lookup_status") == "matched")).select(X.bare_doi(F.col("doi_for_lookup")).alias("doi_key")).distinct()
    r = table(spark, sf_dir, "clean_records", "record_sequence", "doi").where("doi is not null").withColumn("doi_key", X.bare_doi(F.col("doi")))
    return r.join(known, "doi_key", "left_semi").select("record_sequence", "doi_key")


def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ontology as prompt text: a header line and labelled lines for each path, blank fields left out."""
    labels = {"definition": "Definition", "include_when": "Include when", "exclude_when": "Exclude when", "required_subject_terms": "Subject", "required_focus_terms": "Focus"}
    lines = [F.when(F.trim(c) != "", F.concat(F.lit(f"{label}: "), F.col(c))) for c, label in labels.items()]
    return table(spark, sf_dir, "ontology_v4").select("path_id", F.concat_ws("\n", F.concat_ws(" | ", "path_id", "hierarchy_path"), *lines).alias("block"))


QUERIES = {f.__name__: f for f in (topic_record_metrics, topic_code_metrics, topic_summary, topic_disagreements, path_version_outcomes, threshold_sweep, operating_thresholds, incoming_matches, delivery_audit, label_conflicts, training_records, ris_round_trip, notices, retracted_records, prompt_blocks)}

from skerry.plans.cleaning import _AUTHOR_KEY, _DOI, _TITLE_KEY, _squish  # noqa: E402

_SIDES = """
    o as (select path_id, regexp_replace(lower(hierarchy_path), '[^a-z0-9]', '', 'g') as k from ontology_v4),
    g as (select distinct record_sequence, path_id from gold_standard join o on regexp_replace(lower(gold_path), '[^a-z0-9]', '', 'g') = k),
    p as (select distinct record_sequence, path_id from topic_v4_llm_record join o on contains(regexp_replace(lower(assigned_paths), '[^a-z0-9]', '', 'g'), k) where record_sequence in (select record_sequence from g)),
    b as (select coalesce(g.record_sequence, p.record_sequence) as record_sequence, coalesce(g.path_id, p.path_id) as path_id, g.path_id is not null as ig, p.path_id is not null as ip
        from g full join p on g.record_sequence = p.record_sequence and g.path_id = p.path_id)"""
_PER = """
    c as (select record_sequence, count(*) filter (ig and ip) as tp, count(*) filter (not ig) as fp, count(*) filter (not ip) as fn from b group by all),
    d as (select *, case when tp + fp > 0 then tp / (tp + fp) when tp + fn = 0 then 1.0 else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 1.0 end as recall from c),
    e as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1, fp = 0 and fn = 0 as exact from d)"""
_SWEEP = """
    s as (select least(abstract_word_count / 200.0::double, 1.0) as score, has_valid_doi as label from clean_records where abstract_word_count is not null and has_valid_doi is not null),
    q as (select score as threshold, count(*) filter (label) as pos, count(*) filter (not label) as neg from s group by all),
    w as (select threshold, cast(sum(pos) over (order by threshold desc) as bigint) as tp, cast(sum(neg) over (order by threshold desc) as bigint) as fp, cast((select sum(pos) from q) as bigint) as p, cast((select sum(neg) from q) as bigint) as n from q),
    x as (select threshold, tp, fp, p - tp as fn, n - fp as tn from w),
    y as (select *, case when tp + fn > 0 then tp / (tp + fn) end as sensitivity, case when tn + fp > 0 then tn / (tn + fp) end as specificity, case when tp + fp > 0 then tp / (tp + fp) end as precision, case when tn + fn > 0 then tn / (tn + fn) end as npv from x)"""
_KEYWORD = """
    kw as (select path_id, list_filter(list_transform(string_split(concat_ws(';', nullif(required_focus_terms, ''), nullif(required_subject_terms, '')), ';'), lambda x: trim(x)), lambda x: x <> '') as cues from ontology_v4),
    kh as (select record_sequence, path_id, len(list_filter(cues, lambda c: contains(lower(concat_ws(' ', title, abstract)), lower(c)))) as n from clean_records, kw),
    w as (select record_sequence, path_id, row_number() over (partition by record_sequence order by n desc, path_id) as pos from kh where n > 0)"""
_LABELLED = f"""
    l as (select distinct record_sequence, cast(review_required as int) as eligibility from topic_v4_llm_record where review_required is not null),
    r0 as (select record_sequence, eligibility, {_TITLE_KEY} as title_key, nullif({_DOI.replace('%s', 'doi')}, '') as doi_key, abstract is not null as has_abstract, coalesce(length(abstract), 0) as n_abstract, coalesce(length(title), 0) as n_title from clean_records join l using (record_sequence)),
    r as (select * from r0 where title_key <> '')"""
# the prefix counts at any similarity, as in the library
_JW = lambda a, b: f"(jaro_similarity({a}, {b}) + 0.1 * (1 - jaro_similarity({a}, {b})) * (" + " + ".join(f"cast(left({a}, {n}) = left({b}, {n}) as int)" for n in (1, 2, 3, 4)) + "))"
# every pair of the blocks is compared here, so this is also the brute force the blocks by words are measured against
_MATCHES = f"""
    k0 as (select record_sequence as id, batch_no, year, {_TITLE_KEY} as title_key, nullif({_DOI.replace('%s', 'doi')}, '') as doi_key, {_AUTHOR_KEY} as author_key from clean_records),
    k as (select *, substring(title_key, 1, 24) as title_prefix, array_to_string(list_sort(list_distinct(list_filter(string_split(title_key, ' '), lambda x: x <> '')[1:8])), ' ') as token_key from k0),
    n as (select * from k where batch_no > 0), a as (select * from k where batch_no = 0),
    e as (select n.id as new_id, min(a.id) as master_id, 1 as priority, 'duplicate' as status, 'exact title' as basis, 1.0::double as similarity from n join a using (title_key) where title_key <> '' group by n.id),
    d0 as (select n.id as new_id, a.id as master_id, case when n.title_key = '' or a.title_key = '' then 0.0 else {_JW('n.title_key', 'a.title_key')} end as similarity, n.title_key = '' or a.title_key = '' as missing from n join a using (doi_key)),
    d as (select new_id, master_id, case when similarity >= 0.90 then 2 when missing then 5 else 6 end as priority, case when similarity >= 0.90 then 'duplicate' when missing then 'possible_duplicate' else 'doi_conflict_review' end as status, 'doi' as basis, similarity from d0),
    p as (select n.id as new_id, a.id as master_id, n.title_key as t, a.title_key as u, case when n.year = a.year then 'same year' when n.author_key <> '' and n.author_key = a.author_key then 'same author' when n.title_prefix = a.title_prefix then 'title prefix' else 'first words' end as basis
        from n join a on (n.year = a.year or (n.author_key <> '' and n.author_key = a.author_key) or n.title_prefix = a.title_prefix or n.token_key = a.token_key) where n.title_key <> '' and a.title_key <> '' and n.id not in (select new_id from e)),
    s as (select *, {_JW('t', 'u')} as similarity from p where least(length(t), length(u)) >= 0.82 * greatest(length(t), length(u))),
    f as (select * from e union all select * from d union all select new_id, master_id, case when similarity >= 0.985 then 3 else 4 end, case when similarity >= 0.985 then 'probable_duplicate' else 'possible_duplicate' end, basis, similarity from s where similarity >= 0.965),
    b as (select * from f qualify row_number() over (partition by new_id order by priority, similarity desc, master_id) = 1),
    m as (select n.id as new_id, coalesce(status, 'new') as status, basis, master_id, round(similarity, 6) as similarity from n left join b on b.new_id = n.id)"""
ORACLE = {
    "topic_record_metrics": f"with {_SIDES}, {_PER} select * from e",
    "topic_code_metrics": f"""
        with {_SIDES}, c as (select path_id, count(*) filter (ig and ip) as tp, count(*) filter (not ig) as fp, count(*) filter (not ip) as fn from b group by all)
        select *, case when tp + fp > 0 then tp / (tp + fp) end as precision, case when tp + fn > 0 then tp / (tp + fn) end as recall from c""",
    "topic_summary": f"""
        with {_SIDES}, {_PER}, z as (select cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, avg(precision) as mp, avg(recall) as mr, avg(f1) as mf, avg(exact::int) as me from e),
            v as (select *, tp / (tp + fp) as up, tp / (tp + fn) as ur from z)
        select tp, fp, fn, round(mp, 9) as macro_precision, round(mr, 9) as macro_recall, round(mf, 9) as macro_f1, round(me, 9) as exact_share, round(up, 9) as micro_precision, round(ur, 9) as micro_recall, round(2 * up * ur / (up + ur), 9) as micro_f1 from v""",
    "topic_disagreements": f"with {_SIDES} select record_sequence, path_id, case when ip then 'extra' else 'missing' end as kind from b where not (ig and ip)",
    "threshold_sweep": f"with {_SWEEP} select * from y",
    "operating_thresholds": f"""
        with {_SWEEP}, l as (select coalesce(max(threshold) filter (sensitivity >= 0.99), 0.0) as exclude_below, coalesce(min(threshold) filter (precision >= 0.80 and tp > 0), 1.0) as i from y), z as (select quantile_cont(score, 0.25) filter (label) as q from s)
        select exclude_below, case when i <= exclude_below then least(1.0, greatest(exclude_below + 0.05, coalesce(q, 0.0))) else i end as include_from from l, z""",
    "path_version_outcomes": f"""
        with {_SIDES}, {_KEYWORD}, i as (select record_sequence, string_agg(path_id, '; ' order by path_id) as s from p group by 1), j as (select record_sequence, path_id as s from w where pos = 1 and record_sequence in (select record_sequence from g)), x as (select record_sequence, string_agg(path_id, '; ' order by path_id) as s from g group by 1),
            v as (select x.record_sequence, coalesce(i.s, '') as first_set, coalesce(j.s, '') as second_set, x.s as gold_set from x left join i using (record_sequence) left join j using (record_sequence))
        select *, case when first_set = gold_set and second_set = gold_set then 'Unchanged correct' when second_set = gold_set then 'Improved' when first_set = gold_set then 'Regressed' when first_set = second_set then 'Unchanged incorrect' else 'Changed but still incorrect' end as outcome,
            first_set <> second_set and second_set <> gold_set as review_required from v""",
    "label_conflicts": f"""
        with {_LABELLED}, t as (select title_key from r group by 1 having count(distinct eligibility) > 1), d as (select doi_key from r where doi_key is not null group by 1 having count(distinct eligibility) > 1)
        select distinct record_sequence, eligibility, 'exact normalised title' as conflict_basis from r where title_key in (select title_key from t)
        union select distinct record_sequence, eligibility, 'exact normalised DOI' from r where doi_key in (select doi_key from d)""",
    "training_records": f"""
        with {_LABELLED}, b as (select * from r qualify row_number() over (partition by title_key, eligibility order by has_abstract desc, n_abstract desc, n_title desc, record_sequence) = 1)
        select title_key, eligibility, record_sequence, md5(title_key || ':20260') < '{VALIDATION_BELOW}' as validation from b""",
    "incoming_matches": f"with {_MATCHES} select new_id, status, basis, master_id, similarity from m",
    "delivery_audit": f"""
        with {_MATCHES}, x as (select k.batch_no, k.id, k.title_key, m.status, min(case when status = 'new' and k.title_key <> '' then k.id end) over (partition by k.batch_no, k.title_key) as first_id from k join m on m.new_id = k.id),
            y as (select batch_no, case when status <> 'new' then status when first_id < id then 'repeated_in_delivery' when title_key = '' then 'no_title' else 'new' end as fate from x)
        select batch_no, fate, count(*) as n from y group by all""",
    "notices": f"""
        with t as (select lower({_squish("coalesce(title, '')")}) as t from clean_records)
        select case when regexp_matches(t, '^(?:retraction|retracted(?: article)?)\\s*[:.\\-–—]') then 'retraction' when regexp_matches(t, '^withdraw(?:al|n)\\s*[:.\\-–—]') then 'withdrawal'
            when regexp_matches(t, '^(?:correction|corrigendum|erratum)\\s*[:.\\-–—]') then 'correction' else 'none' end as kind, count(*) as n from t group by all""",
    "retracted_records": f"""
        with k as (select distinct {_DOI.replace('%s', 'doi_for_lookup')} as doi_key from remote_lookup where openalex_is_retracted and openalex_lookup_status = 'matched'),
            r as (select record_sequence, {_DOI.replace('%s', 'doi')} as doi_key from clean_records where doi is not null)
        select record_sequence, doi_key from r where doi_key in (select doi_key from k)""",
    "prompt_blocks": "select path_id, concat_ws(chr(10), concat_ws(' | ', path_id, hierarchy_path), " + ", ".join(f"case when trim({c}) <> '' then '{label}: ' || {c} end" for c, label in {"definition": "Definition", "include_when": "Include when", "exclude_when": "Exclude when", "required_subject_terms": "Subject", "required_focus_terms": "Focus"}.items()) + ") as block from ontology_v4",
    "ris_round_trip": f"""
        select record_sequence, 1 as record_no, {", ".join(f"nullif({_squish(c)}, '') as {c}" for c in ("record_id", "title", "doi_raw", "year_raw", "journal"))} from clean_records""",
}
