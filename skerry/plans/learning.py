"""Queries with models, classifiers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as X
from skerry.operators import ontology as O
from skerry.operators.classify import classify_records, flatten_responses, keyword_classifier
from skerry.operators.screening import decide, document_frequency, fit_screening, terms, validation_split
from skerry.plans.multivalue import MAX_KNOWN_PATHS
from skerry.sources.tables import materialize, shared_path, table
from skerry.streaming.incremental import run_available


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and pairs of the screening text (titles and abstracts) with their document frequency and weight."""
    records = table(spark, sf_dir, "clean_records", "title", "abstract")
    t = terms(records.select(X.screening_text(F.col("title"), F.col("abstract")).alias("text")), "text")
    return document_frequency(t.select("terms")).select("term", "df", F.round("idf", 9).alias("idf"))


def screening_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a result was sent to review, foretold from the record's text: held-out records by decision."""
    results = table(spark, sf_dir, "topic_v4_llm_record", "record_sequence", "review_required").where("review_required is not null").groupBy("record_sequence").agg(F.max(F.col("review_required").cast("int")).cast("double").alias("label"))
    records = table(spark, sf_dir, "clean_records", "record_sequence", "title", "abstract")
    records = records.join(results, "record_sequence")
    rows = terms(records.select("label", X.title_key(F.col("title")).alias("title_key"), X.screening_text(F.col("title"), F.col("abstract")).alias("text")), "text")
    rows = materialize(validation_split(rows, "title_key").select("terms", "label", "validation"), "screening-rows")
    model = fit_screening(rows.where("not validation"), "label")
    scored = model.score(rows.where("validation")).withColumn("decision", decide(F.col("probability_relevant"), 0.1, 0.6))
    return scored.groupBy("decision", "label").agg(F.count("*").alias("n"), F.round(F.avg("probability_relevant"), 4).alias("mean_probability"))


def _cues(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    rows = table(spark, sf_dir, "ontology_v4", "path_id", "required_focus_terms", "required_subject_terms").limit(MAX_KNOWN_PATHS + 1).collect()
    if len(rows) > MAX_KNOWN_PATHS:
        raise ValueError(f"the ontology has more than {MAX_KNOWN_PATHS} paths")
    return {r[0]: [c.strip() for f in r[1:] if f for c in f.split(";") if c.strip()] for r in rows}


def classified_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of every record by a keyword classifier over the ontology's terms."""
    records = table(spark, sf_dir, "clean_records", "record_sequence", "title", "abstract")
    answers = classify_records(records, "record_sequence", F.concat_ws(" ", "title", "abstract"), keyword_classifier(_cues(spark, sf_dir)))
    return flatten_responses(answers, table(spark, sf_dir, "ontology_v4", "path_id", "hierarchy_path"), "record_sequence")


def _paths(spark: SparkSession, sf_dir: str) -> list[tuple[str, ...]]:
    """The levels of the ontology's paths."""
    rows = O.path_levels(table(spark, sf_dir, "ontology_v4", "hierarchy_path")).select(*O.LEVELS).limit(MAX_KNOWN_PATHS + 1).collect()
    if len(rows) > MAX_KNOWN_PATHS:
        raise ValueError(f"the ontology has more than {MAX_KNOWN_PATHS} paths")
    return [tuple(r) for r in rows]


def classified_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of every record level by level, by the labels that stand in its text."""
    records = table(spark, sf_dir, "clean_records", "record_sequence", "title", "abstract")
    paths = _paths(spark, sf_dir)
    return O.classify_levels(records, "record_sequence", F.concat_ws(" ", "title", "abstract"), paths, O.label_chooser(paths))


def classification_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request line for every record, as the parts a service would read from it."""
    records = table(spark, sf_dir, "clean_records", "record_sequence", "title", "abstract")
    labels = sorted({p[0] for p in _paths(spark, sf_dir)})
    lines = O.requests(records, "record_sequence", F.col("title"), F.col("abstract"), "Name the topics of the record.", labels, "local")
    return lines.select("custom_id", F.get_json_object("line", "$.body.input[1].content[0].text").alias("user_text"))


def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored results written as a service's answers and read again, ids checked against the ontology."""
    r = table(spark, sf_dir, "topic_v4_llm_record", "result_id", "assigned_path_ids", "review_required", "review_reason")
    known = [x[0] for x in table(spark, sf_dir, "ontology_v4", "path_id").orderBy("path_id").limit(MAX_KNOWN_PATHS).collect()]
    inner = F.to_json(F.struct(F.split("assigned_path_ids", r";\s*").alias("labels"), "review_required", "review_reason"))
    kind = "array<struct<type:string,text:string>>"
    content = F.array(F.struct(F.lit("output_text").alias("type"), inner.alias("text")))
    answer = F.to_json(F.struct(F.array(F.struct(F.lit("reasoning").alias("type"), F.lit(None).cast(kind).alias("content")), F.struct(F.lit("message").alias("type"), content.cast(kind).alias("content"))).alias("output")))
    out = O.parse_answers(r.select("result_id", answer.alias("answer")), "result_id", F.col("answer"), known)
    return out.select("result_id", F.array_join("labels", "; ").alias("path_ids"), "review_required", "review_reason", "error")


def incremental_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records through a file stream and a state table, each once."""
    schema = table(spark, sf_dir, "clean_records").schema
    path = f"{sf_dir}/clean_records.parquet"
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(files).isDirectory()
    reader = spark.readStream.schema(schema)
    stream = reader.parquet(path) if folder else reader.option("pathGlobFilter", "clean_records.parquet").parquet(sf_dir)
    keep = lambda d: d.select("record_sequence", "batch_no", X.title_key(F.col("title")).alias("title_key"))
    base = shared_path(spark, "incremental")
    return run_available(stream, "record_sequence", keep, f"{base}/state", f"{base}/checkpoint").select("record_sequence", "batch_no", "title_key")


QUERIES = {f.__name__: f for f in (term_frequencies, screening_model, classified_paths, classified_levels, classification_requests, parsed_answers, incremental_records)}

from skerry.plans.cleaning import _TITLE_KEY  # noqa: E402

ORACLE = {
    "classified_paths": """
        with o as (select path_id, hierarchy_path, list_filter(list_transform(string_split(concat_ws(';', nullif(required_focus_terms, ''), nullif(required_subject_terms, '')), ';'), lambda x: trim(x)), lambda x: x <> '') as cues from ontology_v4),
            h as (select record_sequence, path_id, hierarchy_path, list_filter(cues, lambda c: contains(lower(concat_ws(' ', title, abstract)), lower(c))) as hit from clean_records, o)
        select record_sequence, path_id, hierarchy_path, cast(row_number() over (partition by record_sequence order by len(hit) desc, path_id) as int) as pos, array_to_string(hit, '; ') as reason, true as known from h where len(hit) > 0""",
    "classified_levels": """
        with l as (select string_split_regex(hierarchy_path, '\\s*>\\s*') as p from ontology_v4), o as (select distinct p[1] as a, p[2] as b, p[3] as c, p[4] as d from l),
            t as (select record_sequence, lower(concat_ws(' ', title, abstract)) as x from clean_records),
            w as (select record_sequence, o.*, contains(x, lower(a)) as ha, contains(x, lower(b)) and b <> 'General' as hb, contains(x, lower(c)) and c <> 'General' as hc, contains(x, lower(d)) and d <> 'General' as hd from t, o),
            k as (select *, bool_or(ha or hb or hc or hd) over (partition by record_sequence, a) as oa, bool_or(hb or hc or hd) over (partition by record_sequence, a, b) and b <> 'General' as ob,
                bool_or(hc or hd) over (partition by record_sequence, a, b, c) and c <> 'General' as oc, hd as od from w),
            n as (select *, ob or (b = 'General' and not bool_or(ob) over (partition by record_sequence, a)) as pb from k where oa),
            m as (select *, oc or (c = 'General' and not bool_or(oc) over (partition by record_sequence, a, b)) as pc from n where pb),
            e as (select *, od or (d = 'General' and not bool_or(od) over (partition by record_sequence, a, b, c)) as pd from m where pc),
            r as (
                select record_sequence, a, b, c, d, false as review from e where pd
                union select record_sequence, a, b, c, null, true from m where pc and record_sequence not in (select record_sequence from e where pd)
                union select record_sequence, a, b, null, null, true from n where pb and record_sequence not in (select record_sequence from m where pc)
                union select record_sequence, a, null, null, null, true from k where oa and record_sequence not in (select record_sequence from n where pb)),
            f as (select *, coalesce(c = 'General' and d = 'General', false) as g from r)
        select record_sequence, a as broad_topic, b as subtopic, c as feature, d as component, review as review_required, cast(null as varchar) as error from f
        qualify not g or not bool_or(not g) over (partition by record_sequence, a, b)""",
    "classification_requests": "select 'record_' || record_sequence as custom_id, 'TITLE' || chr(10) || coalesce(title, '') || chr(10) || chr(10) || 'ABSTRACT' || chr(10) || coalesce(abstract, '') as user_text from clean_records",
    "parsed_answers": """
        with t as (select *, regexp_split_to_array(assigned_path_ids, ';\\s*') as l from topic_v4_llm_record), o as (select list(path_id) as ids from ontology_v4),
            u as (select *, list_filter(l, lambda x: not list_contains(ids, x)) as bad from t, o)
        select result_id, case when len(bad) = 0 then array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '; ') end as path_ids, review_required, review_reason,
            case when l is null then 'no labels' when len(bad) > 0 then 'labels not allowed: ' || array_to_string(list_distinct(bad), ', ') end as error from u""",
    "incremental_records": f"select record_sequence, batch_no, {_TITLE_KEY} as title_key from clean_records",
}
