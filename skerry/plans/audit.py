"""Queries that profile, count, group and sample the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from skerry.functions import text as X
from skerry.operators import relational as R
from skerry.sources.tables import table


def distinct_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each DOI, records without one left out."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "doi", "title", "batch_no").where("doi is not null")
    return R.distinct_keep_first(r, ["doi"], ["batch_no", "record_sequence"])


def count_by_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clean_records", "journal").groupBy("journal").agg(F.count("*").alias("n"))


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose record_id is used more than once."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "record_id").where("record_id is not null")
    return R.add_count(r, ["record_id"], "n_uses").where("n_uses > 1")


def missingness(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "clean_records")
    return R.missingness(r, ["title", "abstract", "authors", "doi", "year", "journal", "volume", "issue", "pages", "record_id"])


def year_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years outside 1900 to the year after the harvest."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "year", "harvested_at")
    return r.where((F.col("year") < 1900) | (F.col("year") > F.year("harvested_at") + 1)).select("record_sequence", "year")


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key figures of the corpus as metric and value."""
    r = table(spark, sf_dir, "clean_records", "record_id", "doi", "has_title", "has_abstract", "has_valid_doi", "source_file", "year")
    one = r.agg(
        F.count("*").alias("records"), F.count_distinct("record_id").alias("record_ids"), F.count_distinct("doi").alias("dois"), F.count_distinct("source_file").alias("files"),
        F.count_if("has_title").alias("with_title"), F.count_if("has_abstract").alias("with_abstract"), F.count_if("has_valid_doi").alias("with_valid_doi"), F.min("year").cast("bigint").alias("first_year"), F.max("year").cast("bigint").alias("last_year"),
    )
    return one.unpivot([], one.columns, "metric", "value")


def journals_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journals of each year, collapsed to one sorted text."""
    r = table(spark, sf_dir, "clean_records", "year", "journal")
    return r.groupBy("year").agg(X.collapse_unique(F.col("journal")).alias("journals"), F.count_distinct("journal").alias("n_journals"))


def titles_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strata of each classified record in the order of their results."""
    r = table(spark, sf_dir, "topic_v4_llm_record", "record_sequence", "result_id", "sampling_stratum")
    return r.groupBy("record_sequence").agg(X.collapse_ordered(F.col("sampling_stratum"), F.col("result_id")).alias("strata"), F.count("*").alias("n_results"))


def source_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any and all of the flags of each source, NULL counting as FALSE."""
    r = table(spark, sf_dir, "clean_records", "source_file", "has_title", "has_abstract", "has_valid_doi")
    return r.groupBy("source_file").agg(
        F.bool_or(X.true(F.col("has_valid_doi"))).alias("any_doi"), F.bool_and(X.true(F.col("has_title"))).alias("all_titles"), F.count_if("has_abstract").alias("n_abstracts"), F.count("*").alias("n_records"),
        (F.count_if("has_abstract") / F.count("*")).alias("abstract_share"),
    )


def second_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "clean_records", "journal", "abstract_word_count").where("journal is not null")
    return R.second_largest(r, ["journal"], "abstract_word_count", "second_words")


def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents", "doc_kind", "n_chars").groupBy("doc_kind", "n_chars").agg(F.count("*").alias("k"))
    return d.groupBy("doc_kind").agg(*[F.percentile("n_chars", F.lit(q), F.col("k")).alias(name) for q, name in ((0.25, "q25"), (0.5, "q50"), (0.99, "q99"))])


def kind_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each kind, a column for each language, 0 where there are none."""
    d = table(spark, sf_dir, "documents", "doc_kind", "lang")
    return d.groupBy("doc_kind").pivot("lang", ["en", "no", "es", "de", "fr"]).count().fillna(0)


def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by 60 equal classes of length up to the 99th percentile."""
    d = table(spark, sf_dir, "documents", "n_chars")
    top = d.groupBy("n_chars").agg(F.count("*").alias("k")).agg(F.percentile("n_chars", F.lit(0.99), F.col("k")).alias("top"))
    return d.join(F.broadcast(top)).where("n_chars <= top").groupBy(F.least(F.floor(60 * F.col("n_chars") / F.col("top")), F.lit(59)).alias("bin")).agg(F.count("*").alias("n"))


def classified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that were classified without failure."""
    ok = table(spark, sf_dir, "topic_v4_llm_record", "record_sequence", "classification_failed").where(~X.true(F.col("classification_failed")))
    return table(spark, sf_dir, "clean_records", "record_sequence", "title").join(ok, "record_sequence", "left_semi")


def unclassified_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that still wait for a classification."""
    done = table(spark, sf_dir, "topic_v4_llm_record", "record_sequence")
    return table(spark, sf_dir, "clean_records", "record_sequence", "batch_no").join(done, "record_sequence", "left_anti")


def reviewed_or_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with results or gold paths, and how many of each."""
    a = table(spark, sf_dir, "topic_v4_llm_record", "record_sequence").groupBy("record_sequence").agg(F.count("*").alias("n_results"))
    b = table(spark, sf_dir, "gold_standard").distinct().groupBy("record_sequence").agg(F.count("*").alias("n_gold"))
    return a.join(b, "record_sequence", "full").select("record_sequence", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"))


def all_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of all tables one below the other, columns that a table lacks being NULL."""
    a = table(spark, sf_dir, "clean_records", "record_sequence", "title").withColumn("origin", F.lit("record"))
    b = table(spark, sf_dir, "topic_v4_llm_record", "record_sequence", "title", "result_id").withColumn("origin", F.lit("result"))
    c = table(spark, sf_dir, "remote_lookup").select(F.col("openalex_title").alias("title")).withColumn("origin", F.lit("remote"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten results of each stratum in hash order, to be reviewed by hand."""
    r = table(spark, sf_dir, "topic_v4_llm_record", "result_id", "sampling_stratum", "title")
    return R.stratified_sample(r, "sampling_stratum", "result_id", 10, 20260).withColumn("reviewer_note", F.lit(None).cast("string"))


def longest_in_journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest abstracts of each journal, ties included."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "journal", "abstract_word_count").where("journal is not null and abstract_word_count is not null")
    return R.keep_max_in_group(r, ["journal"], "abstract_word_count")


def specific_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ontology paths without the general one where its branch has a specific one."""
    p = F.split("hierarchy_path", r"\s*>\s*")
    o = table(spark, sf_dir, "ontology_v4", "path_id", "hierarchy_path").select("path_id", p[0].alias("broad_topic"), p[1].alias("subtopic"), p[2].alias("feature"), p[3].alias("component"))
    return R.drop_general_if_specific(o, ["broad_topic", "subtopic"], F.col("component") == "General")


def first_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense numbers of the source files in the order of their first record."""
    first = table(spark, sf_dir, "clean_records", "record_sequence", "source_file").groupBy("source_file").agg(F.min("record_sequence").alias("first_record"))
    return first.withColumn("file_no", F.dense_rank().over(W.orderBy("first_record")))


def request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in batches of 24 for a classifier, in their order."""
    return R.batch_numbers(table(spark, sf_dir, "clean_records", "record_sequence"), "record_sequence", 24)


def records_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with the lookup of their DOI; a DOI found several times gives several rows."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "doi").where("doi is not null")
    lookup = table(spark, sf_dir, "remote_lookup", "doi_for_lookup", "openalex_id", "openalex_lookup_status")
    return r.join(lookup, r["doi"] == lookup["doi_for_lookup"], "left").drop("doi_for_lookup")


_MISSING = ["title", "abstract", "authors", "doi", "year", "journal", "volume", "issue", "pages", "record_id"]
_METRICS = [("records", "count(*)"), ("record_ids", "count(distinct record_id)"), ("dois", "count(distinct doi)"), ("files", "count(distinct source_file)"), ("with_title", "count_if(has_title)"), ("with_abstract", "count_if(has_abstract)"), ("with_valid_doi", "count_if(has_valid_doi)"), ("first_year", "min(year)"), ("last_year", "max(year)")]

QUERIES = {
    f.__name__: f
    for f in (
        distinct_keep_first, count_by_journal, duplicate_ids, missingness, year_anomalies, audit_summary, journals_of_type, titles_in_order, source_flags, second_largest, length_quantiles, kind_by_language,
        length_histogram, classified_records, unclassified_records, reviewed_or_gold, all_titles, stratified_sample, longest_in_journal, specific_paths, first_appearance, request_batches, records_with_results,
    )
}
ORACLE = {
    "distinct_keep_first": "select record_sequence, doi, title, batch_no from clean_records where doi is not null qualify row_number() over (partition by doi order by batch_no, record_sequence) = 1",
    "count_by_journal": "select journal, count(*) as n from clean_records group by journal",
    "duplicate_ids": "select record_sequence, record_id, count(*) over (partition by record_id) as n_uses from clean_records where record_id is not null qualify n_uses > 1",
    "missingness": " union all ".join(f"select '{c}' as field, count(*) filter ({c} is null) as n_missing, round(100.0 * count(*) filter ({c} is null) / count(*), 4) as percent from clean_records" for c in _MISSING),
    "year_anomalies": "select record_sequence, year from clean_records where year < 1900 or year > year(harvested_at) + 1",
    "audit_summary": " union all ".join(f"select '{m}' as metric, cast({e} as bigint) as value from clean_records" for m, e in _METRICS),
    "journals_of_type": "select year, string_agg(distinct journal, '; ' order by journal) as journals, count(distinct journal) as n_journals from clean_records group by year",
    "titles_in_order": """
        with f as (select record_sequence, sampling_stratum, min(result_id) as o from topic_v4_llm_record group by all),
            c as (select record_sequence, count(*) as n_results from topic_v4_llm_record group by all)
        select record_sequence, coalesce(string_agg(sampling_stratum, '; ' order by o), '') as strata, any_value(n_results) as n_results from f join c using (record_sequence) group by all""",
    "source_flags": """select source_file, bool_or(coalesce(has_valid_doi, false)) as any_doi, bool_and(coalesce(has_title, false)) as all_titles, count_if(has_abstract) as n_abstracts, count(*) as n_records,
        count_if(has_abstract) / count(*) as abstract_share from clean_records group by source_file""",
    "second_largest": "select journal, list_sort(list(abstract_word_count) filter (abstract_word_count is not null), 'DESC')[2] as second_words from clean_records where journal is not null group by journal",
    "length_quantiles": "select doc_kind, quantile_cont(n_chars, 0.25) as q25, median(n_chars) as q50, quantile_cont(n_chars, 0.99) as q99 from documents group by doc_kind",
    "kind_by_language": "select doc_kind, " + ", ".join(f"count(*) filter (lang = '{x}') as \"{x}\"" for x in ("en", "no", "es", "de", "fr")) + " from documents group by doc_kind",
    "length_histogram": "with t as (select quantile_cont(n_chars, 0.99) as top from documents) select least(cast(floor(60 * n_chars / top) as bigint), 59) as bin, count(*) as n from documents, t where n_chars <= top group by all",
    "classified_records": "select record_sequence, title from clean_records where record_sequence in (select record_sequence from topic_v4_llm_record where not coalesce(classification_failed, false))",
    "unclassified_records": "select record_sequence, batch_no from clean_records where record_sequence not in (select record_sequence from topic_v4_llm_record where record_sequence is not null)",
    "reviewed_or_gold": """
        with a as (select record_sequence, count(*) as n_results from topic_v4_llm_record group by all), b as (select record_sequence, count(*) as n_gold from (select distinct * from gold_standard) group by all)
        select record_sequence, coalesce(n_results, 0) as n_results, coalesce(n_gold, 0) as n_gold from a full join b using (record_sequence)""",
    "all_titles": """
        select record_sequence, title, 'record' as origin, null::bigint as result_id from clean_records
        union all select record_sequence, title, 'result', result_id from topic_v4_llm_record union all select null, openalex_title, 'remote', null from remote_lookup""",
    "stratified_sample": "select result_id, sampling_stratum, title, null::varchar as reviewer_note from topic_v4_llm_record qualify row_number() over (partition by sampling_stratum order by md5(result_id || ':20260'), result_id) <= 10",
    "longest_in_journal": "select record_sequence, journal, abstract_word_count from clean_records where journal is not null and abstract_word_count is not null qualify abstract_word_count = max(abstract_word_count) over (partition by journal)",
    "specific_paths": r"""
        with p as (select path_id, regexp_split_to_array(hierarchy_path, '\s*>\s*') as l from ontology_v4),
            o as (select path_id, l[1] as broad_topic, l[2] as subtopic, l[3] as feature, l[4] as component from p)
        select * from o qualify component <> 'General' or not bool_or(component <> 'General') over (partition by broad_topic, subtopic)""",
    "first_appearance": "with f as (select source_file, min(record_sequence) as first_record from clean_records group by all) select *, cast(dense_rank() over (order by first_record) as int) as file_no from f",
    "request_batches": "select record_sequence, cast(ceil(row_number() over (order by record_sequence) / 24.0) as bigint) as batch from clean_records",
    "records_with_results": "select record_sequence, doi, openalex_id, openalex_lookup_status from clean_records left join remote_lookup on doi = doi_for_lookup where doi is not null",
}
