"""Queries over lists in one field, identifiers, and samples for reviewers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import lists as L
from skerry.functions.text import bare_doi
from skerry.operators import relational as R
from skerry.sources.tables import table


def short_author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten different parts of author lists with semicolons."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "authors")
    return r.select("record_sequence", L.shorten_terms(F.col("authors")).alias("authors_short"))


def assigned_id_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each result as a set, those that the ontology has, and whether their number is the stored one."""
    r = table(spark, sf_dir, "topic_v4_llm_record", "result_id", "assigned_path_ids", "assignment_count")
    ids = table(spark, sf_dir, "ontology_v4", "path_id").agg(F.collect_set(F.lower("path_id")).alias("ids"))
    own = F.filter(F.split("id_set", "; "), lambda x: x != "")
    r = r.withColumn("id_set", L.normalised_set(F.col("assigned_path_ids"))).crossJoin(F.broadcast(ids))
    return r.select("result_id", "id_set", F.size(F.array_intersect(own, F.col("ids"))).alias("n_known"), F.size(F.array_except(own, F.col("ids"))).alias("n_unknown"), F.equal_null(F.size(own), F.col("assignment_count")).alias("as_counted"))


def doi_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrant and suffix of each DOI; further slashes stay in the suffix."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "doi").where("doi is not null")
    return r.select("record_sequence", *L.split_columns(bare_doi(F.col("doi")), "/", ["registrant", "suffix"]))


def lookup_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each DOI once, as part of an address."""
    doi = table(spark, sf_dir, "clean_records", "doi").where("doi is not null").select(bare_doi(F.col("doi")).alias("doi_key")).distinct()
    return doi.select("doi_key", F.concat(F.lit("doi:"), L.percent_encode(F.col("doi_key"))).alias("address"))


def all_dois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each DOI of records and lookups once."""
    records = table(spark, sf_dir, "clean_records", "doi").select(bare_doi(F.col("doi")).alias("doi_key"))
    looked_up = table(spark, sf_dir, "remote_lookup", "doi_for_lookup").select(bare_doi(F.col("doi_for_lookup")).alias("doi_key"))
    return R.union_distinct(records, looked_up).where("doi_key is not null")


def incomplete_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that lack a field a citation needs."""
    fields = ["title", "authors", "year", "journal"]
    return R.incomplete_cases(table(spark, sf_dir, "clean_records", "record_sequence", *fields), fields).select("record_sequence")


def filtered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by a rule for their type: journal articles need a DOI, others a title of four words."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "type", "has_valid_doi", "title_word_count")
    return R.filter_case(r, [(F.col("type") == "JOUR", F.col("has_valid_doi"))], F.col("title_word_count") >= 4).select("record_sequence", "type")


def journal_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with the number of different years of its journal, a missing year counted as one."""
    return R.add_distinct_count(table(spark, sf_dir, "clean_records", "record_sequence", "journal", "year"), ["journal"], "year", "n_years", count_null=True)


def review_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample for reviewers: 20 records of each of three kinds, none twice, short kinds filled from the rest."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "doi", "abstract_word_count", "year")
    kinds = {"no doi": F.col("doi").isNull(), "long abstract": F.col("abstract_word_count") >= 200, "no year": F.col("year").isNull()}
    return R.disjoint_strata(r, "record_sequence", kinds, 20, 41).select("record_sequence", "stratum")


def longest_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 100 longest abstracts."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "abstract_word_count").where("abstract_word_count is not null")
    return r.orderBy(F.desc("abstract_word_count"), "record_sequence").limit(100)


def shuffled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records in an order that looks random."""
    return R.shuffled(table(spark, sf_dir, "clean_records", "record_sequence", "title"), "record_sequence", 7)


def salmon_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words around the first "salmon" of each abstract."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "abstract").withColumn("s", F.locate("salmon", F.lower("abstract"))).where("s > 0")
    return r.select("record_sequence", F.col("s").alias("start"), L.context_window(F.col("abstract"), F.col("s"), F.col("s") + 5).alias("window"))


QUERIES = {f.__name__: f for f in (short_author_lists, assigned_id_sets, doi_parts, lookup_addresses, all_dois, incomplete_records, filtered_records, journal_years, review_strata, longest_abstracts, shuffled_records, salmon_windows)}

from skerry.plans.cleaning import _DOI, _squish  # noqa: E402

_HASH = "md5(record_sequence || ':41')"
_TAKE = lambda name, where, n, before: f"(select record_sequence, '{name}' as stratum from clean_records where {where} " + (f"and record_sequence not in (select record_sequence from {before}) " if before else "") + f"order by {_HASH}, record_sequence limit {n})"
ORACLE = {
    "short_author_lists": """
        with t as (select record_sequence, list_filter(regexp_split_to_array(coalesce(authors, ''), ';\\s*'), lambda x: x <> '') as a from clean_records)
        select record_sequence, array_to_string(list_filter(a, lambda x, i: list_position(list_transform(a, lambda y: lower(y)), lower(x)) = i)[1:10], '; ') as authors_short from t""",
    "assigned_id_sets": """
        with t as (select result_id, assignment_count, list_sort(list_distinct(list_transform(string_split(coalesce(assigned_path_ids, ''), ';'), lambda x: lower(trim(x))))) as l from topic_v4_llm_record),
            o as (select list(lower(path_id)) as ids from ontology_v4), k as (select *, list_filter(l, lambda x: x <> '') as own from t, o)
        select result_id, case when len(own) = 0 then '' else array_to_string(l, '; ') end as id_set, cast(len(list_intersect(own, ids)) as int) as n_known, cast(len(own) - len(list_intersect(own, ids)) as int) as n_unknown, len(own) is not distinct from assignment_count as as_counted from k""",
    "doi_parts": f"""
        with t as (select record_sequence, {_DOI.replace('%s', 'doi')} as d from clean_records where doi is not null)
        select record_sequence, string_split(d, '/')[1] as registrant, case when contains(d, '/') then substring(d, strpos(d, '/') + 1) end as suffix from t""",
    "lookup_addresses": f"with t as (select distinct {_DOI.replace('%s', 'doi')} as doi_key from clean_records where doi is not null) select doi_key, 'doi:' || url_encode(doi_key) as address from t",
    "all_dois": f"select * from (select {_DOI.replace('%s', 'doi')} as doi_key from clean_records union select {_DOI.replace('%s', 'doi_for_lookup')} from remote_lookup) where doi_key is not null",
    "incomplete_records": "select record_sequence from clean_records where title is null or authors is null or year is null or journal is null",
    "filtered_records": "select record_sequence, type from clean_records where case when type = 'JOUR' then has_valid_doi else title_word_count >= 4 end",
    "journal_years": """
        with c as (select journal, count(distinct year) + max((year is null)::int) as n_years from clean_records group by 1)
        select record_sequence, r.journal, year, n_years from clean_records r join c on r.journal is not distinct from c.journal""",
    "review_strata": f"""
        with a as {_TAKE('no doi', 'doi is null', 20, None)}, b as (select * from a union all select * from {_TAKE('long abstract', 'abstract_word_count >= 200', 20, 'a')}),
            c as (select * from b union all select * from {_TAKE('no year', 'year is null', 20, 'b')})
        select * from c union all select * from {_TAKE('fill', 'true', '(select 60 - count(*) from c)', 'c')}""",
    "longest_abstracts": "select record_sequence, abstract_word_count from clean_records where abstract_word_count is not null order by abstract_word_count desc, record_sequence limit 100",
    "shuffled_records": "select record_sequence, title from clean_records",
    "salmon_windows": f"""
        with t as (select *, strpos(lower(abstract), 'salmon') as s from clean_records)
        select record_sequence, cast(s as int) as start, {_squish("substring(abstract, cast(greatest(1, s - 100) as bigint), cast(s + 105 - greatest(1, s - 100) + 1 as bigint))")} as "window" from t where s > 0""",
}
