"""Queries that clean records and derive keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions import text as X
from skerry.sources.tables import table


def record_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned title, abstract, DOI and year of every record, with word counts and flags."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "title", "abstract_raw", "doi_raw", "year_raw")
    r = r.select("record_sequence", X.clean_na(F.col("title")).alias("title_clean"), X.clean_html(F.col("abstract_raw")).alias("abstract_clean"), X.normalise_doi(F.col("doi_raw")).alias("doi_clean"), X.year_of(F.col("year_raw")).alias("year_clean"))
    return r.select(
        "*",
        X.word_count(F.col("title_clean")).alias("title_words"),
        X.word_count(F.col("abstract_clean")).alias("abstract_words"),
        F.col("title_clean").isNotNull().alias("with_title"),
        F.col("abstract_clean").isNotNull().alias("with_abstract"),
        F.col("doi_clean").isNotNull().alias("with_doi"),
    )


def screening_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys by which records are compared."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "title", "authors", "doi")
    r = r.select("record_sequence", X.title_key(F.col("title")).alias("title_key"), X.empty_to_null(X.bare_doi(F.col("doi"))).alias("doi_key"), X.first_author_key(F.col("authors")).alias("author_key"))
    return r.select("*", F.substring("title_key", 1, 24).alias("title_prefix"), X.title_token_key(F.col("title_key")).alias("token_key"))


def title_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normalised title beside the stored one."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "title", "title_normalised")
    return r.select("record_sequence", X.empty_to_null(X.normalise_title(F.col("title"))).alias("title_words"), F.col("title_normalised").alias("stored"))


def screening_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text a screening model reads, as its length and fingerprint."""
    r = table(spark, sf_dir, "clean_records", "record_sequence", "title", "abstract")
    t = X.screening_text(F.col("title"), F.col("abstract"))
    return r.select("record_sequence", F.char_length(t).alias("n_chars"), F.md5(t.cast("binary")).alias("fingerprint"))


_WS = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{0085}]+"


def _squish(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _ascii(x: str) -> str:
    a, b = X.ascii_pairs()
    out = f"translate({x}, '{a}', '{b}')"
    for letter, plain in X.EXPANDED.items():
        out = f"replace({out}, '{letter}', '{plain}')"
    return out


_DOI = f"trim(regexp_replace(regexp_replace(lower(nullif({_squish('%s')}, 'NA')), '^https?://(dx\\.)?doi\\.org/', ''), '^doi:\\s*', ''))"
_HTML = "regexp_replace(coalesce(abstract_raw, ''), '<[^>]+>', ' ', 'g')"
for _e, _p in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
    _HTML = f"replace({_HTML}, '{_e}', '{_p}')"
_TITLE_KEY = _squish("regexp_replace(regexp_replace(lower(" + _ascii("coalesce(title, '')") + "), '&[a-z]+;', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')")
_AUTHOR_KEY = _squish("regexp_replace(lower(" + _ascii(r"regexp_split_to_array(coalesce(authors, ''), '\s*\|\s*|\s*;\s*')[1]") + "), '[^a-z0-9]+', ' ', 'g')")
_WORDS = "coalesce(len(regexp_extract_all(%s, '[^\\s\\x0b]+')), 0)"

QUERIES = {"record_fields": record_fields, "screening_keys": screening_keys, "title_normalised": title_normalised, "screening_texts": screening_texts}
ORACLE = {
    "record_fields": f"""
        with c as (
            select record_sequence, nullif({_squish('title')}, 'NA') as title_clean, nullif({_squish(_HTML)}, '') as abstract_clean,
                {_DOI.replace('%s', 'doi_raw')} as d, nullif(regexp_extract(year_raw, '((?:18|19|20)[0-9][0-9])', 1), '') as y
            from clean_records)
        select record_sequence, title_clean, abstract_clean, case when regexp_matches(d, '^10\\.\\d{{4,9}}/\\S+$') then d end as doi_clean,
            try_cast(y as int) as year_clean, cast({_WORDS % 'title_clean'} as int) as title_words, cast({_WORDS % 'abstract_clean'} as int) as abstract_words,
            title_clean is not null as with_title, abstract_clean is not null as with_abstract,
            case when regexp_matches(d, '^10\\.\\d{{4,9}}/\\S+$') then d end is not null as with_doi
        from c""",
    "screening_keys": f"""
        with k as (select record_sequence, {_TITLE_KEY} as title_key, nullif({_DOI.replace('%s', 'doi')}, '') as doi_key, {_AUTHOR_KEY} as author_key from clean_records)
        select *, substring(title_key, 1, 24) as title_prefix,
            array_to_string(list_sort(list_distinct(list_filter(string_split(title_key, ' '), lambda x: x <> '')[1:8])), ' ') as token_key
        from k""",
    "title_normalised": f"""
        select record_sequence, nullif({_squish("regexp_replace(" + _ascii("lower(title)") + ", '[^a-z0-9]+', ' ', 'g')")}, '') as title_words, title_normalised as stored
        from clean_records""",
    "screening_texts": f"""
        with t as (select record_sequence, {_squish("concat_ws(' ', 'TITLE_TITLE', coalesce(title, ''), 'TITLE_TITLE', coalesce(title, ''), 'ABSTRACT', coalesce(abstract, ''))")} as t from clean_records)
        select record_sequence, length(t) as n_chars, md5(t) as fingerprint from t""",
}
