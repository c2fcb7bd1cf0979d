"""Registry and the inputs that several queries share.

Input expressions are plain SQL that Spark and DuckDB read alike, so both sides
start from the same derived rows.
"""
from __future__ import annotations

import functools
import os
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import studycorpus
from studycorpus.plans import scale

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

HOSTS = ("lms.example.edu",)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the Python workers, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="studycorpus-")
    root = os.path.dirname(os.path.dirname(os.path.abspath(studycorpus.__file__)))
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/studycorpus", "zip", root, "studycorpus"))
    _SHIPPED.add(app)


def query(name: str, sql: str | None = None):
    def register(fn):
        @functools.wraps(fn)
        def run(spark, sf_dir):
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str, *exprs: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.selectExpr(*exprs) if exprs else df
    return scale.spread(df) if name in ("documents", "pages") else df


# --- documents as the files of courses -----------------------------------------
FOLDER = """case doc_id % 5 when 0 then concat('Ch', cast(doc_id % 12 + 1 as string))
 when 1 then concat('Ch', cast(doc_id % 12 + 1 as string), '_', cast(doc_id % 12 + 2 as string))
 when 2 then 'Textbook' when 3 then 'Course Syllabus' else 'Notes' end"""
EXT = """case doc_id % 8 when 0 then '.pdf' when 1 then '.pptx' when 2 then '.docx' when 3 then '.xlsx'
 when 4 then '.csv' when 5 then '.txt' when 6 then '.html' else '.bin' end"""
PATH = f"concat({FOLDER}, '/', lpad(cast(doc_id % 20 as string), 2, '0'), '_doc', cast(doc_id as string), {EXT})"
FILE_COLS = ("doc_id", "source as course_id", f"{PATH} as path", "n_chars as size", "text as body")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *FILE_COLS)


# SQL side of the same rows
FILES_SQL = f"select {', '.join(FILE_COLS)} from documents"
TYPE_SQL = """case when {p} like '%.pdf' then case when {p} like 'Textbook/%' then 'reference_pdf' else 'lecture_pdf' end
 when {p} like '%.pptx' then 'slide' when {p} like '%.docx' then 'word_document' when {p} like '%.xlsx' then 'spreadsheet'
 when {p} like '%.csv' then 'csv_table' when {p} like '%.txt' or {p} like '%.html' then 'lms_page' else 'binary' end"""
RANK_SQL = """case when {p} like '%.txt' then 1 when {p} like '%.html' then 2 when {p} like '%.docx' or {p} like '%.xlsx' or {p} like '%.csv' then 3
 when {p} like '%.pptx' then 4 when {p} like '%.pdf' then 5 else 9 end"""
SID_SQL = "concat('src_', substring(sha1(concat({p}, '|', {t})), 1, 12))"
# the text rules on inputs whose only white space is blank and line feed
CLEAN_SQL = ("trim(regexp_replace(regexp_replace(regexp_replace({c}, '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), "
             "'\\n\\n\\n+', concat(chr(10), chr(10)), 'g'), concat(' ', chr(10)))")
NORM_SQL = "trim(regexp_replace(lower({c}), '\\s+', ' ', 'g'))"
WORDS_SQL = "len(regexp_extract_all({c}, '\\S+'))"
CHAPTERS_SQL = """case when doc_id % 5 = 0 then [doc_id % 12 + 1]
 when doc_id % 5 = 1 then [doc_id % 12 + 1, doc_id % 12 + 2] else []::bigint[] end"""
GROUP_SQL = """case when doc_id % 5 = 0 then concat('chapter_', lpad(cast(doc_id % 12 + 1 as varchar), 2, '0'))
 when doc_id % 5 = 1 then concat('chapter_', lpad(cast(doc_id % 12 + 1 as varchar), 2, '0'), '_', lpad(cast(doc_id % 12 + 2 as varchar), 2, '0'))
 when doc_id % 5 = 2 then 'references' when doc_id % 5 = 3 then '00_course' else 'other' end"""
# a file and what the first steps make of it: status from type and duplicate test
RECORDS_SQL = f"""files as ({FILES_SQL}),
typed as (select *, {TYPE_SQL.format(p='path')} as source_type, {RANK_SQL.format(p='path')} as rank,
  {CLEAN_SQL.format(c='body')} as clean, {NORM_SQL.format(c='body')} as norm, {CHAPTERS_SQL} as chapters, {GROUP_SQL} as grp from files),
ided as (select *, {SID_SQL.format(p='path', t='source_type')} as source_id from typed),
extracted as (select *, source_type <> 'binary' and source_type <> 'reference_pdf' as ex from ided),
firsts as (select *, first_value(path) over (partition by course_id, sha1(norm), ex order by rank, lower(path), path) as fp from extracted),
records as (select *, case when source_type = 'binary' then 'skipped_unsupported' when source_type = 'reference_pdf' then 'reference_indexed_only'
   when clean = '' then 'empty' when length(norm) >= 80 and fp <> path then 'duplicate' else 'ready' end as status from firsts)"""
