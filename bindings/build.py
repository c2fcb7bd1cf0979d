"""Records, chunks, reports, refresh and publication on the documents table."""
from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, functions as F

from studycorpus.functions import fixed_values as V, text as T
from studycorpus.operators import chunking, classify, dedup, refresh, reports, validate
from studycorpus.operators.redact import PROFILES, redact, redact_text
from studycorpus.plans import corpus, scale
from studycorpus.sources import manifests

from .base import (CHAPTERS_SQL, CLEAN_SQL, FILES_SQL, GROUP_SQL, NORM_SQL, PATH, RANK_SQL, RECORDS_SQL, SID_SQL, TYPE_SQL,
                   WORDS_SQL, documents, query, table)


def scratch(spark, name: str) -> str:
    """New folder for a query that writes, in the shared folder of the session."""
    return f"{scale.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- exact duplicates: one language is one course, rank planted -----------------

@query("dedup_exact", f"""
with s as (select lang as course_id, {PATH} as path, doc_id % 10 as rank, {CLEAN_SQL.format(c='text')} as clean,
                  {NORM_SQL.format(c='text')} as norm from documents),
k as (select *, case when length(norm) >= 80 then sha1(norm) end as text_key from s),
w as (select *, row_number() over (partition by course_id, text_key order by rank, lower(path), path) as rn,
             first_value(path) over (partition by course_id, text_key order by rank, lower(path), path) as fp from k)
select course_id, path, case when clean = '' then 'empty' when text_key is not null and rn > 1 then 'duplicate' else 'ready' end as status,
       length(clean) as chars, {WORDS_SQL.format(c='clean')} as words,
       case when text_key is not null and rn > 1 then concat('Duplicate text of ', fp) else '' end as note from w""")
def dedup_exact(spark, sf):
    docs = table(spark, sf, "documents", "lang as course_id", f"{PATH} as path", "doc_id % 10 as rank", "text as body")
    return dedup.dedup_exact(docs).select("course_id", "path", "status", "chars", "words", "note")


CHUNKS_SQL = f"""
texts as (select course_id, {SID_SQL.format(p='path', t='source_type')} as source_id, {CLEAN_SQL.format(c='body')} as t from
  (select *, {TYPE_SQL.format(p='path')} as source_type from ({FILES_SQL}))),
cut as (select course_id, source_id, t, unnest(range(case when t = '' then 0 when length(t) <= 4800 then 1
          else cast(ceil((length(t) - 4800) / 4300.0) as bigint) + 1 end)) as k from texts),
chunks as (select course_id, source_id, cast(k + 1 as bigint) as ordinal,
       concat(source_id, '_c', lpad(cast(k + 1 as varchar), 4, '0')) as chunk_id,
       trim(substring(t, k * 4300 + 1, 4800), concat(' ', chr(10))) as text from cut)"""


@query("chunk_units", f"with {CHUNKS_SQL} select course_id, source_id, ordinal, chunk_id, text from chunks")
def chunk_units(spark, sf):
    docs = documents(spark, sf).withColumn("ext", T.suffix("path"))
    ided = docs.select("course_id", T.source_id("path", classify.source_type("path", "ext")).alias("source_id"), "body")
    return chunking.chunk_bodies(ided).select("course_id", "source_id", F.col("ordinal").cast("long").alias("ordinal"), "chunk_id", "text")


def stripped_sql(c: str) -> str:
    return f"trim({c}, concat(' ', chr(10)))"


@query("chunk_paragraphs", f"""with recursive u as (select conv_id, turn // 10 as unit_no, list_filter(list({CLEAN_SQL.format(c='text')} order by turn), lambda x: x <> '') as ps
  from conversations group by 1, 2),
s as (select conv_id, unit_no, ps, 0::bigint as i, []::varchar[] as done, '' as held from u
 union all select conv_id, unit_no, ps, i + 1,
  case when length(p) > 500 then list_concat(case when held = '' then done else list_append(done, {stripped_sql('held')}) end,
      list_transform(range(cast(ceil((length(p) - 500) / 450.0) as bigint) + 1), lambda k: {stripped_sql('substring(p, k * 450 + 1, 500)')}))
    when length(j) <= 500 then done else list_append(done, {stripped_sql('held')}) end,
  case when length(p) > 500 then '' when length(j) <= 500 then j
    else {stripped_sql(f"concat({stripped_sql('right(held, 50)')}, chr(10), chr(10), p)")} end
 from (select *, ps[i + 1] as p, case when held = '' then ps[i + 1] else concat(held, chr(10), chr(10), ps[i + 1]) end as j from s where i < len(ps))),
e as (select conv_id, unit_no, list_filter(case when held = '' then done else list_append(done, {stripped_sql('held')}) end, lambda x: x <> '') as pieces from s where i = len(ps)),
f as (select conv_id, unit_no, unnest(range(len(pieces))) as pos, unnest(pieces) as text from e),
o as (select *, row_number() over (partition by conv_id order by unit_no, pos) as ordinal from f)
select 'conversations' as course_id, concat('conv_', conv_id) as source_id, unit_no, concat('part ', unit_no + 1) as locator, text, ordinal,
  concat('conv_', conv_id, '_c', lpad(cast(ordinal as varchar), 4, '0')) as chunk_id from o""")
def chunk_paragraphs(spark, sf):
    """Turns of a conversation are the paragraphs of one unit; one unit per ten turns."""
    turns = table(spark, sf, "conversations").withColumn("unit_no", F.floor(F.col("turn") / 10))
    parts = turns.groupBy("conv_id", "unit_no").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    units = parts.select(F.lit("conversations").alias("course_id"), F.concat(F.lit("conv_"), "conv_id").alias("source_id"),
                         "unit_no", F.concat(F.lit("part "), F.col("unit_no") + 1).alias("locator"),
                         F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("text"))
    return chunking.chunk_units(units, 500, 50)


# --- classification ---------------------------------------------------------------

@query("classify_sources", f"""
with f as ({FILES_SQL}), t as (select *, {TYPE_SQL.format(p='path')} as source_type, {RANK_SQL.format(p='path')} as rank from f)
select course_id, path, regexp_extract(path, '(\\.[a-z]+)$', 1) as ext, source_type, rank,
  case source_type when 'slide' then 2 when 'lecture_pdf' then 2 when 'reference_pdf' then 4 when 'binary' then 5 else 1 end as priority,
  path not like '%.bin' as is_supported, path not like '%.bin' as is_lecturer_material,
  replace(regexp_extract(path, '/(.*)\\.', 1), '_', ' ') as title, {SID_SQL.format(p='path', t='source_type')} as source_id from t""")
def classify_sources(spark, sf):
    return classify.classify_sources(documents(spark, sf)).select(
        "course_id", "path", "ext", "source_type", "rank", "priority", "is_supported", "is_lecturer_material", "title", "source_id")


@query("gate_references", f"""
with f as ({FILES_SQL}), t as (select *, {TYPE_SQL.format(p='path')} as source_type from f)
select course_id, path, source_type, case when source_type = 'reference_pdf' then 'reference_indexed_only' end as status,
  source_type <> 'reference_pdf' as to_extract from t""")
def gate_references(spark, sf):
    return classify.gate_references(classify.classify_sources(documents(spark, sf))).select(
        "course_id", "path", "source_type", "status", "to_extract")


@query("assign_group", f"""
with f as ({FILES_SQL}) select course_id, path, {GROUP_SQL} as "group", list_extract({CHAPTERS_SQL}, 1) as chapter,
  array_to_string(case when doc_id % 5 = 3 then [0] else {CHAPTERS_SQL} end, ',') as chapters from f""")
def assign_group(spark, sf):
    out = classify.assign_group(documents(spark, sf))
    return out.select("course_id", "path", "group", "chapter",
                      F.array_join(F.transform("chapters", lambda n: n.cast("string")), ",").alias("chapters"))


TITLES = {0: "Tuần 3: Bài giảng", 1: "Thực hành - Lab 2", 2: "Bài tập lớn (BTL)", 3: "Tài liệu tham khảo", 4: "Thông tin môn học",
          5: "Đồ án môn học", 6: "Course_Information", 7: "Laboratory–Report", 8: "Khác", 9: "Reading books week 2"}
BUCKETS = {0: "lectures", 1: "labs", 2: "assignments", 3: "references", 4: "course_info", 5: "other", 6: "course_info",
           7: "labs", 8: "other", 9: "references"}
TITLE_SQL = "case doc_id % 10 " + " ".join(f"when {k} then '{v}'" for k, v in TITLES.items()) + " end"


@query("bucket_sections", f"""select doc_id, {TITLE_SQL} as section_title,
 case doc_id % 10 {' '.join(f"when {k} then '{v}'" for k, v in BUCKETS.items())} end as bucket from documents""")
def bucket_sections(spark, sf):
    return classify.bucket_sections(table(spark, sf, "documents", "doc_id", f"{TITLE_SQL} as section_title"))


# --- records and reports -------------------------------------------------------------

def records_of(spark, sf) -> DataFrame:
    return corpus.build_records(documents(spark, sf))


@query("document_records", f"""with {RECORDS_SQL}
select course_id, source_id, path as source_path, source_type, grp as "group", status,
  case when status in ('ready', 'duplicate') then length(clean) else 0 end as chars,
  case when status in ('ready', 'duplicate') then {WORDS_SQL.format(c='clean')} else 0 end as words from records""")
def document_records(spark, sf):
    return records_of(spark, sf).select("course_id", "source_id", "source_path", "source_type", "group", "status", "chars", "words")


@query("corpus_stats", f"""with {RECORDS_SQL}, n as (select course_id, source_id, case when length(clean) <= 4800 then 1
    else cast(ceil((length(clean) - 4800) / 4300.0) as bigint) + 1 end as k from records where status = 'ready'),
c as (select course_id, sum(k) as chunks from n group by 1),
ty as (select course_id, string_agg(concat(source_type, '=', n), ',' order by source_type) as source_types from
   (select course_id, source_type, count(*) as n from records group by all) group by 1),
st as (select course_id, string_agg(concat(status, '=', n), ',' order by status) as statuses from
   (select course_id, status, count(*) as n from records group by all) group by 1)
select r.course_id, count(*) as documents_total, count(*) filter (status = 'ready') as documents_ready,
  cast(any_value(coalesce(c.chunks, 0)) as bigint) as chunks,
  cast(sum(case when status = 'ready' then {WORDS_SQL.format(c='clean')} else 0 end) as bigint) as words_ready,
  count(*) filter (status = 'reference_indexed_only') as references_indexed_only, any_value(ty.source_types) as source_types,
  any_value(st.statuses) as statuses,
  coalesce(array_to_string(list_sort(list(distinct grp) filter (grp like 'chapter_%')), ','), '') as chapter_groups
from records r left join c using (course_id) left join ty using (course_id) left join st using (course_id) group by r.course_id""")
def corpus_stats(spark, sf):
    files = documents(spark, sf)
    records = scale.checkpointed(corpus.build_records(files))
    chunks = corpus.chunk_counts(records, files)
    as_text = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return reports.corpus_stats(records, chunks).select(
        "course_id", "documents_total", "documents_ready", "chunks", "words_ready", "references_indexed_only",
        as_text("source_types").alias("source_types"), as_text("statuses").alias("statuses"),
        F.array_join("chapter_groups", ",").alias("chapter_groups"))


META_PATH = f"case when doc_id % 50 = 7 then '_meta/stats.json' else {PATH} end"


def inventory_files(spark, sf) -> DataFrame:
    return classify.classify_sources(table(spark, sf, "documents", "source as course_id", f"{META_PATH} as path", "n_chars as size"))


INVENTORY_SQL = f"with f as (select source as course_id, {META_PATH} as path, n_chars as size from documents)"


@query("source_inventory", f"""{INVENTORY_SQL}
select course_id, count(*) as total_source_files, cast(sum(size) as bigint) as total_input_bytes,
  count(*) filter (path not like '%.bin' and path not like '_meta/%') as supported_files,
  count(*) filter (path like '%.bin') as unsupported_files,
  count(*) filter (path not like '%.bin' and path not like '_meta/%') as lecturer_material_candidates,
  count(*) filter (path like '_meta/%') as metadata_files from f group by 1""")
def source_inventory(spark, sf):
    return reports.source_inventory(inventory_files(spark, sf))


@query("extension_counts", f"{INVENTORY_SQL} select course_id, regexp_extract(path, '(\\.[a-z]+)$', 1) as ext, count(*) as files from f group by all")
def extension_counts(spark, sf):
    return reports.extension_counts(inventory_files(spark, sf))


@query("unsupported_paths", f"""select source as course_id, '.bin' as ext,
 regexp_replace(concat('token=', doc_id, '/', {PATH}), 'token=[^/]*', 'token=[redacted]') as path from documents where doc_id % 8 = 7""")
def unsupported_paths(spark, sf):
    files = table(spark, sf, "documents", "source as course_id", f"concat('token=', cast(doc_id as string), '/', {PATH}) as path",
                  "n_chars as size")
    return reports.unsupported_paths(classify.classify_sources(files))


@query("source_metrics", f"""with {RECORDS_SQL}, r as (select *, source_type in ('lecture_pdf','slide','word_document','spreadsheet')
   and status = 'ready' as visual, case when status <> 'ready' then 0 when length(clean) <= 4800 then 1
   else cast(ceil((length(clean) - 4800) / 4300.0) as bigint) + 1 end as k from records)
select course_id, count(*) filter (status = 'ready') as ready_source_count, cast(sum(k) as bigint) as chunk_count,
  count(*) filter (visual and doc_id % 3 = 0) as retained_lecturer_source_count, count(*) filter (status = 'error') as source_error_count,
  count(*) filter (status = 'skipped_unsupported') as unsupported_source_count,
  count(*) filter (k > 0 or (visual and doc_id % 3 = 0)) as meaningful_lecturer_source_count,
  bool_or(k > 0 or (visual and doc_id % 3 = 0)) as viable from r group by 1""")
def source_metrics(spark, sf):
    files = documents(spark, sf)
    records = corpus.build_records(files)
    chunks = corpus.build_chunks(records, files, texts=False)
    number = F.regexp_extract("source_path", r"_doc(\d+)", 1).cast("long")
    return reports.source_metrics(records, chunks, records.filter(number % 3 == 0))


@query("chapter_gaps", f"""with {RECORDS_SQL}, c as (select distinct course_id, unnest(chapters) as n from records where status = 'ready' and doc_id % 12 <> 4),
 m as (select course_id, min(n) as lo, max(n) as hi from c group by 1),
 a as (select course_id, unnest(range(lo, hi + 1)) as chapter from m)
select course_id, chapter from a where not exists (select 1 from c where c.course_id = a.course_id and c.n = a.chapter)""")
def chapter_gaps(spark, sf):
    # every twelfth file is an error, so that gaps appear
    number = F.regexp_extract("source_path", r"_doc(\d+)", 1).cast("long")
    records = records_of(spark, sf).withColumn("status", F.when(number % 12 == 4, "error").otherwise(F.col("status")))
    return reports.chapter_gaps(records)


LABEL_SQL = """case when grp = '00_course' then 'Course information' when grp not like 'chapter_%' then 'Unclassified sources'
 when len(chapters) = 1 then concat('Chapter ', chapters[1]) else concat('Chapters ', chapters[1], '–', chapters[2]) end"""
GAPS_SQL = """c as (select distinct course_id, unnest(chapters) as n from records where status = 'ready'),
 m as (select course_id, min(n) as lo, max(n) as hi from c group by 1),
 a as (select course_id, unnest(range(lo, hi + 1)) as chapter from m),
 gaps as (select course_id, chapter from a where not exists (select 1 from c where c.course_id = a.course_id and c.n = a.chapter))"""


@query("course_roadmap", f"""with {RECORDS_SQL}, {GAPS_SQL},
g as (select course_id, grp, any_value({LABEL_SQL}) as label, any_value(chapters) as chapters, count(*) as sources,
   cast(sum({WORDS_SQL.format(c='clean')}) as bigint) as words from records where status = 'ready' group by 1, 2),
f as (select course_id, case when count(*) filter (status = 'ready') = 0 then 'Low' when count(*) filter (status <> 'ready') > 0
   or (select count(*) from gaps where gaps.course_id = records.course_id) > 0 then 'Medium' else 'High' end as confidence from records group by 1)
select course_id, grp as "group", label, sources, words, confidence, row_number() over (partition by course_id order by
  case when grp = '00_course' then 0 when grp like 'chapter_%' then 1 when grp = 'references' then 2 else 3 end, chapters, grp) as place
from g join f using (course_id)""")
def course_roadmap(spark, sf):
    return reports.course_roadmap(records_of(spark, sf)).select("course_id", "group", "label", "sources", "words", "confidence", "place")


@query("order_sources", f"""with f as ({FILES_SQL}) select course_id, path as source_path, doc_id % 20 as "order",
 row_number() over (partition by course_id order by doc_id % 20, lower(path), path) as position from f""")
def order_sources(spark, sf):
    files = documents(spark, sf).select("course_id", F.col("path").alias("source_path"))
    return reports.order_sources(files)


@query("roadmap_sources", f"""with {RECORDS_SQL} select course_id, grp as "group", source_id, doc_id % 20 as "order",
 row_number() over (partition by course_id, grp order by doc_id % 20, lower(replace(regexp_extract(path, '/(.*)\\.', 1), '_', ' ')), source_id) as position
 from records where status = 'ready'""")
def roadmap_sources(spark, sf):
    return reports.roadmap_sources(records_of(spark, sf)).drop("title")


@query("source_index", f"""with {RECORDS_SQL}, t as (select conv_id, turn, role from conversations),
l as (select conv_id, role || ' ' || (turn % 40) as locator, min(turn) as seen from t group by all),
p as (select *, row_number() over (partition by conv_id order by seen) as rn from l),
x as (select conv_id, string_agg(locator, '|' order by seen) as locators from p group by 1)
select course_id, source_id, doc_id % 20 as "order", status, case when grp = '00_course' then 'Unclassified sources' else {LABEL_SQL} end as chapter_label, coalesce(locators, '') as locators
from records left join x on x.conv_id = records.doc_id""")
def source_index(spark, sf):
    # locators: the turns of the conversation with the number of the document
    records = records_of(spark, sf)
    number = F.regexp_extract("source_path", r"_doc(\d+)", 1).cast("long")
    turns = table(spark, sf, "conversations", "conv_id", "turn as ordinal", "concat(role, ' ', cast(turn % 40 as string)) as locator")
    chunks = turns.join(records.select("course_id", "source_id", number.alias("conv_id")), "conv_id")
    return reports.source_index(records, chunks).select("course_id", "source_id", "order", "status", "chapter_label",
                                                        F.array_join("locators", "|").alias("locators"))


@query("coverage", f"""with {RECORDS_SQL}, {GAPS_SQL}
select course_id, 'roadmap' as kind, '[ ]' as mark, label as subject, '' as detail from
  (select distinct course_id, grp, {LABEL_SQL} as label from records where status = 'ready')
union all select course_id, 'gap', '[?]', concat('Chapter ', chapter), 'SOURCE GAP' from gaps
union all select course_id, 'unresolved', '[?]', path, case status when 'duplicate' then concat('Duplicate text of ', fp)
  when 'skipped_unsupported' then 'Unsupported source type: .bin' when 'reference_indexed_only' then 'Indexed only; include references to extract it'
  else status end from records where status <> 'ready'""")
def coverage(spark, sf):
    return reports.coverage(records_of(spark, sf))


@query("section_headings", """select conv_id, turn // 30 as part, string_agg(concat('## ', role, ' ', turn), '|' order by turn) as headings
 from conversations group by 1, 2""")
def section_headings(spark, sf):
    """Thirty turns of a conversation are one text."""
    turns = table(spark, sf, "conversations").withColumn("part", F.floor(F.col("turn") / 30))
    bodies = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(
        F.lit("## "), "role", F.lit(" "), "turn", F.lit("  \n"), "text").alias("p")))).alias("t")).select(
        "conv_id", "part", F.array_join(F.transform("t", lambda x: x["p"]), "\n").alias("body"))
    out = reports.section_headings(bodies)
    return out.select("conv_id", "part", F.array_join(F.transform("headings", lambda h: F.concat(F.lit("## "), h)), "|").alias("headings"))


# --- renderings and sinks --------------------------------------------------------------

RENDER_SQL = f"""rendered as (select course_id, source_id, grp, path, doc_id, replace(regexp_extract(path, '/(.*)\\.', 1), '_', ' ') as title, fp,
 concat('---', chr(10), 'source_id: "', source_id, '"', chr(10), 'title: "', replace(regexp_extract(path, '/(.*)\\.', 1), '_', ' '), '"', chr(10),
 'source_path: "', path, '"', chr(10), 'source_type: "', source_type, '"', chr(10), 'priority: ',
 case source_type when 'slide' then 2 when 'lecture_pdf' then 2 else 1 end, chr(10), 'group: "', grp, '"', chr(10),
 'chapter: ', coalesce(cast(chapters[1] as varchar), 'null'), chr(10), 'chapters: [', array_to_string(case when grp = '00_course' then [0] else chapters end, ', '), ']', chr(10), '---', chr(10), chr(10),
 '# ', replace(regexp_extract(path, '/(.*)\\.', 1), '_', ' '), chr(10), chr(10), clean, chr(10)) as text from records where status = 'ready')"""


@query("render_docs", f"""with {RECORDS_SQL}, {RENDER_SQL} select course_id, source_id, concat('documents/',
  case when grp like 'chapter_%' then 'chapters/' else '' end, grp, '/', replace(title, ' ', '_'), '__', source_id, '.md') as output_path, text from rendered""")
def render_docs(spark, sf):
    files = documents(spark, sf)
    return manifests.render_docs(corpus.build_records(files), corpus.bodies(files)).drop("group")


@query("render_chunks", f"""with {RECORDS_SQL}, d as (select *, replace(regexp_extract(path, '/(.*)\\.', 1), '_', ' ') as title from records where status = 'ready'),
cut as (select *, unnest(range(case when clean = '' then 0 when length(clean) <= 4800 then 1 else cast(ceil((length(clean) - 4800) / 4300.0) as bigint) + 1 end)) as k from d),
c as (select *, concat(source_id, '_c', lpad(cast(k + 1 as varchar), 4, '0')) as chunk_id, trim(substring(clean, k * 4300 + 1, 4800), concat(' ', chr(10))) as piece from cut)
select course_id, source_id, chunk_id, concat('chunks/', case when grp like 'chapter_%' then 'chapters/' else '' end, grp, '/', chunk_id, '.md') as chunk_path,
 concat('---', chr(10), 'chunk_id: "', chunk_id, '"', chr(10), 'source_id: "', source_id, '"', chr(10), 'title: "', title, '"', chr(10),
 'source_path: "', path, '"', chr(10), 'source_type: "', source_type, '"', chr(10), 'priority: ',
 case source_type when 'slide' then 2 when 'lecture_pdf' then 2 else 1 end, chr(10), 'group: "', grp, '"', chr(10),
 'chapter: ', coalesce(cast(chapters[1] as varchar), 'null'), chr(10), 'chapters: [', array_to_string(case when grp = '00_course' then [0] else chapters end, ', '), ']', chr(10),
 'locator: "document"', chr(10), '---', chr(10), chr(10), '# ', title, chr(10), chr(10), '**Location:** document', chr(10), chr(10), piece, chr(10)) as text from c""")
def render_chunks(spark, sf):
    files = documents(spark, sf)
    return manifests.render_chunks(corpus.build_chunks(corpus.build_records(files), files)).drop("group")


@query("chapter_rollup", f"""with {RECORDS_SQL}, {RENDER_SQL},
heads as (select distinct course_id, grp, {LABEL_SQL} as label from records where status = 'ready')
select course_id, grp as "group", row_number() over (partition by course_id, grp order by doc_id % 20, lower(title), source_id) as part_no,
  concat('## ', title, chr(10), chr(10), 'Source ID: `', source_id, '`', chr(10), 'Original material: `', path, '`', chr(10), chr(10),
  rtrim(text, concat(' ', chr(10))), chr(10), chr(10), '---', chr(10)) as text from rendered
union all select course_id, grp, 0, concat('# ', label, chr(10), chr(10), 'Teaching evidence from this course''s supplied sources.', chr(10)) from heads""")
def chapter_rollup(spark, sf):
    files = documents(spark, sf)
    records = scale.checkpointed(corpus.build_records(files))
    return manifests.chapter_rollup(records, manifests.stored_docs(records, corpus.bodies(files))).drop("source_id")


@query("manifests_roundtrip", f"""with {RECORDS_SQL} select 'documents' as file, course_id, count(*) as n,
   cast(sum(case when status in ('ready', 'duplicate') then length(clean) else 0 end) as bigint) as chars from records group by 2
 union all select 'documents_csv', course_id, count(*), cast(sum(case when status in ('ready', 'duplicate') then length(clean) else 0 end) as bigint) from records group by 2
 union all select 'corpus', course_id, cast(sum(case when length(clean) <= 4800 then 1 else ceil((length(clean) - 4800) / 4300.0) + 1 end) as bigint),
   cast(sum(length(clean) + 500 * case when length(clean) <= 4800 then 0 else ceil((length(clean) - 4800) / 4300.0) end) as bigint)
   from records where status = 'ready' group by 2""")
def manifests_roundtrip(spark, sf):
    """Written as JSON lines and CSV, read back; chunk sizes count their overlap."""
    files = documents(spark, sf)
    records = scale.checkpointed(corpus.build_records(files))
    chunks = corpus.build_chunks(records, files)
    out = scratch(spark, "manifests")
    manifests.write_manifests(records, chunks.withColumn("cut_chars", F.length("text")), reports.corpus_stats(records, chunks), out)
    docs = spark.read.schema("course_id string, chars long").json(f"{out}/documents")
    flat = spark.read.option("header", "true").option("escape", '"').csv(f"{out}/documents_csv").select("course_id", F.col("chars").cast("long"))
    # strides keep the characters that trimming the ends takes away
    cut = spark.read.schema("course_id string, source_id string, text string, ordinal long").json(f"{out}/corpus")
    lengths = (cut.groupBy("course_id", "source_id").agg(F.count("*").alias("n"))
                  .join(records.select("course_id", "source_id", "chars"), ["course_id", "source_id"]))
    sums = lambda df, name: df.groupBy("course_id").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).select(
        F.lit(name).alias("file"), "course_id", "n", "chars")
    corpus_rows = lengths.groupBy("course_id").agg(F.sum("n").alias("n"), F.sum(
        F.col("chars") + V.CHUNK_OVERLAP * (F.col("n") - 1)).alias("chars")).select(F.lit("corpus").alias("file"), "course_id", "n", "chars")
    return sums(docs, "documents").unionByName(sums(flat, "documents_csv")).unionByName(corpus_rows)


PUBLISH_BAD = "course_id in ('src3', 'src7')"


@query("publish", f"""with {RECORDS_SQL}, old as (select course_id, count(*) as n from records where doc_id % 3 <> 0 group by 1),
 new as (select course_id, count(*) as n from records group by 1)
select course_id, case when {PUBLISH_BAD} then old.n else new.n end as records from new join old using (course_id)""")
def publish(spark, sf):
    """A first version of part of the files, then all files; two courses get a
    fault in the second version and stay at the first."""
    number = F.regexp_extract("source_path", r"_doc(\d+)", 1).cast("long")
    records = scale.checkpointed(records_of(spark, sf))
    path = scratch(spark, "publish")

    def check(tables):
        return tables["records"].filter(T.is_absolute("source_path")).select("course_id", F.lit("error").alias("severity")).distinct()

    manifests.publish_if_valid({"records": records.filter(number % 3 != 0)}, path, check)
    faulty = records.withColumn("source_path", F.when(F.expr(PUBLISH_BAD), F.concat(F.lit("/home/x/"), "source_path"))
                                .otherwise(F.col("source_path")))
    manifests.publish_if_valid({"records": faulty}, path, check)
    return manifests.read_current(spark, path, "records").groupBy("course_id").agg(F.count("*").alias("records"))


# --- refresh -----------------------------------------------------------------------------

def snapshots(spark, sf):
    """Every seventh file is missing before, every fifth now; every eleventh text differs."""
    docs = table(spark, sf, "documents", "doc_id", "source as course_id", f"{PATH} as logical_path", "text")
    prior = docs.filter("doc_id % 7 <> 0").select("course_id", "logical_path", F.sha2("text", 256).alias("sha256"))
    now = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = docs.filter("doc_id % 5 <> 0").select("course_id", "logical_path", F.sha2(now, 256).alias("sha256"))
    return current, prior


CHANGES_SQL = f"""changes as (select doc_id, source as course_id, {PATH} as logical_path,
  case when doc_id % 7 = 0 then 'new' when doc_id % 5 = 0 then 'removed' when doc_id % 11 = 0 then 'changed' else 'reused' end as change
  from documents where doc_id % 7 <> 0 or doc_id % 5 <> 0)"""


@query("refresh_changes", f"with {CHANGES_SQL} select course_id, logical_path, change from changes")
def refresh_changes(spark, sf):
    return refresh.source_changes(*snapshots(spark, sf))


PACKAGE = ("case when course_id in ('src1', 'src2') then null else course_id <> 'src4' end as has_manifest",
           "course_id <> 'src5' as viable", "case when course_id = 'src6' then 'v0' else 'v1' end as fingerprint")


@query("refresh_plan", f"""with {CHANGES_SQL}, c as (select course_id, count(*) filter (change = 'new') as a, count(*) filter (change = 'changed') as b,
  count(*) filter (change = 'removed') as r, count(*) filter (change = 'reused') as u from changes group by 1),
s as (select *, case when course_id in ('src1', 'src2') then 'missing' when course_id in ('src4', 'src6') then 'legacy' when course_id = 'src5' then 'invalid'
  when a + b + r = 0 then 'up_to_date' else 'dirty' end as state from c)
select course_id, state, state <> 'up_to_date' as requires_rebuild, case when state in ('up_to_date', 'dirty') then a else a + b + u end as n_new,
  case when state in ('up_to_date', 'dirty') then b else 0 end as n_changed, case when state in ('up_to_date', 'dirty') then r else 0 end as n_removed,
  case when state in ('up_to_date', 'dirty') then u else 0 end as n_reused from s""")
def refresh_plan(spark, sf):
    current, prior = snapshots(spark, sf)
    packages = prior.select("course_id").distinct().selectExpr("course_id", *PACKAGE).filter("has_manifest is not null")
    return refresh.refresh_plan(current, prior, packages, "v1")[1]


@query("manifest_diff", f"""with {CHANGES_SQL} select course_id, logical_path, case change when 'new' then 'only_a' when 'removed' then 'only_b' else 'both' end as side from changes""")
def manifest_diff(spark, sf):
    return refresh.manifest_diff(*snapshots(spark, sf))


@query("carry_forward", f"""with {CHANGES_SQL}, {CHUNKS_SQL}, k as (select course_id, source_id, count(*) as chunks from chunks group by 1, 2),
t as (select *, {TYPE_SQL.format(p='logical_path')} as ty from changes where change = 'reused')
select course_id, logical_path as source_path, {SID_SQL.format(p='logical_path', t='ty')} as source_id, k.chunks
from t join k using (course_id) where k.source_id = {SID_SQL.format(p='logical_path', t='ty')}""")
def carry_forward(spark, sf):
    current, prior = snapshots(spark, sf)
    files = classify.classify_sources(documents(spark, sf)).withColumnRenamed("path", "source_path")
    docs, chunks = refresh.carry_forward(files.select("course_id", "source_id", "source_path"),
                                         chunking.chunk_bodies(files.select("course_id", "source_id", "body")),
                                         refresh.source_changes(current, prior))
    n = chunks.groupBy("course_id", "source_id").agg(F.count("*").alias("chunks"))
    return docs.join(n, ["course_id", "source_id"]).select("course_id", "source_path", "source_id", "chunks")


@query("incremental_refresh", f"""with f0 as ({FILES_SQL}), files as (select doc_id, course_id, path, size,
   case when doc_id % 11 = 0 then concat(body, '!') else body end as body from f0 where doc_id % 5 <> 0),
 {RECORDS_SQL[RECORDS_SQL.index('typed as'):]},
n as (select source_id, case when length(clean) <= 4800 then 1 else cast(ceil((length(clean) - 4800) / 4300.0) as bigint) + 1 end as k from records where status = 'ready')
select course_id, path as source_path, status, cast(coalesce(k, 0) as bigint) as chunks from records left join n using (source_id)""")
def incremental_refresh(spark, sf):
    """Refresh of the old corpus; the SQL side builds the new corpus from nothing."""
    docs = documents(spark, sf)
    before = docs.filter("doc_id % 7 <> 0")
    after = docs.filter("doc_id % 5 <> 0").withColumn(
        "body", F.when(F.col("doc_id") % 11 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    old_records = scale.checkpointed(corpus.build_records(before))
    old_chunks = corpus.build_chunks(old_records, before)
    current, prior = snapshots(spark, sf)
    _, records, chunks = corpus.incremental(after, "body", current, prior, old_records, old_chunks)
    records = scale.checkpointed(records)
    n = chunks.groupBy("course_id", "source_id").agg(F.count("*").alias("chunks"))
    return records.join(n, ["course_id", "source_id"], "left").select(
        "course_id", "source_path", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))


# --- validation ------------------------------------------------------------------------------

VALIDATED_SQL = RECORDS_SQL.replace("records as (", "clean_records as (")


@query("validate_corpus", f"""with {VALIDATED_SQL},
 records as (select * replace (case when status = 'ready' and doc_id % 40 = 14 then 'error' else status end as status) from clean_records), {GAPS_SQL},
 n as (select course_id, source_id, doc_id, grp, unnest(range(case when length(clean) <= 4800 then 1
    else cast(ceil((length(clean) - 4800) / 4300.0) as bigint) + 1 end)) as k from clean_records where status = 'ready'),
 ch as (select course_id, source_id, doc_id, grp, concat(source_id, '_c', lpad(cast(k + 1 as varchar), 4, '0')) as chunk_id from n),
 v as (select * from records where source_type in ('lecture_pdf', 'slide', 'word_document', 'spreadsheet')),
 g as (select distinct course_id, grp from records where status = 'ready' and starts_with(grp, 'chapter_')),
 e as (select concat('src', cast(item_id % 20 as varchar)) as course_id, item_id from benchmark)
select course_id, 'error' as severity, 'chunk_without_source' as rule, chunk_id as subject from ch where doc_id % 40 = 1
union all select distinct course_id, 'error', 'chunk_missing_source', concat('gone_', source_id) from ch where doc_id % 40 = 2
union all select course_id, 'error', 'chunk_without_locator', chunk_id from ch where doc_id % 40 = 3
union all select course_id, 'error', 'chunk_path_missing', concat('chunks/', case when starts_with(grp, 'chapter_') then 'chapters/' else '' end, grp, '/', chunk_id, '.md')
  from ch where doc_id % 40 = 4
union all select course_id, 'error', 'ready_without_output', path from records where status = 'ready' and doc_id % 40 = 10
union all select course_id, 'error', 'copy_not_retained', path from v where status = 'ready' and doc_id % 40 = 9
union all select course_id, 'error', 'absolute_path', source_id from records where doc_id % 40 = 13
union all select course_id, 'error', 'coverage_omits_source', path from records where status = 'error' and doc_id % 80 = 14
union all select course_id, 'warning', 'source_errors', cast(count(*) as varchar) from records where status = 'error' group by 1
union all select course_id, 'error', 'unsafe_inventory_path', concat('../', path) from records where status = 'skipped_unsupported' and doc_id % 40 = 7
union all select course_id, 'error', 'unsafe_inventory_path', concat('/mnt/', path) from records where status = 'skipped_unsupported' and doc_id % 40 = 15
union all select course_id, 'error', 'chapter_rollup_missing', grp from g where grp = 'chapter_03'
union all select course_id, 'error', 'chapter_rollup_empty', grp from g where grp = 'chapter_05'
union all select distinct course_id, 'error', 'metric_differs', 'chunk_count' from records where course_id in ('src1', 'src2')
union all select distinct course_id, 'error', 'metric_differs', 'viable' from records where course_id = 'src2'
union all select course_id, 'error', 'exam_source_missing', concat('exams/', cast(item_id as varchar), '.pdf') from e where item_id % 10 = 3
union all select course_id, 'error', 'cache_path_leaked', cast(item_id as varchar) from e where item_id % 10 = 4
union all select course_id, 'error', 'absolute_path', cast(item_id as varchar) from e where item_id % 10 = 5
union all select concat('only_', source_id), 'error', 'not_viable', '' from clean_records where status = 'ready' and doc_id % 40 = 20
union all select course_id, 'warning', 'unsupported_sources', cast(count(*) as varchar) from records where status = 'skipped_unsupported' group by 1
union all select course_id, 'warning', 'visual_without_chapter', case when doc_id % 40 = 13 then concat('/home/me/', path) else path end from v where len(chapters) = 0
union all select course_id, 'warning', 'chapter_gap', cast(chapter as varchar) from gaps""")
def validate_corpus(spark, sf):
    """Whole corpus with a planted fault for each of the 19 rules."""
    files = documents(spark, sf)
    clean = scale.checkpointed(corpus.build_records(files))
    number_in = lambda c: F.regexp_extract(c, r"_doc(\d+)", 1).cast("long")
    number = number_in("source_path") % 40
    chunks = scale.checkpointed(corpus.build_chunks(clean, files, texts=False))
    exams = table(spark, sf, "benchmark", "item_id", "concat('src', cast(item_id % 20 as string)) as course_id", "cast(item_id as string) as stable_id",
                  "concat(case when item_id % 10 = 5 then '/home/me/' else '' end, 'exams/', cast(item_id as string), '.pdf') as retained_source_path",
                  "case when item_id % 10 = 4 then 'C:/cache/x' end as cache_path")
    stored = (chunks.filter(number_in("source_path") % 40 != 4).select("course_id", F.col("chunk_path").alias("path"))
              .unionByName(clean.filter(number != 10).select("course_id", F.col("output_path").alias("path")))
              .unionByName(clean.filter(number != 9).select("course_id", F.col("source_copy_path").alias("path")))
              .unionByName(exams.filter("item_id % 10 <> 3").select("course_id", F.col("retained_source_path").alias("path"))).dropna())
    chunks = (chunks.withColumn("source_id", F.when(number == 1, "").when(number == 2, F.concat(F.lit("gone_"), "source_id"))
                                .otherwise(F.col("source_id")))
                    .withColumn("locator", F.when(number == 3, "").otherwise(F.col("locator")))).drop("source_path")
    # courses of one source without any text
    lone = clean.filter((F.col("status") == "ready") & (number == 20)).withColumn("course_id", F.concat(F.lit("only_"), "source_id")).withColumn("status", F.lit("empty"))
    records = (clean.withColumn("status", F.when((F.col("status") == "ready") & (number == 14), "error").otherwise(F.col("status")))
                    .withColumn("source_path", F.when(number == 13, F.concat(F.lit("/home/me/"), "source_path")).otherwise(F.col("source_path")))
                    .unionByName(lone))
    records = scale.checkpointed(records)
    ready, errors = records.filter("status = 'ready'"), records.filter("status = 'error'")
    unsupported = records.filter("status = 'skipped_unsupported'").select("course_id", F.when(number == 7, F.concat(F.lit("../"), "source_path")).when(
        number == 15, F.concat(F.lit("/mnt/"), "source_path")).otherwise(F.col("source_path")).alias("path"))
    coverage = errors.filter(number_in("source_path") % 80 != 14).select("course_id", F.col("source_path").alias("subject"))
    rollups = (ready.select("course_id", reports.study_group().alias("group")).distinct().filter("group <> 'chapter_03'")
                    .withColumn("text", F.when(F.col("group") == "chapter_05", " \n").otherwise(reports.group_label("group"))))
    measured = reports.source_metrics(records, chunks)
    metrics = measured.withColumn("chunk_count", F.when(F.col("course_id").isin("src1", "src2"), F.col("chunk_count") + 1).otherwise(F.col("chunk_count"))).withColumn(
        "viable", F.col("viable") != (F.col("course_id") == "src2"))
    return validate.validate_corpus(records, chunks, stored, unsupported=unsupported, coverage=coverage, rollups=rollups, metrics=metrics, exams=exams)


# --- small row operators ------------------------------------------------------------------------

@query("first_wins", """with r as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events)
select user_id, event_type, event_id, value from r where rn = 1""")
def first_wins(spark, sf):
    events = table(spark, sf, "events", "user_id", "event_type", "event_id", "ts", "value")
    return dedup.first_wins(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("last_wins", """with r as (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as rn from events)
select user_id, event_type, event_id, value from r where rn = 1""")
def last_wins(spark, sf):
    events = table(spark, sf, "events", "user_id", "event_type", "event_id", "ts", "value")
    return dedup.first_wins(events, ["user_id", "event_type"], ["ts", "event_id"], last=True).drop("ts")


SIBLING = "concat('act', cast(floor(doc_id / 2) as int), '/', case when doc_id % 2 = 0 then 'content.txt' when doc_id % 6 = 5 then 'page.html' else 'content.html' end)"


@query("drop_superseded", f"""with f as (select doc_id, source as course_id, {SIBLING} as path from documents)
select a.course_id, a.path, case when a.path like '%/content.html' and b.path is not null then 'skipped_html_duplicate' end as status
from f a left join f b on a.course_id = b.course_id and b.path = replace(a.path, 'content.html', 'content.txt') and a.path <> b.path""")
def drop_superseded(spark, sf):
    return dedup.drop_superseded(table(spark, sf, "documents", "source as course_id", f"{SIBLING} as path"))


STUB = """case doc_id % 4 when 0 then concat('a', cast(doc_id as string), ' Video/content.txt') when 1 then concat('b', cast(doc_id as string), '/content.txt')
 when 2 then concat('b', cast(doc_id - 1 as string), '/assets/clip.mp4') else concat('Videos', cast(doc_id as string), '/content.txt') end"""


@query("drop_media_stubs", f"""with f as (select doc_id, lang as course_id, {STUB} as path, {WORDS_SQL.format(c='text')} as words from documents)
select a.course_id, a.path, a.words, case when a.words < 80 and (a.doc_id % 4 = 0 or (a.doc_id % 4 = 1 and b.doc_id is not null)) then 'skipped_media_stub' end as status
from f a left join f b on b.doc_id = a.doc_id + 1 and b.course_id = a.course_id and b.doc_id % 4 = 2 where a.doc_id % 4 <> 2""")
def drop_media_stubs(spark, sf):
    files = table(spark, sf, "documents", "lang as course_id", f"{STUB} as path", "text as body")
    texts = files.filter(F.col("path").endswith(".txt"))
    return dedup.drop_media_stubs(texts, files.select("course_id", "path"))


@query("redact", """select doc_id, regexp_replace(regexp_replace(text, '(?i)\\b(cookie|set-cookie|authorization)["'']?\\s*[:=]\\s*[^\\r\\n]+', '\\1: [REDACTED]', 'g'),
 '(?i)\\b(moodlesession[a-z0-9_]*|sessionid|sesskey|access_token|token|password|passwd)["'']?\\s*[:=]\\s*["'']?[^\\s;&,"'']+', '\\1=[REDACTED]', 'g') as text,
 len(regexp_extract_all(text, '(?i)\\b(moodlesession[a-z0-9_]*|sessionid|sesskey|access_token|token|password|passwd)["'']?\\s*[:=]\\s*["'']?[^\\s;&,"'']+')) as hits from documents""")
def redact_query(spark, sf):
    out = redact(table(spark, sf, "documents", "doc_id", "text"), ["text"], "log")
    return out.select("doc_id", "text", F.aggregate("text_hits", F.lit(0), lambda a, x: a + x).alias("hits"))


PLANTED = "concat(text, ' Token: abc,x https://me:pw@h.example/a/b?sesskey=1#z cookie=k C:\\\\Users\\\\me /home/me/f.txt Authorization: Bearer q')"


def redact_sql(profile: str) -> str:
    out = PLANTED.replace("\\\\", "\\")
    if profile == "path":
        out = f"replace({out}, '\\', '/')"
        out = f"split_part(split_part({out}, '?', 1), '#', 1)"
    for pattern, replacement in PROFILES[profile]:
        pattern, replacement = pattern.replace("'", "''"), re.sub(r"\$(\d)", r"\\\1", replacement)
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


@query("redact_profiles", f"select doc_id, {', '.join(f'{redact_sql(p)} as {p}_text' for p in ('crawl', 'pipeline', 'path'))} from documents")
def redact_profiles(spark, sf):
    """The other profiles; nothing is shortened."""
    docs = table(spark, sf, "documents", "doc_id", f"{PLANTED} as text")
    return docs.select("doc_id", *[redact_text("text", p).alias(f"{p}_text") for p in ("crawl", "pipeline", "path")])
