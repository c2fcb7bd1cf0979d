"""All file types through one corpus plan: at once, by ingestion and by refresh."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from studycorpus.operators import refresh
from studycorpus.plans import corpus, extract, scale
from studycorpus.streaming import ingest

from .base import CLEAN_SQL, NORM_SQL, query, table

DOC_PATH = "concat('Notes/doc', cast(doc_id as string), case doc_id % 4 when 0 then '.txt' when 1 then '.pdf' when 2 then '.pptx' else '.bin' end)"
PAGE = ("concat('<html><nav>skip</nav><header>x</header><p>Page ', cast(page_id as string), '</p><script>y</script><form><b>f</b></form><div> at ', url, '</div></html>')")

# turns are minutes of a talk
CUE_TIME = "concat(lpad(cast(cast(floor(turn / 60) as int) as string), 2, '0'), ':', lpad(cast(turn % 60 as string), 2, '0'), ':00.000')"


def files(spark, sf, changed: bool = False) -> DataFrame:
    """Files with their bytes. ``changed``: every eleventh document has another text."""
    docs = table(spark, sf, "documents", "doc_id", "source as course_id", f"{DOC_PATH} as path", "n_chars as size", "text")
    if changed:
        docs = docs.withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    pages = table(spark, sf, "pages", "page_id", "'pages' as course_id", "cast(page_id as bigint) as size", f"{PAGE} as html")
    html = pages.select("course_id", F.concat(F.lit("p"), "page_id", F.lit("/content.html")).alias("path"), "size", F.col("html").alias("text"))
    plain = pages.filter("page_id % 3 = 0").select("course_id", F.concat(F.lit("p"), "page_id", F.lit("/content.txt")).alias("path"), "size",
                                                   F.concat(F.lit("Plain page "), "page_id").alias("text"))
    video = pages.filter("page_id % 3 = 1").select("course_id", F.concat(F.lit("Video "), "page_id", F.lit("/page.txt")).alias("path"), "size",
                                                   F.lit("watch it").alias("text"))
    rows = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", F.concat(
        F.col("s_suppkey").cast("string"), F.lit(',"'), "s_name", F.lit("\nline two\"")).alias("line"))
    csv = rows.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "line"))).alias("l")).select(
        F.lit("tables").alias("course_id"), F.concat(F.lit("n"), "s_nationkey", F.lit(".csv")).alias("path"), F.col("s_nationkey").cast("long").alias("size"),
        F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))
    cue = f"concat({CUE_TIME}, ' --> 99:59:59.000\n', text)"
    talk = table(spark, sf, "conversations", "conv_id", "turn", f"{cue} as cue").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "cue"))).alias("l")).select(
        F.lit("talks").alias("course_id"), F.concat(F.lit("c"), "conv_id", F.lit(".vtt")).alias("path"), F.col("conv_id").cast("long").alias("size"),
        F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("l", lambda x: x["cue"]), "\n\n")).alias("text"))
    web = table(spark, sf, "pages", "'shortcuts' as course_id", "concat('links/Link_', cast(page_id as string), '.url') as path", "cast(page_id as bigint) as size",
                "concat('[InternetShortcut]\nURL=', url, '\n') as text")
    broken = table(spark, sf, "pages", "'broken' as course_id", "concat('b', cast(page_id as string), case page_id % 3 when 0 then '.txt' when 1 then '.pdf' else '.bin' end) as path",
                   "cast(page_id as bigint) as size", "cast(null as string) as text", "case when page_id % 6 = 0 then concat('disk error ', cast(page_id as string)) "
                   "when page_id % 3 = 1 then 'encrypted' end as error")
    cols = ["course_id", "path", "size", "text"]
    out = docs.select(*cols)
    for other in (html, plain, video, csv, talk, web):
        out = out.unionByName(other.select(*cols))
    out = out.withColumn("error", F.lit(None).cast("string")).unionByName(broken)
    return out.select("course_id", "path", "size", F.encode("text", "UTF-8").alias("content"), "error")


def units(spark, sf, changed: bool = False) -> DataFrame:
    """Two units of each PDF, as another tool would have extracted them."""
    docs = table(spark, sf, "documents", "doc_id", "source as course_id", f"{DOC_PATH} as path", "text").filter("doc_id % 4 = 1")
    if changed:
        docs = docs.withColumn("text", F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    source = F.concat(F.lit("src_"), F.substring(F.sha1(F.concat("path", F.lit("|lecture_pdf"))), 1, 12)).alias("source_id")
    return docs.select("course_id", source, F.posexplode(F.array(F.col("text"), F.concat(F.lit("End of "), "doc_id"))).alias("n", "text")).select(
        "course_id", "source_id", (F.col("n") + 1).cast("long").alias("unit_no"), F.concat(F.lit("page "), F.col("n") + 1).alias("locator"), "text")


def shown(records: DataFrame, chunks: DataFrame) -> DataFrame:
    """Status and units per file, and the digest of its chunk texts in order."""
    texts = chunks.groupBy("course_id", "source_id").agg(F.count("*").alias("chunks"), F.sha2(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("ordinal", "locator", "text"))), lambda c: F.concat(c["locator"], F.lit("="), c["text"])), "|"), 256).alias("sha256"))
    return records.join(texts, ["course_id", "source_id"], "left").select(
        "course_id", "source_path", "status", F.col("units").cast("long").alias("units"), F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce("sha256", F.lit("")).alias("sha256"))


def mixed_sql(changed: bool = False, keep: str = "true") -> str:
    text = "case when doc_id % 11 = 0 then concat(text, '!') else text end" if changed else "text"
    return f"""with docs as (select doc_id, source as course_id, {DOC_PATH} as path, {text} as body from documents where {keep}),
bodies as (select course_id, path, 1 as rank, 'document' as locator, 1 as unit_no, body, false as unitary from docs where doc_id % 4 = 0
 union all select course_id, path, 5, 'page 1', 1, body, true from docs where doc_id % 4 = 1
 union all select course_id, path, 5, 'page 2', 2, concat('End of ', doc_id), true from docs where doc_id % 4 = 1
 union all select 'pages', concat('p', page_id, '/content.html'), 2, 'document', 1, concat('Page ', page_id, chr(10), 'at ', url), false from pages where page_id % 3 <> 0
 union all select 'pages', concat('p', page_id, '/content.txt'), 0, 'document', 1, concat('Plain page ', page_id), false from pages where page_id % 3 = 0
 union all select 'tables', concat('n', s_nationkey, '.csv'), 3, concat('row ', row_number() over w), row_number() over w,
   concat('column 1: ', s_suppkey, ' | column 2: ', s_name, chr(10), 'line two'), true from supplier window w as (partition by s_nationkey order by s_suppkey)
 union all select 'talks', concat('c', conv_id, '.vtt'), 6, {CUE_TIME}, turn + 1, trim(regexp_replace(text, '\\s+', ' ', 'g')), true
   from conversations),
clean as (select *, {CLEAN_SQL.format(c='body')} as t from bodies),
norm as (select *, {NORM_SQL.format(c='t')} as norm from clean),
firsts as (select *, first_value(path) over (partition by course_id, norm order by rank, lower(path), path) as fp from norm where not unitary),
state as (select course_id, path, case when t = '' then 'empty' when length(norm) >= 80 and fp <> path then 'duplicate' else 'ready' end as status from firsts
 union all select distinct course_id, path, 'ready' from norm where unitary),
pieces as (select course_id, path, unit_no, locator, unnest(range(case when length(t) <= 4800 then 1 else cast(ceil((length(t) - 4800) / 4300.0) as bigint) + 1 end)) as k, t from clean where t <> ''),
chunks as (select course_id, path, count(*) as chunks, sha256(string_agg(concat(locator, '=', trim(substring(t, k * 4300 + 1, 4800), concat(' ', chr(10)))), '|' order by unit_no, k)) as sha256 from pieces group by 1, 2),
counted as (select course_id, path, count(*) as units from clean where unitary and t <> '' group by 1, 2)
select course_id, path as source_path, status, cast(coalesce(u.units, 0) as bigint) as units, case when status = 'ready' then coalesce(c.chunks, 0) else 0 end as chunks,
  case when status = 'ready' then coalesce(c.sha256, '') else '' end as sha256 from state left join chunks c using (course_id, path) left join counted u using (course_id, path)
union all select course_id, path, case when doc_id % 4 = 2 then 'visual_only' else 'skipped_unsupported' end, 0, 0, '' from docs where doc_id % 4 >= 2
union all select 'pages', concat('p', page_id, '/content.html'), 'skipped_html_duplicate', 0, 0, '' from pages where page_id % 3 = 0
union all select 'pages', concat('Video ', page_id, '/page.txt'), 'skipped_media_stub', 0, 0, '' from pages where page_id % 3 = 1
union all select 'shortcuts', concat('links/Link_', page_id, '.url'), 'link_only', 0, 0, '' from pages
union all select 'broken', concat('b', page_id, case page_id % 3 when 0 then '.txt' when 1 then '.pdf' else '.bin' end),
  case when page_id % 3 = 2 then 'skipped_unsupported' else 'error' end, 0, 0, '' from pages"""


@query("extracted_links", """select 'shortcuts' as course_id, concat('Link ', page_id) as title, concat('links/Link_', page_id, '.url') as source_path, url from pages""")
def extracted_links(spark, sf):
    """Shortcut files of the mixed corpus, as its reports count them."""
    return extract.extract(files(spark, sf)).links.select("course_id", "title", "source_path", "url")


@query("extract_errors", """select concat('b', page_id, case page_id % 3 when 0 then '.txt' else '.pdf' end) as path,
  case when page_id % 6 = 0 then concat('disk error ', page_id) when page_id % 3 = 1 then 'encrypted' else 'The file could not be read' end as note
from pages where page_id % 3 <> 2""")
def extract_errors(spark, sf):
    """Unreadable files with their reasons."""
    return extract.extract(files(spark, sf)).statuses.filter("status = 'error'").select("path", "note")


@query("corpus_mixed", mixed_sql())
def corpus_mixed(spark, sf):
    """Every type planted from the tables, built at once."""
    return shown(*corpus.build(files(spark, sf), units(spark, sf)))


@query("ingest_mixed", mixed_sql(changed=True))
def ingest_mixed(spark, sf):
    """Two drops: the second holds every file again, with changes, and old versions of some."""
    base = f"{scale.shared_folder(spark)}/mixed-{uuid.uuid4().hex}"
    old, new = files(spark, sf), files(spark, sf, changed=True)
    stamp = lambda df, t: df.withColumn("mtime", F.timestamp_seconds(F.lit(t)))
    drops = [stamp(old, 10).filter("size % 7 <> 0"), stamp(new, 30).unionByName(stamp(old, 20).filter("size % 5 = 0"))]
    for number, drop in enumerate(drops):
        ingest.ingest_batch(drop, number, f"{base}/out", units(spark, sf, changed=number == 1))
    return shown(*ingest.current_corpus(spark, f"{base}/out"))


@query("refresh_mixed", mixed_sql(changed=True, keep="doc_id % 5 <> 0"))
def refresh_mixed(spark, sf):
    """Refresh of a corpus of all types; the SQL side builds the new one from nothing."""
    number = F.regexp_extract("path", r"Notes/doc(\d+)", 1)
    old = files(spark, sf).filter((number == "") | (number.try_cast("long") % 7 != 0))
    new = files(spark, sf, changed=True).filter((number == "") | (number.try_cast("long") % 5 != 0))
    old_records, old_chunks = corpus.build(old, units(spark, sf))
    parts = extract.extract(new, units(spark, sf, changed=True))
    _, records, chunks = corpus.incremental(parts.texts, "body", refresh.snapshot(new), refresh.snapshot(old), old_records, scale.checkpointed(old_chunks),
                                            parts.units, parts.statuses, parts.plain)
    return shown(records, chunks)
