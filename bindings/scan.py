"""Scans, decoding, manifests and file ingestion."""
from __future__ import annotations

import os
import uuid
from functools import reduce
from urllib.parse import quote

from pyspark.sql import DataFrame, Window as W, functions as F

from studycorpus.functions import text as T
from studycorpus.plans import scale
from studycorpus.sources import files, manifests
from studycorpus.streaming import ingest

from .base import CLEAN_SQL, EXT, PATH, RECORDS_SQL, documents, query, table


LISTED_AT_ONCE = 250_000   # files that the driver lists at once, unless a course has more


@query("scan_files", """select concat('course=', source) as course_id, doc_id, '.txt' as ext, octet_length(encode(text)) + 1 as size, sha256(concat(text, chr(10))) as sha256 from documents""")
def scan_files(spark, sf):
    """The documents as one file each, in folders of courses, scanned with their bytes."""
    root = f"{scale.shared_folder(spark)}/files-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents", "source as course", "doc_id as doc", "text")
    plain = files.plain_folder(spark, root)
    if plain is None:
        return scan_written(spark, docs, root)
    planted = scale.checkpointed(docs.select(F.col("course").cast("string"), F.col("doc").cast("string"), F.col("text").cast("binary"))
                                     .mapInArrow(planter(plain), "folder string, files long"))
    doc = F.expr("try_cast(regexp_extract(path, '-(-?[0-9]+)[.]txt$', 1) as long)")
    tables, some = [], []
    with scale.setting(spark, "spark.sql.files.openCostInBytes", "64k"):
        # by default a task opens at most 32 files
        counts = planted.groupBy("folder").agg(F.sum("files")).orderBy("folder").collect()
        for i, (folder, n) in enumerate(counts):
            some.append((folder, n))
            if i + 1 < len(counts) and sum(n for _, n in some) + counts[i + 1][1] <= LISTED_AT_ONCE:
                continue
            out = files.scan_files(spark, root, course_depth=1, content=True, folders=[f for f, _ in some])
            tables.append(scale.checkpointed(out.select(F.try_url_decode("course_id").alias("course_id"), doc.alias("doc_id"), "ext", "size", F.sha2("content", 256).alias("sha256"))))
            some = []
    return reduce(DataFrame.unionAll, tables) if tables else scan_written(spark, docs, root)


def planter(root: str):
    """Writes a file for each row, ``course=<course>/<task>-<row>-<document>.txt``. Through Hadoop's local file
    system each file would take several processes, to set its mode, and a second file of checksums."""
    def plant(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, folders, n = TaskContext.get(), {}, 0
        for batch in batches:
            for course, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                # quoted twice, as the scan undoes one
                folder = f"course={quote(quote(course or '', safe=''), safe='')}"
                if folder not in folders:
                    os.makedirs(f"{root}/{folder}", exist_ok=True)
                folders[folder] = folders.get(folder, 0) + 1
                name = f"{task.partitionId()}-{n}-{doc}.txt"
                hidden = f"{root}/{folder}/.{task.taskAttemptId()}-{name}"
                with open(hidden, "wb") as out:
                    out.write((text or b"") + b"\n")
                os.replace(hidden, f"{root}/{folder}/{name}")
                n += 1
        yield pa.RecordBatch.from_pydict({"folder": pa.array(list(folders), pa.string()), "files": pa.array(list(folders.values()), pa.int64())})

    return plant


def scan_written(spark, docs, root):
    """The same where the shared folder is in a store that only Spark writes."""
    # a folder for each document would cost more than its file: a task writes its rows to files that it
    # numbers course by course, so its number and theirs name the document
    tasks = scale.shuffle_width(spark)
    docs = docs.withColumn("part", F.expr(f"cast(pmod(xxhash64(doc), {tasks}) as int)"))
    (docs.repartitionById(tasks, F.col("part")).sortWithinPartitions("course", "doc").select("course", "text")
         .write.option("maxRecordsPerFile", 1).partitionBy("course").text(root))
    out = files.scan_files(spark, root, course_depth=1, content=True)
    name = lambda n: F.regexp_extract("path", r"part-(\d+)-.*c(\d+)\.txt$", n).cast("int")
    scanned = out.select("course_id", name(1).alias("part"), name(2).alias("no"), "ext", "size", F.sha2("content", 256).alias("sha256"))
    numbers = docs.select(F.concat(F.lit("course="), "course").alias("course_id"), "part", F.col("doc").alias("doc_id"),
                          (F.row_number().over(W.partitionBy("course", "part").orderBy("doc")) - 1).alias("no"))
    return scanned.join(numbers, ["course_id", "part", "no"]).select("course_id", "doc_id", "ext", "size", "sha256")


RAW = "concat('Số ', cast(doc_id as string), chr(10), '  ', text, '  ')"
LATIN = "concat('No ', cast(doc_id as string), ' é ', source)"


@query("decode_text", f"""select doc_id, case when doc_id % 3 = 0 then {CLEAN_SQL.format(c="concat('Số ', doc_id, chr(10), '  ', text, '  ')")}
  else concat('No ', doc_id, ' é ', source) end as text from documents""")
def decode_text(spark, sf):
    """UTF-8 for one third; CP1252 and Latin-1 bytes for the rest (é is E9 in both)."""
    raw = table(spark, sf, "documents", "doc_id", f"case when doc_id % 3 = 0 then encode({RAW}, 'UTF-8') else encode({LATIN}, 'ISO-8859-1') end as content")
    return files.decode_text(raw)


@query("row_units", """select s_suppkey + 1 as unit_no, concat('row ', s_suppkey + 1) as locator, concat_ws(' | ', concat('column 1: ', s_suppkey),
  case when s_suppkey % 3 <> 0 then concat('column 2: ', s_name) end, concat('column 3: ', s_nationkey)) as text from supplier""")
def row_units(spark, sf):
    rows = table(spark, sf, "supplier", "s_suppkey + 1 as row_no", "s_suppkey", "case when s_suppkey % 3 = 0 then '  ' else s_name end as s_name", "s_nationkey")
    return files.row_units(rows, ["s_suppkey", "s_name", "s_nationkey"], "row_no")


@query("csv_units", """select concat('n', s_nationkey, '_', s_suppkey // 500) as source_id, row_number() over (partition by s_nationkey, s_suppkey // 500 order by s_suppkey) as unit_no,
  concat('column 1: ', s_suppkey, ' | column 2: ', s_name, '; "x"', case when s_suppkey % 4 = 0 then concat(chr(10), 'two') else '' end,
  ' | column 4: ', s_nationkey) as text from supplier""")
def csv_units(spark, sf):
    """One file per nation and 500 suppliers: semicolons, quoted cells of one or two lines, one empty column."""
    lines = table(spark, sf, "supplier").groupBy("s_nationkey", F.floor(F.col("s_suppkey") / 500).alias("part")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", F.concat(
        F.col("s_suppkey").cast("string"), F.lit(';"'), "s_name", F.lit('; ""x""'), F.when(F.col("s_suppkey") % 4 == 0, "\ntwo").otherwise(""), F.lit('"; ;'), F.col("s_nationkey").cast("string")).alias("l")))).alias("t"))
    texts = lines.select(F.lit("c").alias("course_id"), F.concat(F.lit("n"), "s_nationkey", F.lit("_"), "part").alias("source_id"),
                         F.array_join(F.transform("t", lambda x: x["l"]), "\n").alias("text"))
    return files.csv_units(texts).select("source_id", "unit_no", "text")


LINE = "case when event_id % 17 = 0 and user_id % 4 = 0 then concat(props, '}') else props end"


@query("read_manifest", """with l as (select user_id, event_id, event_id % 17 = 0 and user_id % 4 = 0 as bad, cast(json_extract(props, '$.k') as bigint) as k from events)
select user_id as file, count(*) filter (not bad) as kept_rows, cast(coalesce(sum(k) filter (not bad), 0) as bigint) as kept_sum, count(*) filter (bad) as errors, case when bool_or(bad) then 0 else count(*) end as accepted_rows from l group by 1""")
def read_manifest(spark, sf):
    """One manifest per user; both policies side by side."""
    lines = table(spark, sf, "events", "user_id as file", "event_id as line_no", f"{LINE} as line")
    kept, errors = manifests.parse_lines(lines, "k long", "report")
    whole, _ = manifests.parse_lines(lines, "k long", "reject_file")
    a = kept.groupBy("file").agg(F.count("*").alias("kept_rows"), F.sum("k").alias("kept_sum"))
    b = errors.groupBy("file").agg(F.count("*").alias("errors"))
    c = whole.groupBy("file").agg(F.count("*").alias("accepted_rows"))
    return a.join(b, "file", "full_outer").join(c, "file", "full_outer").na.fill(0)


@query("manifest_files", """select user_id, count(*) as rows_read, cast(sum(cast(json_extract(props, '$.k') as bigint)) as bigint) as k from events group by 1""")
def manifest_files(spark, sf):
    """Written as JSON lines, scanned as text files, parsed, counted."""
    path = f"{scale.shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, sf, "events", "user_id", "from_json(props, 'k long').k as k").write.json(path)
    rows, _ = manifests.read_manifest(spark, path, "user_id long, k long", "reject_file")
    return rows.groupBy("user_id").agg(F.count("*").alias("rows_read"), F.sum("k").alias("k"))


@query("subtitle_cues", """select conv_id, turn // 60 as part, turn % 60 + 1 as unit_no, concat(lpad(cast(turn // 60 as varchar), 2, '0'), ':', lpad(cast(turn % 60 as varchar), 2, '0'), ':00.000') as locator,
  trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from conversations""")
def subtitle_cues(spark, sf):
    """Sixty turns of a conversation as the cues of one subtitle file."""
    stamp = "concat(lpad(cast(floor(turn / 60) as string), 2, '0'), ':', lpad(cast(turn % 60 as string), 2, '0'), ':00.000')"
    cue = f"concat(cast(turn as string), '\\n', {stamp}, ' --> ', {stamp}, '\\n', text)"
    turns = table(spark, sf, "conversations", "conv_id", "turn", f"{cue} as cue")
    parts = turns.groupBy("conv_id", F.floor(F.col("turn") / 60).alias("part"))
    texts = parts.agg(F.array_sort(F.collect_list(F.struct("turn", "cue"))).alias("t")).select(
        "conv_id", "part", F.concat(F.lit("WEBVTT - talk\n\n"), F.array_join(F.transform("t", lambda x: x["cue"]), "\n\n")).alias("text"))
    return files.subtitle_cues(texts)


@query("shortcut_links", """select concat('Link ', page_id) as title, concat('links/Link_', page_id, '.url') as source_path, case when page_id % 9 <> 0 then url end as url from pages""")
def shortcut_links(spark, sf):
    texts = table(spark, sf, "pages", "'c' as course_id", "concat('links/Link_', cast(page_id as string), '.url') as path", "'other' as group",
                  "case when page_id % 9 = 0 then '[InternetShortcut]\\nIcon=1' else concat('[InternetShortcut]\\nurl=', url, ' \\nIcon=1') end as text")
    return files.shortcut_links(texts).select("title", "source_path", "url")


# --- ingestion: two drops of files -----------------------------------------------------------

@query("ingest", f"""with files as (select doc_id, source as course_id, {PATH.replace(EXT, "'.txt'")} as path, n_chars as size,
   case when doc_id % 5 <> 0 and doc_id % 11 = 0 then concat(text, '!') else text end as body from documents where doc_id % 7 <> 0 or doc_id % 5 <> 0),
 {RECORDS_SQL[RECORDS_SQL.index('typed as'):]},
n as (select source_id, case when length(clean) <= 4800 then 1 else cast(ceil((length(clean) - 4800) / 4300.0) as bigint) + 1 end as k from records where status = 'ready')
select course_id, path as source_path, status, cast(coalesce(k, 0) as bigint) as chunks from records left join n using (source_id)""")
def ingest_query(spark, sf):
    """Two drops of text files run through the stream; the SQL side knows only the end."""
    base = f"{scale.shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    docs = documents(spark, sf).withColumn("path", F.expr(PATH.replace(EXT, "'.txt'")))
    new = F.when(F.col("doc_id") % 11 == 0, F.concat("body", F.lit("!"))).otherwise(F.col("body"))
    drops = [docs.filter("doc_id % 7 <> 0"), docs.filter("doc_id % 5 <> 0").withColumn("body", new)]
    for drop in drops:
        (drop.select("course_id", "path", "size", F.encode("body", "UTF-8").alias("content"))
             .write.mode("append").parquet(f"{base}/in"))
        stream = spark.readStream.schema("course_id string, path string, size long, content binary").parquet(f"{base}/in")
        ingest.start(stream, f"{base}/out", f"{base}/checkpoint", available_now=True).awaitTermination()
    records, chunks = ingest.current_corpus(spark, f"{base}/out")
    n = chunks.groupBy("course_id", "source_id").agg(F.count("*").alias("chunks"))
    return records.join(n, ["course_id", "source_id"], "left").select(
        "course_id", "source_path", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))
