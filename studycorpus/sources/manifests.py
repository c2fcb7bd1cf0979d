"""Manifest files, rendered texts and versioned publication."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as S

from ..functions import text as T, urls as U
from ..operators import reports
from ..plans import scale


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, block (start of the file split),
    and seq (rises by one inside a block). Large files are read in many splits."""
    return (spark.read.option("recursiveFileLookup", "true").text(path)
                 .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("seq"), F.col("value").alias("line")))


def line_numbers(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Add ``line_no`` to the wanted lines.

    The lines of a block are counted, the blocks of a file are few, and inside a
    block ``seq`` already runs; so only the wanted lines are joined.
    """
    blocks = lines.groupBy("file", "block").agg(F.count("*").alias("_n"), F.min("seq").alias("_first"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (wanted.join(starts, ["file", "block"])
                  .withColumn("line_no", F.col("_before") + F.col("seq") - F.col("_first") + 1)
                  .drop("_first", "_before"))


def parse_lines(lines: DataFrame, schema: str, policy: str = "report") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of JSON lines.

    ``lines`` come from ``read_lines`` or carry their own ``line_no``. ``report``
    keeps the good rows and gives one error per bad line; ``reject_file`` gives
    nothing of a file with a bad line.
    """
    if policy not in ("report", "reject_file"):
        raise ValueError(f"unknown policy {policy}")
    # inside brackets a line with anything behind its value is malformed too
    whole = F.try_parse_json(F.concat(F.lit("["), F.col("line"), F.lit("]")))
    rows = (lines.filter(T.strip("line") != "").withColumn("_json", whole)
                 .withColumn("_bad", F.col("_json").isNull() | F.try_variant_get("_json", "$[1]", "variant").isNotNull())
                 .drop("_json"))
    bad = rows.filter("_bad")
    if "line_no" not in lines.columns:
        bad = line_numbers(lines, bad)
    errors = bad.select("file", "line_no", F.concat(F.lit("Malformed JSON line "), "line_no").alias("error"))
    # only objects are records; another JSON value is dropped without an error
    good = rows.filter(~F.col("_bad") & F.col("line").rlike(r"\A\s*\{")).withColumn("_r", F.from_json("line", schema))
    if policy == "reject_file":
        bad_files = rows.filter("_bad").select("file").distinct().withColumn("_reject", F.lit(True))
        good = scale.lookup_join(good, bad_files, ["file"]).filter(F.col("_reject").isNull())
    keep = ["file", "line_no"] if "line_no" in lines.columns else ["file"]
    return good.select(*keep, "_r.*"), errors


def read_manifest(spark: SparkSession, path: str, schema: str, policy: str = "report") -> tuple[DataFrame, DataFrame]:
    return parse_lines(read_lines(spark, path), schema, policy)


COURSE_SCHEMA = ("id string, url string, output string, name string, code string, last_sync string, last_status string, "
                 "last_downloaded string, last_skipped string, last_errors string, study_pack_path string, "
                 "study_pack_status string, catalog_enabled boolean")


def clean_courses(rows: DataFrame, hosts, order: list) -> DataFrame:
    """Valid saved courses: id, folder and course URL present, first URL wins."""
    def txt(c):
        return F.trim(F.coalesce(F.col(c), F.lit("")))

    def count(c):
        return F.greatest(F.lit(0), F.coalesce(F.col(c).try_cast("int"), F.lit(0)))

    valid = (rows.filter((txt("id") != "") & (txt("output") != "") & U.is_course(txt("url"), hosts))
                 .withColumn("url", U.canonical_course(txt("url"))))
    first = scale.first_rows(valid, ["url"], order)
    return first.select(
        txt("id").alias("id"), "url", txt("output").alias("output"), txt("name").alias("name"),
        F.coalesce(F.nullif(F.upper(txt("code")), F.lit("")), T.course_code("name"), F.lit("")).alias("code"),
        F.lit(False).alias("selected"), F.nullif(txt("last_sync"), F.lit("")).alias("last_sync"),
        F.coalesce(F.nullif(txt("last_status"), F.lit("")), F.lit("never")).alias("last_status"),
        count("last_downloaded").alias("last_downloaded"), count("last_skipped").alias("last_skipped"),
        count("last_errors").alias("last_errors"), txt("study_pack_path").alias("study_pack_path"),
        F.coalesce(F.nullif(txt("study_pack_status"), F.lit("")), F.lit("missing")).alias("study_pack_status"),
        F.coalesce("catalog_enabled", F.lit(False)).alias("catalog_enabled"))


def read_courses(spark: SparkSession, path: str, hosts) -> DataFrame:
    """Saved-course scan: JSON lines, one course each; unreadable lines are dropped."""
    schema = S._parse_datatype_string(COURSE_SCHEMA + ", _corrupt string")
    rows = (spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
                 .json(path).withColumn("_file", F.input_file_name())
                 .withColumn("_at", F.monotonically_increasing_id()))
    return clean_courses(rows.filter(F.col("_corrupt").isNull()), hosts, ["_file", "_at"])


# --- sinks -------------------------------------------------------------------

def write_manifests(records: DataFrame, chunks: DataFrame, stats: DataFrame, path: str) -> None:
    """documents and corpus as JSON lines, documents as CSV, stats as JSON, per course."""
    records.write.mode("overwrite").partitionBy("course_id").json(f"{path}/documents")
    chunks.write.mode("overwrite").partitionBy("course_id").json(f"{path}/corpus")
    flat = records.select(*[F.to_json(c).alias(c) if isinstance(records.schema[c].dataType, (S.ArrayType, S.MapType, S.StructType))
                            else F.col(c) for c in records.columns])
    flat.write.mode("overwrite").partitionBy("course_id").option("header", "true").option("escape", '"').csv(f"{path}/documents_csv")
    stats.write.mode("overwrite").partitionBy("course_id").json(f"{path}/stats")


def _front(cols: list[str]) -> list:
    """Front-matter lines in their fixed order."""
    lines = [F.lit("---")]
    for c in cols:
        value = {"priority": F.col("priority").cast("string"),
                 "chapter": F.coalesce(F.col("chapter").cast("string"), F.lit("null")),
                 "chapters": F.concat(F.lit("["), F.array_join(F.transform("chapters", lambda n: n.cast("string")), ", "),
                                      F.lit("]")) if "chapters" in cols else None}.get(c)
        lines.append(F.concat(F.lit(f"{c}: "), value if value is not None else T.quoted(c)))
    return lines + [F.lit("---"), F.lit("")]


DOC_FRONT = ["source_id", "title", "source_path", "source_type", "priority", "group", "chapter", "chapters"]
CHUNK_FRONT = ["chunk_id", *DOC_FRONT, "locator"]


def group_dir(group) -> "F.Column":
    g = T.col(group)
    return F.when(g.startswith("chapter_"), F.concat(F.lit("chapters/"), g)).otherwise(g)


def render_docs(records: DataFrame, bodies: DataFrame) -> DataFrame:
    """One text value per ready document: front matter, title, body; path from the group."""
    ready = records.filter(F.col("status") == "ready").join(bodies.select("course_id", "source_id", "body"),
                                                            ["course_id", "source_id"])
    text = F.concat_ws("\n", *_front(DOC_FRONT), F.concat(F.lit("# "), "title"), F.lit(""), T.clean_block("body"))
    folder = F.when(F.col("group").isin("00_course", "references") | F.col("group").startswith("chapter_"),
                    group_dir("group")).otherwise("other")
    return ready.select("course_id", "source_id", "group", F.concat(
        F.lit("documents/"), folder, F.lit("/"), T.slug("title"), F.lit("__"), "source_id", F.lit(".md")).alias("output_path"),
        F.concat(T.strip(text), F.lit("\n")).alias("text"))


def render_chunks(chunks: DataFrame) -> DataFrame:
    """One text value per chunk with front matter and location."""
    text = F.concat_ws("\n", *_front(CHUNK_FRONT), F.concat(F.lit("# "), "title"), F.lit(""),
                       F.concat(F.lit("**Location:** "), "locator"), F.lit(""), F.col("text"))
    return chunks.select("course_id", "source_id", "chunk_id", "group", F.concat(
        F.lit("chunks/"), group_dir("group"), F.lit("/"), "chunk_id", F.lit(".md")).alias("chunk_path"),
        F.concat(T.strip(text), F.lit("\n")).alias("text"))


def stored_docs(records: DataFrame, bodies: DataFrame) -> DataFrame:
    """``render_docs`` written as a table that stays hashed by source, as the join of records and
    bodies left it; what is joined to it by source moves no text."""
    return scale.Bucketed(records.sparkSession, ["course_id", "source_id"]).add(render_docs(records, bodies)).close()


def write_rendered(rendered: DataFrame, path: str) -> None:
    """Rendered texts as a table by course and group, not one file per row."""
    rendered.write.mode("overwrite").partitionBy("course_id", "group").parquet(path)


def chapter_rollup(records: DataFrame, rendered: DataFrame) -> DataFrame:
    """Consolidated chapter texts as ordered parts (course_id, group, part_no, text).

    The parts of a group, read in order, are its text; a group of any size is
    never joined into one value. Part 0 is the heading of the group. With ``rendered``
    from ``stored_docs`` no text is shuffled.
    """
    placed = reports.roadmap_sources(records)
    facts = records.select("course_id", "source_id", F.col("source_path"), F.col("output_path"))
    rows = (placed.join(facts, ["course_id", "source_id"])
                  .join(rendered.select("course_id", "source_id", F.col("text").alias("_doc_text")), ["course_id", "source_id"], "left"))
    body = F.coalesce(T.strip("_doc_text"), F.lit("_Normalized source document is unavailable._"))
    part = F.concat_ws("\n", F.concat(F.lit("## "), "title"), F.lit(""),
                       F.concat(F.lit("Source ID: `"), "source_id", F.lit("`")),
                       F.concat(F.lit("Original material: `"), "source_path", F.lit("`")), F.lit(""), body, F.lit(""),
                       F.lit("---"), F.lit(""))
    parts = rows.select("course_id", "group", F.col("position").alias("part_no"), "source_id", part.alias("text"))
    heads = placed.select("course_id", "group").distinct().select(
        "course_id", "group", F.lit(0).cast("long").alias("part_no"), F.lit(None).cast("string").alias("source_id"),
        F.concat_ws("\n", F.concat(F.lit("# "), reports.group_label("group")), F.lit(""),
                    F.lit("Teaching evidence from this course's supplied sources."), F.lit("")).alias("text"))
    return heads.unionByName(parts)


def write_rollup(parts: DataFrame, path: str) -> None:
    """Parts in reading order: range partitioned, sorted inside each file."""
    (parts.repartitionByRange("course_id", "group", "part_no").sortWithinPartitions("course_id", "group", "part_no")
          .write.mode("overwrite").parquet(path))


def publish_if_valid(tables: dict[str, DataFrame], path: str, check: Callable[[dict[str, DataFrame]], DataFrame],
                     now=None) -> DataFrame:
    """Write a new version aside, check what was written, then move the pointer of
    each course without an error. Courses with an error keep their old version.

    ``check`` gets the written tables and returns findings (course_id, severity, ...).
    Every table has a ``course_id``. Returns the courses with ``published``.
    """
    spark = next(iter(tables.values())).sparkSession
    number = _last_number(spark, path) + 1
    version = f"v{number:010d}-{uuid.uuid4().hex}"
    written = {}
    for name, df in tables.items():
        df.write.mode("error").parquet(f"{path}/versions/{name}/version={version}")
        written[name] = spark.read.parquet(f"{path}/versions/{name}/version={version}")
    courses = None
    for df in written.values():
        ids = df.select("course_id").distinct()
        courses = ids if courses is None else courses.unionByName(ids)
    bad = check(written).filter(F.col("severity") == "error").select("course_id").distinct().withColumn("_bad", F.lit(True))
    judged = courses.distinct().join(bad, "course_id", "left").select(
        "course_id", F.lit(version).alias("version"), F.lit(number).cast("long").alias("number"),
        F.coalesce(F.lit(now), F.current_timestamp()).alias("published_at"), F.col("_bad").isNull().alias("published"))
    judged.write.mode("error").parquet(f"{path}/judged/version={version}")
    out = spark.read.schema(judged.schema).parquet(f"{path}/judged/version={version}")
    # one append is the whole switch: readers take the highest number of a course
    out.filter("published").drop("published").write.mode("append").parquet(f"{path}/current")
    return out


def _last_number(spark: SparkSession, path: str) -> int:
    """Number of the newest publication, 0 before the first one."""
    try:
        return spark.read.parquet(f"{path}/judged").agg(F.max("number")).first()[0] or 0
    except AnalysisException:
        return 0


def current_versions(spark: SparkSession, path: str) -> DataFrame:
    """The version of each course with the highest number; two that were published side by
    side under one number are told apart by their name."""
    pointer = spark.read.parquet(f"{path}/current")
    return pointer.groupBy("course_id").agg(F.max_by("version", F.struct("number", "version")).alias("version"))


def read_current(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of a table as published: each course from its own current version.

    Versions are partitions, and only those that some course points to are read.
    """
    current = current_versions(spark, path)
    rows = spark.read.option("basePath", f"{path}/versions/{table}").parquet(f"{path}/versions/{table}")
    wanted = current.select("version").distinct()
    return (rows.join(wanted, "version", "left_semi").join(current, ["course_id", "version"], "left_semi").drop("version"))
