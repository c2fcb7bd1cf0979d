"""Inventory, statistics and study reports, as tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V, text as T
from ..functions.text import col
from ..plans import scale
from .redact import redact_text

# --- inventory ---------------------------------------------------------------

def source_inventory(classified: DataFrame) -> DataFrame:
    """Counts per course. Metadata counts in the totals and extensions only.

    Extensions and unsupported paths are the rows of ``extension_counts`` and
    ``unsupported_paths``.
    """
    plain = ~F.col("is_metadata")
    return classified.groupBy("course_id").agg(
        F.count("*").alias("total_source_files"), F.sum("size").alias("total_input_bytes"),
        F.count_if("is_supported").alias("supported_files"),
        F.count_if(plain & ~F.col("is_supported")).alias("unsupported_files"),
        F.count_if("is_lecturer_material").alias("lecturer_material_candidates"),
        F.count_if("is_metadata").alias("metadata_files"))


def _shown_ext() -> Column:
    return F.when(F.col("ext") == "", V.NO_EXTENSION).otherwise(F.col("ext"))


def extension_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("course_id", _shown_ext().alias("ext")).agg(F.count("*").alias("files"))


def unsupported_paths(classified: DataFrame) -> DataFrame:
    """Unsupported files with their path made safe to show."""
    return (classified.filter(~F.col("is_metadata") & ~F.col("is_supported"))
                      .select("course_id", _shown_ext().alias("ext"), redact_text("path", "path").alias("path")))


# --- statistics --------------------------------------------------------------

def _value_maps(records: DataFrame, values: list[str]) -> DataFrame:
    """Per course a map from each value of a column to its number of rows, for several columns.

    Rows are counted per value first, so a map is made from one row per value.
    """
    sets = [["course_id", v] for v in values]
    counted = records.select("course_id", *values).groupingSets(sets, "course_id", *values).agg(
        F.count("*").alias("_n"), *[F.grouping(v).alias(f"_g_{v}") for v in values])
    entry = lambda v: F.when(F.col(f"_g_{v}") == 0, F.struct(F.coalesce(v, F.lit("")).alias("key"), F.col("_n").alias("value")))
    return counted.groupBy("course_id").agg(*[
        F.map_from_entries(F.array_sort(F.collect_list(entry(v)))).alias(f"_map_{v}") for v in values])


def corpus_stats(records: DataFrame, chunks: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Totals per course with counters by type and status, and the chapter groups.

    ``chunks`` are the chunks, or their numbers by source in a column ``chunks``.
    The maps hold every type and status that occurs. There are fewer than 5,000
    possible chapter groups.
    """
    base = records.groupBy("course_id").agg(
        F.count("*").alias("documents_total"), F.count_if(F.col("status") == "ready").alias("documents_ready"),
        F.sum(F.when(F.col("status") == "ready", F.col("words")).otherwise(0)).alias("words_ready"),
        F.count_if(F.col("status") == "reference_indexed_only").alias("references_indexed_only"),
        F.count_if(F.col("status") == "media_pending").alias("media_pending"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.array_sort(F.collect_set(F.when(F.col("group").startswith("chapter_"), F.col("group")))).alias("chapter_groups"))
    maps = _value_maps(records, ["source_type", "status"]).withColumnRenamed("course_id", "_c")
    base = base.join(maps, F.col("course_id").eqNullSafe(F.col("_c"))).drop("_c")
    number = F.sum("chunks") if "chunks" in chunks.columns else F.count("*")
    counted = chunks.groupBy("course_id").agg(number.alias("chunks"))
    out = base.join(counted, "course_id", "left")
    if links is not None:
        out = out.join(links.groupBy("course_id").agg(F.count("*").alias("links")), "course_id", "left")
    else:
        out = out.withColumn("links", F.lit(0))
    return out.select(
        "course_id", "documents_total", "documents_ready", F.coalesce("chunks", F.lit(0)).alias("chunks"), "words_ready",
        "references_indexed_only", "media_pending", F.coalesce("links", F.lit(0)).alias("links"), "errors",
        F.col("_map_source_type").alias("source_types"), F.col("_map_status").alias("statuses"),
        "chapter_groups")


def source_metrics(records: DataFrame, chunks: DataFrame, visuals: DataFrame | None = None) -> DataFrame:
    """How much usable lecturer material a course has.

    ``records``: course_id, source_id, source_type, source_role?, status,
    output_path, source_copy_path. ``visuals``: course_id, source_id. A path that
    is not null stands for a stored output.
    """
    role = F.coalesce(F.col("source_role"), F.lit("course_material")) if "source_role" in records.columns else F.lit(
        "course_material")
    lecturer = F.col("source_type").isin(*V.LECTURER_TYPES) & (role != "past_exam") & F.col("source_id").isNotNull()
    marked = records.select(
        "course_id", "source_id", F.col("status"),
        (lecturer & (F.col("status") == "ready") & F.col("output_path").isNotNull()).alias("_ready"),
        (lecturer & F.col("source_type").isin(*V.VISUAL_TYPES) & F.col("status").isin("ready", "visual_only")
         & F.col("source_copy_path").isNotNull()).alias("_copy"))
    useful_chunks = (chunks.filter((T.strip("text") != "") & F.col("chunk_path").isNotNull())
                           .groupBy("course_id", "source_id").agg(F.count("*").alias("_chunks")))
    rows = marked.join(useful_chunks, ["course_id", "source_id"], "left")
    if visuals is not None:
        seen = visuals.select("course_id", "source_id").distinct().withColumn("_visual", F.lit(True))
        rows = rows.join(seen, ["course_id", "source_id"], "left")
    else:
        rows = rows.withColumn("_visual", F.lit(False))
    chunked = F.col("_ready") & F.col("_chunks").isNotNull()
    kept = F.col("_copy") & F.coalesce("_visual", F.lit(False))
    per_source = rows.groupBy("course_id", "source_id").agg(
        F.bool_or("_ready").alias("ready"), F.bool_or(chunked).alias("chunked"), F.bool_or(kept).alias("kept"),
        F.max(F.when(chunked, F.col("_chunks"))).alias("n_chunks"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "skipped_unsupported").alias("unsupported"))
    useful = F.col("chunked") | F.col("kept")
    return per_source.groupBy("course_id").agg(
        F.count_if("ready").alias("ready_source_count"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunk_count"),
        F.count_if("kept").alias("retained_lecturer_source_count"),
        F.sum("errors").alias("source_error_count"), F.sum("unsupported").alias("unsupported_source_count"),
        F.count_if(useful).alias("meaningful_lecturer_source_count"), F.bool_or(useful).alias("viable"))


# --- order, chapters, roadmap ------------------------------------------------

def order_hint(path) -> Column:
    digits = F.regexp_extract(T.base_name(path), r"\A\s*0*(\d{1,3})(?:[_ .-]|\z)", 1)
    return F.when(digits == "", 9999).otherwise(digits.cast("int"))


def order_sources(records: DataFrame, path: str = "source_path") -> DataFrame:
    """Order hint and position per course in (hint, case-folded path) order."""
    hinted = records.withColumn("order", order_hint(path)).withColumn("_p", T.casefold(path))
    return scale.numbered(hinted, ["course_id"], [F.col("order"), F.col("_p"), F.col(path)], "position").drop("_p")


def real_chapters() -> Column:
    """Positive chapter numbers of a record: its list, else its group, else its chapter."""
    listed = F.array_sort(F.array_distinct(F.filter("chapters", lambda n: n > 0)))
    grouped = F.filter(F.transform(F.regexp_extract_all("group", F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int")),
                       lambda n: n > 0)
    single = F.when(F.col("chapter") > 0, F.array("chapter")).otherwise(F.array().cast("array<int>"))
    return F.when(F.size(listed) > 0, listed).when(F.size(grouped) > 0, grouped).otherwise(single)


def chapter_gaps(records: DataFrame) -> DataFrame:
    """Numbers missing between the lowest and the highest chapter of a course."""
    numbers = (records.filter(F.col("status") == "ready").select("course_id", F.explode(real_chapters()).alias("n"))
                      .groupBy("course_id").agg(F.collect_set("n").alias("have")))
    span = F.sequence(F.array_min("have"), F.array_max("have"))
    return numbers.select("course_id", F.explode(F.array_except(span, "have")).alias("chapter"))


def study_group() -> Column:
    numbers = real_chapters()
    return F.when(F.size(numbers) > 0, F.concat(F.lit("chapter_"), F.array_join(
        F.transform(numbers, lambda n: F.lpad(n.cast("string"), 2, "0")), "_"))).otherwise(F.col("group"))


def group_label(group) -> Column:
    g = col(group)
    numbers = F.transform(F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int").cast("string"))
    return (F.when(g == "00_course", "Course information")
             .when(~g.startswith("chapter_"), "Unclassified sources")
             .when(F.size(numbers) == 1, F.concat(F.lit("Chapter "), numbers[0]))
             .otherwise(F.concat(F.lit("Chapters "), F.array_join(numbers, "–"))))


def group_rank(group) -> Column:
    g = col(group)
    kind = F.when(g == "00_course", 0).when(g.startswith("chapter_"), 1).when(g == "references", 2).otherwise(3)
    numbers = F.when(kind == 1, F.transform(F.regexp_extract_all(g, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))
                     ).otherwise(F.array().cast("array<int>"))
    return F.struct(kind.alias("kind"), numbers.alias("numbers"), g.alias("name"))


def confidence(records: DataFrame) -> DataFrame:
    """Low / Medium / High per course from ready sources, open ones and gaps."""
    gaps = chapter_gaps(records).groupBy("course_id").agg(F.count("*").alias("gaps"))
    flags = records.groupBy("course_id").agg(F.count_if(F.col("status") == "ready").alias("ready"),
                                             F.count_if(F.col("status") != "ready").alias("unresolved"))
    rows = flags.join(gaps, "course_id", "left").na.fill(0, ["gaps"])
    level = (F.when(F.col("ready") == 0, "Low").when((F.col("unresolved") > 0) | (F.col("gaps") > 0), "Medium")
              .otherwise("High"))
    return rows.withColumn("confidence", level)


def course_roadmap(records: DataFrame) -> DataFrame:
    """Groups of ready sources in learning order, with their place in the course.

    The sources of a group follow by ``order_sources``; a course has fewer than
    5,000 groups, so numbering them is a small window.
    """
    from pyspark.sql import Window as W

    groups = (records.filter(F.col("status") == "ready").withColumn("group", study_group())
                     .groupBy("course_id", "group")
                     .agg(F.count("*").alias("sources"), F.sum("units").alias("units"), F.sum("words").alias("words")))
    placed = groups.withColumn("place", F.row_number().over(W.partitionBy("course_id").orderBy(group_rank("group"))))
    return (placed.withColumn("label", group_label("group"))
                  .join(confidence(records).select("course_id", "confidence"), "course_id"))


def roadmap_sources(records: DataFrame) -> DataFrame:
    """Ready sources with their position inside their roadmap group."""
    ready = (records.filter(F.col("status") == "ready").withColumn("group", study_group())
                    .withColumn("order", order_hint("source_path")).withColumn("_t", T.casefold("title")))
    return scale.numbered(ready.select("course_id", "group", "source_id", "title", "order", "_t"),
                          ["course_id", "group"], [F.col("order"), F.col("_t"), F.col("source_id")], "position").drop("_t")


def source_locators(chunks: DataFrame) -> DataFrame:
    """Distinct locators of a source as rows, with the chunk that has each first (``_at``)."""
    return (chunks.filter(F.coalesce("locator", F.lit("")) != "")
                  .groupBy("course_id", "source_id", "locator").agg(F.min("ordinal").alias("_at")))


def source_index(records: DataFrame, chunks: DataFrame, n: int | None = None) -> DataFrame:
    """One row per source with its distinct locators in order, or the first ``n`` of
    them for a report. ``source_locators`` has them as rows, for sources of any size."""
    seen = source_locators(chunks)
    first = seen if n is None else scale.first_rows(seen, ["course_id", "source_id"], [F.col("_at")], n)
    lists = first.groupBy("course_id", "source_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "locator"))), lambda s: s["locator"]).alias("locators"))
    return (records.withColumn("order", order_hint("source_path"))
                   .withColumn("chapter_label", chapter_label())
                   .join(lists, ["course_id", "source_id"], "left")
                   .withColumn("locators", F.coalesce("locators", F.array().cast("array<string>"))))


def chapter_label() -> Column:
    """Label from the record's own chapter numbers."""
    text = F.transform(real_chapters(), lambda n: n.cast("string"))
    return (F.when(F.size(text) == 0, "Unclassified sources")
             .when(F.size(text) == 1, F.concat(F.lit("Chapter "), text[0]))
             .otherwise(F.concat(F.lit("Chapters "), F.array_join(text, "–"))))


def coverage(records: DataFrame) -> DataFrame:
    """Open roadmap groups, chapter gaps and unresolved sources, long form."""
    open_rows = course_roadmap(records).select("course_id", F.lit("roadmap").alias("kind"), F.lit("[ ]").alias("mark"),
                                               F.col("label").alias("subject"), F.lit("").alias("detail"))
    gap_rows = chapter_gaps(records).select("course_id", F.lit("gap").alias("kind"), F.lit("[?]").alias("mark"),
                                            F.concat(F.lit("Chapter "), "chapter").alias("subject"),
                                            F.lit("SOURCE GAP").alias("detail"))
    left = records.filter(F.col("status") != "ready").select(
        "course_id", F.lit("unresolved").alias("kind"), F.lit("[?]").alias("mark"), F.col("source_path").alias("subject"),
        F.coalesce(F.nullif("note", F.lit("")), "status").alias("detail"))
    return open_rows.unionByName(gap_rows).unionByName(left)


def section_headings(bodies: DataFrame, body: str = "body", n: int | None = None) -> DataFrame:
    """Headings of level 2 to 6 per source, or the first ``n`` for a report."""
    found = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"(?m)^#{2,6}\s+(.+?)\s*$"), F.lit(1)), T.strip),
                     lambda h: h != "")
    return bodies.withColumn("headings", found if n is None else F.slice(found, 1, n)).drop(body)


# --- size --------------------------------------------------------------------

def member_category(path) -> Column:
    p = col(path)
    top = F.when(p.contains("/"), F.substring_index(p, "/", 1)).otherwise(p)
    ext = T.suffix(p)
    return (F.when(p.isin(*V.NAVIGATION_NAMES), "navigation/control")
             .when(p.startswith("sources/past_exams/"), "exam binary")
             .when(p.startswith("documents/past_exams/"), "exam text")
             .when(top == "chapters", "chapters").when(top == "documents", "normalized documents")
             .when(top == "chunks", "retrieval chunks").when(top == "meta", "metadata")
             .when(top == "sources", F.when(ext == ".pptx", "lecturer PPTX binary").when(ext == ".pdf", "lecturer PDF binary")
                   .otherwise("other lecturer binary"))
             .otherwise("other"))


def size_audit(members: DataFrame) -> DataFrame:
    """Bytes by category, by extension and in total, per package.

    ``members``: package, path, size, stored_size, sha256.
    """
    ext = T.suffix("path")
    rows = (members.withColumn("category", member_category("path"))
                   .withColumn("ext", F.when(ext == "", "[none]").otherwise(ext)))
    grouped = rows.groupingSets([["package", "category"], ["package", "ext"], ["package"]], "package", "category", "ext").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("files"), F.grouping("category").alias("_c"),
        F.grouping("ext").alias("_e"))
    return grouped.select("package", F.when(F.col("_c") == 0, "category").when(F.col("_e") == 0, "ext").otherwise("total")
                          .alias("kind"), F.coalesce("category", "ext", F.lit("")).alias("value"), "bytes", "files")


def top_files(members: DataFrame, n: int = V.LARGEST_SHOWN) -> DataFrame:
    ratio = F.when(F.col("size") > 0, F.round(F.col("stored_size") / F.col("size"), 2)).otherwise(1.0)
    return scale.first_rows(members, ["package"], [F.col("size").desc(), F.col("path")], n, "place").select(
        "package", "place", "path", "size", ratio.alias("stored_ratio"))


def identical_payloads(members: DataFrame) -> DataFrame:
    """Payloads stored more than once: copies, first path and wasted bytes."""
    return (members.groupBy("package", "sha256")
                   .agg(F.count("*").alias("copies"), F.min("path").alias("first_path"), F.max("size").alias("size"))
                   .filter(F.col("copies") > 1)
                   .withColumn("wasted_bytes", (F.col("copies") - 1) * F.col("size")))
