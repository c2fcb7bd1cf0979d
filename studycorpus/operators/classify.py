"""Source classes, chapter groups, section buckets and reference gating."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V, text as T
from ..functions.text import col


def is_metadata(path) -> Column:
    p = F.lower(col(path))
    return p.isin(*V.METADATA_PATHS) | T.base_name(p).isin(*V.METADATA_NAMES)


def path_words(path) -> Column:
    """Comparison form of a relative path, parts separated by `` / ``."""
    return T.norm_compare(F.replace(col(path), F.lit("/"), F.lit(" / ")))


def is_reference(path) -> Column:
    return T.any_contains(path_words(path), V.REFERENCE_HINTS)


def _rank_table() -> list[tuple[tuple[str, ...], int]]:
    return [
        (V.TEXT_EXTS, 1), (V.HTML_EXTS, 2), (V.WORD_EXTS + V.SHEET_EXTS + V.CSV_EXTS, 3),
        (V.SLIDE_EXTS, 4), (V.PDF_EXTS, 5), (V.SUBTITLE_EXTS, 6),
        (V.VIDEO_EXTS + V.AUDIO_EXTS, 7), (V.SHORTCUT_EXTS, 8),
    ]


def source_rank(path, ext) -> Column:
    out = F.when(F.lower(T.base_name(path)) == V.CONTENT_TEXT_NAME, 0)
    for exts, rank in _rank_table():
        out = out.when(col(ext).isin(*exts), rank)
    return out.otherwise(V.RANK_OTHER)


def source_type(path, ext, words=None) -> Column:
    e = col(ext)
    reference = T.any_contains(col(words), V.REFERENCE_HINTS) if words is not None else is_reference(path)
    return (F.when(e.isin(*V.TEXT_EXTS, *V.HTML_EXTS), "lms_page")
             .when(e.isin(*V.PDF_EXTS), F.when(reference, "reference_pdf").otherwise("lecture_pdf"))
             .when(e.isin(*V.SLIDE_EXTS), "slide")
             .when(e.isin(*V.WORD_EXTS), "word_document")
             .when(e.isin(*V.SHEET_EXTS), "spreadsheet")
             .when(e.isin(*V.CSV_EXTS), "csv_table")
             .when(e.isin(*V.SUBTITLE_EXTS), "subtitle")
             .when(e.isin(*V.VIDEO_EXTS, *V.AUDIO_EXTS), "media")
             .when(e.isin(*V.SHORTCUT_EXTS), "url")
             .when(e.isin(*V.JSON_EXTS) & is_metadata(path), "metadata")
             .otherwise("binary"))


def priority_of(source_type) -> Column:
    table = F.create_map(*[F.lit(x) for pair in V.SOURCE_PRIORITY.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col(source_type)), F.lit(5))


def classify_sources(files: DataFrame) -> DataFrame:
    """Add type, canonical rank, priority, title, id and class flags to files."""
    lecturer = (V.TEXT_EXTS + V.HTML_EXTS + V.PDF_EXTS + V.SLIDE_EXTS + V.WORD_EXTS + V.SHEET_EXTS
                + V.CSV_EXTS + V.VIDEO_EXTS + V.AUDIO_EXTS + V.SUBTITLE_EXTS)
    out = (files.withColumn("ext", T.suffix("path"))
                .withColumn("_words", path_words("path"))
                .withColumn("is_metadata", is_metadata("path")))
    return (out.withColumn("source_type", source_type("path", "ext", "_words"))
               .withColumn("rank", source_rank("path", "ext"))
               .withColumn("priority", priority_of("source_type"))
               .withColumn("is_supported", ~F.col("is_metadata") & F.col("ext").isin(*lecturer, *V.SHORTCUT_EXTS))
               .withColumn("is_lecturer_material", ~F.col("is_metadata") & F.col("ext").isin(*lecturer))
               .withColumn("title", T.title_of("path"))
               .withColumn("source_id", T.source_id("path", "source_type"))
               .drop("_words"))


def chapter_numbers(path, strict: bool = False) -> Column:
    """Chapter numbers named in a path: a range, else the last single one.

    ``strict`` refuses a range whose second number goes on (``Ch1 - 2024``).
    """
    text = F.replace(col(path), F.lit("/"), F.lit(" / "))
    pattern = V.CHAPTER_RANGE_STRICT if strict else V.CHAPTER_RANGE
    a = F.regexp_extract(text, pattern, 1).try_cast("int")
    b = F.regexp_extract(text, pattern, 2).try_cast("int")
    low, high = F.least(a, b), F.greatest(a, b)
    singles = F.transform(F.regexp_extract_all(text, F.lit(V.CHAPTER_SINGLE), F.lit(1)), lambda n: n.cast("int"))
    valid = F.filter(singles, lambda n: (n > 0) & (n < 100))
    return (F.when(low.isNotNull() & (low > 0) & (high < 100), F.sequence(low, high))
             .when(F.size(valid) > 0, F.slice(valid, -1, 1))
             .otherwise(F.array().cast("array<int>")))


def group_name(chapters) -> Column:
    return F.concat(F.lit("chapter_"), F.array_join(
        F.transform(col(chapters), lambda n: F.lpad(n.cast("string"), 2, "0")), "_"))


def assign_group(files: DataFrame, strict: bool = False) -> DataFrame:
    """Add ``chapters``, ``group`` and ``chapter`` from the relative path.

    A path without a chapter in the course-info group carries the number 0 of
    its group name; positive numbers are the real chapters.
    """
    out = (files.withColumn("_ch", chapter_numbers("path", strict))
                .withColumn("_words", path_words("path")))
    out = out.withColumn(
        "group",
        F.when(F.size("_ch") > 0, group_name("_ch"))
         .when(T.any_contains(F.col("_words"), V.COURSE_INFO_HINTS), "00_course")
         .when(T.any_contains(F.col("_words"), V.REFERENCE_HINTS), "references")
         .otherwise("other"))
    return (out.withColumn("chapter", F.try_element_at("_ch", F.lit(1)))
               .withColumn("chapters", F.when(F.col("group") == "00_course", F.array(F.lit(0))).otherwise(F.col("_ch")))
               .drop("_ch", "_words"))


def bucket_of(title) -> Column:
    folded = T.fold_section(title)
    first, *rest = V.SECTION_BUCKETS
    out = F.when(folded.rlike(first[1]), first[0])
    for key, pattern in rest:
        out = out.when(folded.rlike(pattern), key)
    return out.otherwise("other")


def bucket_sections(outline: DataFrame, title: str = "section_title") -> DataFrame:
    return outline.withColumn("bucket", bucket_of(title))


def gate_references(sources: DataFrame, include: bool = False) -> DataFrame:
    """Reference PDFs stay an index entry unless they are asked for.

    Apply it before any content column is read: ``to_extract`` tells which rows
    need their content.
    """
    gated = (F.col("source_type") == "reference_pdf") & F.lit(not include)
    return (sources.withColumn("status", F.when(gated, "reference_indexed_only"))
                   .withColumn("to_extract", ~gated))


def initial_status(source_type) -> Column:
    """Status of sources that never reach text extraction, null for the rest."""
    t = col(source_type)
    return (F.when(t == "media", "media_pending").when(t == "url", "link_only")
             .when(t == "metadata", "metadata_copied").when(t == "binary", "skipped_unsupported"))


def code_of(df: DataFrame, name_col: str) -> DataFrame:
    """Both code rules: the bounded one of names, the packed one of catalogs."""
    return (df.withColumn("course_code", T.course_code(name_col))
              .withColumn("catalog_code", T.catalog_code(name_col)))


