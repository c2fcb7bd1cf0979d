"""Files to text, units and statuses by type: one dispatch for batch, ingest and refresh."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V, text as T, udfs
from ..operators import classify, dedup
from ..sources import files as S, pages
from . import scale

#: Types whose text other tools extract: it arrives as units, or the original alone is kept.
GIVEN_TYPES = ("lecture_pdf", "reference_pdf", "slide", "word_document", "spreadsheet")
NOTE_CHARS = 500        # of a reason that is kept
UNIT_COLS = ["course_id", "source_id", "unit_no", "locator", "text"]


class Extracted(NamedTuple):
    """``texts``: course_id, path, size, source_id, body. ``units``: of sources that have
    some. ``statuses``: course_id, path, status, note of sources that are no text.
    ``links``: course_id, title, source_path, url, group of shortcut files. ``plain``: the
    ``texts`` whose types have no units."""
    texts: DataFrame
    units: DataFrame
    statuses: DataFrame
    links: DataFrame
    plain: DataFrame


def _kinds() -> tuple[Column, Column, Column]:
    """Whether a classified file is read as plain text, as a web page, or as a shortcut."""
    kind, ext = F.col("source_type"), F.col("ext")
    plain = kind.isin("csv_table", "subtitle") | ((kind == "lms_page") & ext.isin(*V.TEXT_EXTS))
    return plain, (kind == "lms_page") & ext.isin(*V.HTML_EXTS), kind == "url"


def needed_bytes(files: DataFrame) -> DataFrame:
    """The files without the bytes that ``extract`` never reads."""
    plain, page, shortcut = _kinds()
    kept = F.when(plain | page | shortcut, F.col("content")).alias("content")
    return classify.classify_sources(files).select(*[kept if c == "content" else F.col(c) for c in files.columns])


def extract(files: DataFrame, units: DataFrame | None = None, include_references: bool = False) -> Extracted:
    """Text of files (course_id, path, size, content) by source type.

    Plain text and web pages become bodies, CSV and subtitle files units and a body made of
    them. ``units`` (course_id, source_id, unit_no, locator, text) are those of PDF, slide,
    word and sheet files; such a file without units is ``visual_only``. A web page beside a
    ``content.txt`` and a page that only wraps a video get their own status. Bytes of other
    types are never decoded. Contents are read once, in the scan stage, and written as texts.

    A file that should be read and has no content, or whose ``error`` column (if there is one)
    names a reason, gets status ``error`` with the reason as its note.
    """
    typed = classify.gate_references(classify.classify_sources(files), include_references)
    kind = F.col("source_type")
    plain, page, shortcut = _kinds()
    raw = F.when(plain | shortcut, F.col("content"))
    reason = F.col("error") if "error" in files.columns else F.lit(None).cast("string")
    # types that are never extracted, and references that are only listed, cannot fail
    extracted = F.col("status").isNull() & (plain | page | kind.isin(*GIVEN_TYPES))
    failed = F.when(extracted, F.coalesce(F.substring(reason, 1, NOTE_CHARS), F.when((plain | page) & F.col("content").isNull(), "The file could not be read")))
    utf8 = F.try_validate_utf8(raw.cast("string"))
    text = F.coalesce(utf8, udfs.decode_legacy(F.when(utf8.isNull(), raw)), pages.stored_text(F.when(page, F.col("content"))))
    # cells and cues keep their own line ends; they are cleaned one by one
    body = F.when(kind.isin("csv_table", "subtitle"), text).otherwise(T.clean_block(text))
    texts = scale.checkpointed(typed.select("course_id", "path", "size", "source_id", "source_type", "ext", F.when(~shortcut & failed.isNull(), body).alias("body"),
                                            F.when(shortcut, text).alias("shortcut"), failed.alias("failed")))
    links = S.shortcut_links(classify.assign_group(texts.filter("source_type = 'url'").select("course_id", "path", "source_type", F.col("shortcut").alias("text"))))
    errors = texts.filter("failed is not null").select("course_id", "path", F.lit("error").alias("status"), F.col("failed").alias("note"))
    texts = texts.drop("shortcut", "failed")

    rows = texts.filter("source_type = 'csv_table'").select("course_id", "source_id", "body")
    cues = texts.filter("source_type = 'subtitle'").select("course_id", "source_id", "body")
    own = S.csv_units(rows, "body").select(*UNIT_COLS, F.concat(F.lit("Row "), "unit_no", F.lit(": "), "text").alias("line")).unionByName(
        S.subtitle_cues(cues, "body").select("course_id", "source_id", F.col("unit_no").cast("long").alias("unit_no"), "locator", "text",
                                             F.concat(F.lit("["), "locator", F.lit("] "), "text").alias("line")))
    own = scale.checkpointed(own)
    given = own.select(*UNIT_COLS).limit(0)
    if units is not None:
        known = texts.filter(F.col("source_type").isin(*GIVEN_TYPES)).select("course_id", "source_id")
        # their texts move here, and are read several times
        given = scale.checkpointed(units.select("course_id", "source_id", F.col("unit_no").cast("long").alias("unit_no"), "locator", "text")
                                        .join(known, ["course_id", "source_id"], "left_semi"))

    # the body of a source with units: the units of one file, in order
    lines = own.unionByName(given.withColumn("line", F.col("text")))
    joined = lines.groupBy("course_id", "source_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("unit_no", "line"))), lambda u: u["line"]), "\n\n").alias("_joined"))
    unitary = F.col("source_type").isin("csv_table", "subtitle", *GIVEN_TYPES)
    plain_texts = texts.filter(~unitary).select("course_id", "path", "size", "source_id", "body")
    whole = plain_texts.unionByName(
        texts.filter(unitary).drop("body").join(joined, ["course_id", "source_id"], "left")
             .select("course_id", "path", "size", "source_id", F.coalesce("_joined", F.lit("")).alias("body")))

    narrow = texts.select("course_id", "path", "source_id", "source_type", "ext")
    bare = narrow.filter(F.col("source_type").isin(*GIVEN_TYPES)).join(
        given.select("course_id", "source_id").distinct(), ["course_id", "source_id"], "left_anti").select(
        "course_id", "path", F.lit("visual_only").alias("status"), F.lit("No text was extracted; the original is kept").alias("note"))
    if not include_references:
        bare = bare.join(narrow.filter("source_type = 'reference_pdf'").select("course_id", "path"), ["course_id", "path"], "left_anti")
    beside = dedup.drop_superseded(narrow).filter(F.col("status").isNotNull()).select(
        "course_id", "path", "status", F.lit("content.txt exists in same folder").alias("note"))
    plain_pages = texts.filter((F.col("source_type") == "lms_page") & F.col("ext").isin(*V.TEXT_EXTS)).select("course_id", "path", "body")
    stubs = dedup.drop_media_stubs(plain_pages, narrow).filter(F.col("status").isNotNull()).select(
        "course_id", "path", "status", F.lit("Tiny activity wrapper; use the media transcript instead").alias("note"))
    others = bare.unionByName(beside).unionByName(stubs).join(errors.select("course_id", "path"), ["course_id", "path"], "left_anti")
    return Extracted(whole, own.select(*UNIT_COLS).unionByName(given), scale.checkpointed(errors.unionByName(others)), links, plain_texts)


def unit_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("course_id", "source_id").agg(F.count("*").cast("int").alias("units"))
