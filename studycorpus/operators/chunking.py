"""Overlapping retrieval chunks with traceable ids, all inside the JVM."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V, text as T
from ..plans import scale


def _strides(paragraph: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters, each starting ``overlap`` before the last end.

    One regular expression walks the text once; the look-ahead takes the window
    and the match itself moves on by one step.
    """
    step = max(1, size - overlap)
    windows = F.regexp_extract_all(paragraph, F.lit(rf"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    count = F.greatest(F.lit(1), F.ceil((F.length(paragraph) - size) / step) + 1).cast("int")
    return F.transform(F.slice(windows, 1, count), T.strip)


def _packed(paragraphs, size: int, overlap: int) -> Column:
    """Fold the paragraphs of one text into pieces."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, p: Column) -> Column:
        done, open_ = state["done"], state["open"]
        flushed = F.when(open_ == "", done).otherwise(F.concat(done, F.array(T.strip(open_))))
        joined = F.when(open_ == "", p).otherwise(F.concat(open_, F.lit("\n\n"), p))
        tail = T.strip(F.right(open_, F.lit(overlap))) if overlap > 0 else F.lit("")
        carried = F.when(tail == "", p).otherwise(F.concat(tail, F.lit("\n\n"), p))
        return (F.when(F.length(p) > size, F.struct(
                    F.concat(flushed, _strides(p, size, overlap)).alias("done"), F.lit("").alias("open")))
                 .when(F.length(joined) <= size, F.struct(done.alias("done"), joined.alias("open")))
                 .otherwise(F.struct(flushed.alias("done"), T.strip(carried).alias("open"))))

    return F.aggregate(paragraphs, start, add, lambda s: F.when(s["open"] == "", s["done"]).otherwise(
        F.concat(s["done"], F.array(T.strip(s["open"])))))


def with_pieces(df: DataFrame, text: str, size: int = V.CHUNK_MAX_CHARS, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """Replace the text of a unit by ``_pieces``, the array of its pieces.

    Paragraphs are packed up to ``size``. A new piece starts with the tail of the
    one before and is not measured again, so it may be longer than ``size``. A
    paragraph longer than ``size`` is cut in strides on its own.
    """
    clean = df.withColumn("_clean", T.clean_block(text)).drop(text)
    # only texts that must be cut are split into paragraphs
    parts = F.filter(F.transform(F.split("_clean", r"\n\s*\n"), T.strip), lambda p: p != "")
    cut = clean.withColumn("_parts", F.when(F.length("_clean") > size, parts))
    pieces_ = (F.when(F.col("_clean") == "", F.array().cast("array<string>"))
                .when(F.col("_parts").isNull(), F.array("_clean"))
                .when(F.size("_parts") == 1, _strides(F.element_at("_parts", 1), size, overlap))
                .otherwise(_packed(F.col("_parts"), size, overlap)))
    return cut.withColumn("_pieces", F.filter(pieces_, lambda x: x != "")).drop("_clean", "_parts")


def pieces(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """One row per piece with its position in the unit, from 0."""
    cut = with_pieces(df, text, size, overlap)
    keep = [c for c in cut.columns if c != "_pieces"]
    return T.unnest(cut, keep, "_pieces", "pos", "text")


def piece_marks(df: DataFrame, text: str, size: int = V.CHUNK_MAX_CHARS, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """Replace a text by ``_marks``: for each of its pieces ``x``, or nothing if the piece is blank. Made
    where the text is read, so no text travels."""
    cut = with_pieces(df, text, size, overlap)
    return cut.withColumn("_marks", F.transform("_pieces", lambda p: F.when(T.strip(p) != "", "x").otherwise(""))).drop("_pieces")


def chunk_id(source_id, ordinal) -> Column:
    return F.concat(F.col(source_id), F.lit("_c"), F.when(F.col(ordinal) < 10_000, F.lpad(
        F.col(ordinal).cast("string"), 4, "0")).otherwise(F.col(ordinal).cast("string")))


def chunk_bodies(bodies: DataFrame, text: str = "body", size: int = V.CHUNK_MAX_CHARS,
                 overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of sources without units: one unit ``document`` per source, no shuffle."""
    return _of_bodies(pieces(bodies, text, size, overlap))


def chunk_marks(marked: DataFrame) -> DataFrame:
    """``chunk_bodies`` of sources whose text was replaced by ``piece_marks``."""
    return _of_bodies(T.unnest(marked, [c for c in marked.columns if c != "_marks"], "_marks", "pos", "text"))


def _of_bodies(rows: DataFrame) -> DataFrame:
    return (rows.withColumn("ordinal", F.col("pos") + 1).withColumn("locator", F.lit("document"))
                .withColumn("chunk_id", chunk_id("source_id", "ordinal")).drop("pos"))


def chunk_units(units: DataFrame, size: int = V.CHUNK_MAX_CHARS, overlap: int = V.CHUNK_OVERLAP, of: DataFrame | None = None) -> DataFrame:
    """Chunks of ``units`` (course_id, source_id, unit_no, locator, text).

    Ordinals run through the units of a source. The earlier units are counted on
    narrow rows, in buckets of unit numbers, so a source with very many units is
    never ordered in one task. The pieces move once, to their numbers.

    ``of`` (course_id, source_id, once each) names the sources that are wanted; its other
    columns come along.
    """
    cut = with_pieces(units, "text", size, overlap)
    counts = cut.select("course_id", "source_id", "unit_no", F.size("_pieces").cast("long").alias("_n"))
    if of is not None:
        counts = counts.join(of.select("course_id", "source_id"), ["course_id", "source_id"], "left_semi")
    # the sums read the counts twice, so texts would be cut three times
    starts = scale.bucket_sums(scale.checkpointed(counts), ["course_id", "source_id"], "unit_no", F.col("_n"), "_start").drop("_n")
    if of is not None:
        starts = starts.join(of, ["course_id", "source_id"])
    placed = cut.join(starts, ["course_id", "source_id", "unit_no"])
    keep = [c for c in placed.columns if c not in ("_pieces", "_start")]
    return (T.unnest(placed, [*keep, "_start"], "_pieces", "_pos", "text")
                  .withColumn("ordinal", F.col("_start") + F.col("_pos") + 1)
                  .withColumn("chunk_id", chunk_id("source_id", "ordinal")).drop("_start", "_pos"))


def chunk_sources(sources: DataFrame, units: DataFrame | None = None, size: int = V.CHUNK_MAX_CHARS,
                  overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """Chunks of all sources: from their units, or from the body when there is none."""
    if units is None:
        return chunk_bodies(sources, "body", size, overlap)
    has_units = units.select("course_id", "source_id").distinct()
    plain = sources.join(has_units, ["course_id", "source_id"], "left_anti").select("course_id", "source_id", "body")
    cols = ["course_id", "source_id", "locator", "ordinal", "chunk_id", "text"]
    return chunk_units(units, size, overlap).select(*cols).unionByName(
        chunk_bodies(plain, "body", size, overlap).withColumn("ordinal", F.col("ordinal").cast("long")).select(*cols))
