"""The corpus plan: files with text -> records, chunks, reports, published tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V, text as T
from ..operators import chunking, classify, dedup, refresh
from . import extract, scale

RECORD_COLS = ["course_id", "source_id", "title", "source_path", "source_type", "priority", "rank", "group", "chapter",
               "chapters", "output_path", "status", "chars", "words", "units", "note", "source_copy_path",
               "represented_by_source_id", "retention_decision", "text_key"]


def prepared(files: DataFrame, include_references: bool = False) -> DataFrame:
    """Files with class, group and the status that is known before any text is read."""
    out = classify.gate_references(classify.assign_group(classify.classify_sources(files)), include_references)
    fixed = F.coalesce(F.col("status"), classify.initial_status("source_type"))
    return out.withColumn("fixed_status", fixed).drop("status", "to_extract")


def stored_paths(records: DataFrame) -> DataFrame:
    """Where a ready source is stored: its text, and its original if it is visual."""
    ready = F.col("status") == "ready"
    folder = F.when(F.col("group").startswith("chapter_"), F.concat(F.lit("chapters/"), "group")).otherwise(F.col("group"))
    document = F.concat(F.lit("documents/"), folder, F.lit("/"), T.slug("title"), F.lit("__"), "source_id", F.lit(".md"))
    original = F.concat(F.lit("sources/"), "source_id", F.lit("__"), T.safe_name(T.base_name("source_path"), 150))
    return (records.withColumn("output_path", F.when(ready, document))
                   .withColumn("source_copy_path", F.when(ready & F.col("source_type").isin(*V.VISUAL_TYPES), original)))


def build_records(files: DataFrame, body: str = "body", include_references: bool = False,
                  unit_counts: DataFrame | None = None, statuses: DataFrame | None = None) -> DataFrame:
    """Document records of all courses. The body column is read once, in the scan
    stage, and only sizes and a text key travel on.

    ``statuses`` (course_id, path, status, note) decides about sources that are no
    text, see ``extract``; they take no part in the duplicate test.
    """
    rows = prepared(files, include_references)
    rows = rows.withColumn(body, F.when(F.col("fixed_status").isNull(), F.col(body)))
    facts = dedup.fingerprints(rows, body)
    if statuses is None:
        facts = facts.withColumn("_note", F.lit(None).cast("string"))
    else:
        given = statuses.select("course_id", "path", F.col("status").alias("_given"), F.col("note").alias("_note"))
        facts = (facts.join(given, ["course_id", "path"], "left")
                      .withColumn("_note", F.when(F.col("fixed_status").isNull(), F.col("_note")))
                      .withColumn("fixed_status", F.coalesce("fixed_status", "_given")).drop("_given")
                      .withColumn("text_key", F.when(F.col("fixed_status").isNull(), F.col("text_key"))))
    marked = dedup.mark_duplicates(facts)
    status = F.coalesce("fixed_status", "status")
    note = (F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("Duplicate text of "), "duplicate_of"))
             .when(F.col("fixed_status") == "skipped_unsupported", F.concat(
                 F.lit("Unsupported source type: "), F.when(F.col("ext") == "", "no extension").otherwise(F.col("ext"))))
             .when(F.col("fixed_status") == "reference_indexed_only", "Indexed only; include references to extract it")
             .when(F.col("fixed_status") == "media_pending", "Media was not transcribed")
             .when(F.col("fixed_status") == "link_only", "Unresolved external content")
             .otherwise(F.coalesce("_note", F.lit(""))))
    done = marked.withColumn("status", status).withColumn("note", note).withColumn("source_path", F.col("path"))
    out = (stored_paths(done).withColumn("represented_by_source_id", F.lit(None).cast("string"))
                             .withColumn("retention_decision", F.lit(None).cast("string")))
    if unit_counts is not None:
        out = out.join(unit_counts, ["course_id", "source_id"], "left").withColumn("units", F.coalesce("units", F.lit(0)))
    else:
        out = out.withColumn("units", F.lit(0))
    return out.select(*RECORD_COLS)


def bodies(files: DataFrame, body: str = "body") -> DataFrame:
    """Texts by source: the id is made from path and type in the scan stage, so nothing is joined."""
    return prepared(files).select("course_id", "source_id", "path", F.col(body).alias("body"))


def chunk_counts(records: DataFrame, files: DataFrame, body: str = "body", size: int = V.CHUNK_MAX_CHARS, overlap: int = V.CHUNK_OVERLAP) -> DataFrame:
    """``course_id, source_id, chunks`` of the ready sources. Texts are cut where they are read and only
    the numbers travel."""
    cut = chunking.with_pieces(files.select("course_id", "path", F.col(body).alias("body")), "body", size, overlap)
    counts = cut.select("course_id", "path", F.size("_pieces").cast("long").alias("chunks"))
    ready = records.filter(F.col("status") == "ready").select("course_id", "source_id", F.col("source_path").alias("path"))
    return counts.join(ready, ["course_id", "path"]).select("course_id", "source_id", "chunks")


def build_chunks(records: DataFrame, files: DataFrame, body: str = "body", units: DataFrame | None = None,
                 size: int = V.CHUNK_MAX_CHARS, overlap: int = V.CHUNK_OVERLAP, texts: bool = True) -> DataFrame:
    """Chunks of the ready sources with the record columns they cite.

    Record and body meet on the path, which is unique; the text moves once. Without
    ``texts`` it does not move at all: the text of a chunk is ``x``, or empty if it is blank.
    """
    facts = (records.filter(F.col("status") == "ready")
                    .select("course_id", F.col("source_path").alias("path"), "source_id", "title", "source_type", "priority",
                            "group", "chapter", "chapters"))
    bodies = files.select("course_id", "path", F.col(body).alias("body"))
    if units is not None:
        # sources with units are told apart on narrow rows
        key = ["course_id", "source_id"]
        with_units = units.select(*key).distinct()
        plain = facts.join(with_units, key, "left_anti")
        cols = [c for c in facts.columns if c not in key]
        cut = chunking.chunk_bodies(bodies.join(plain, ["course_id", "path"]), "body", size, overlap).withColumn("ordinal", F.col("ordinal").cast("long"))
        of_units = chunking.chunk_units(units, size, overlap, facts.join(with_units, key, "left_semi"))
        names = [*key, *cols, "locator", "ordinal", "chunk_id", "text"]
        rows = of_units.select(*names).unionByName(cut.select(*names))
    elif not texts:
        marked = chunking.piece_marks(bodies, "body", size, overlap).join(facts, ["course_id", "path"])
        rows = chunking.chunk_marks(marked)
    else:
        rows = chunking.chunk_bodies(bodies.join(facts, ["course_id", "path"]), "body", size, overlap)
    folder = F.when(F.col("group").startswith("chapter_"), F.concat(F.lit("chapters/"), "group")).otherwise(F.col("group"))
    text = F.col("text") if texts else F.when(T.strip("text") != "", "x").otherwise("").alias("text")
    return rows.select("course_id", "chunk_id", "source_id", "ordinal", "title", F.col("path").alias("source_path"),
                       "source_type", "priority", "group", "chapter", "chapters", "locator", text,
                       F.concat(F.lit("chunks/"), folder, F.lit("/"), "chunk_id", F.lit(".md")).alias("chunk_path"))


def refresh_records(files: DataFrame, body: str, prior_records: DataFrame, changes: DataFrame,
                    include_references: bool = False, unit_counts: DataFrame | None = None,
                    statuses: DataFrame | None = None) -> DataFrame:
    """Records after a refresh: only new and changed files are read, and duplicate
    groups are decided anew, so the result equals a full rebuild.

    The text keys of reused sources are in their old records; no old body is read.
    """
    reused = changes.filter(F.col("change") == "reused").select("course_id", F.col("logical_path").alias("path"))
    moved = changes.filter(F.col("change").isin("new", "changed")).select("course_id", F.col("logical_path").alias("path"))
    fresh = build_records(files.join(moved, ["course_id", "path"], "left_semi"), body, include_references, unit_counts, statuses)
    kept = prior_records.withColumnRenamed("source_path", "path").join(reused, ["course_id", "path"], "left_semi") \
                        .withColumnRenamed("path", "source_path").select(*RECORD_COLS)
    everything = fresh.unionByName(kept)
    return redecide(everything)


def redecide(records: DataFrame) -> DataFrame:
    """Decide ready / duplicate anew from the text keys of the records."""
    facts = records.withColumnRenamed("source_path", "path").withColumnRenamed("status", "_was")
    rows = dedup.mark_duplicates(facts).withColumnRenamed("path", "source_path")
    textual = F.col("_was").isin("ready", "duplicate", "empty")
    rows = rows.withColumn("status", F.when(textual, F.col("status")).otherwise(F.col("_was")))
    return stored_paths(rows).withColumn(
        "note", F.when(F.col("status") == "duplicate", F.concat(F.lit("Duplicate text of "), "duplicate_of"))
                 .when(F.col("_was") == "duplicate", "").otherwise(F.col("note"))).select(*RECORD_COLS)


def refresh_chunks(records: DataFrame, files: DataFrame, body: str, prior_chunks: DataFrame, prior_records: DataFrame,
                   changes: DataFrame, units: DataFrame | None = None, plain: DataFrame | None = None) -> DataFrame:
    """Chunks after a refresh: old ones of reused sources that are still ready, new
    ones for everything that became ready."""
    ready = records.filter(F.col("status") == "ready").select("course_id", "source_id", "source_path")
    reused = changes.filter(F.col("change") == "reused").select("course_id", F.col("logical_path").alias("source_path"))
    was_ready = prior_records.filter(F.col("status") == "ready").select("course_id", "source_path")
    still = (ready.join(reused, ["course_id", "source_path"], "left_semi")
                  .join(was_ready, ["course_id", "source_path"], "left_semi"))
    kept = scale.lookup_join(prior_chunks, still.select("course_id", "source_id", F.lit(True).alias("_k")),
                             ["course_id", "source_id"], how="inner").drop("_k")
    build = records.join(still.select("course_id", "source_id"), ["course_id", "source_id"], "left_anti")
    return kept.unionByName(build_chunks(build, files if plain is None else plain, body, units))


def incremental(files: DataFrame, body: str, current: DataFrame, prior: DataFrame, prior_records: DataFrame,
                prior_chunks: DataFrame, units: DataFrame | None = None, statuses: DataFrame | None = None, plain: DataFrame | None = None):
    """(changes, records, chunks) of a refresh. ``units``, ``statuses`` and ``plain`` are those of
    ``extract`` over the files as they are now; without ``plain`` chunks are cut from ``files``."""
    # both are used several times, and behind the changes are the bytes of all files
    changes = scale.checkpointed(refresh.source_changes(current, prior))
    counts = None if units is None else extract.unit_counts(units)
    records = scale.checkpointed(refresh_records(files, body, prior_records, changes, unit_counts=counts, statuses=statuses))
    return changes, records, refresh_chunks(records, files, body, prior_chunks, prior_records, changes, units, plain)


def build(files: DataFrame, units: DataFrame | None = None, include_references: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, chunks) of files with their bytes: course_id, path, size, content."""
    parts = extract.extract(files, units, include_references)
    records = scale.checkpointed(build_records(parts.texts, "body", include_references, extract.unit_counts(parts.units), parts.statuses))
    return records, build_chunks(records, parts.plain, "body", parts.units)
