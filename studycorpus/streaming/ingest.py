"""Files that arrive become corpus rows; unchanged ones are skipped.

There is no streaming state: what was seen is the ``source_manifest`` table. Every
batch writes under its own number, the manifest last, so a repeated batch
overwrites its own rows and nothing else.

The manifest is read as a base, with one row per file, and the batches since: every
``COMPACT``-th batch writes a new base. Both are laid out by ``SLOTS`` hash slots of the course, and
a batch reads only the slots of its own courses. So what a batch reads grows neither with the number of
batches nor with the courses that it does not touch.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import chunking
from ..plans import corpus, extract, scale

TABLES = ("records", "chunks", "source_manifest")
COMPACT = 16       # batches between two bases
SLOTS = 64         # hash slots of courses
_KEPT = ["course_id", "logical_path", "sha256", "batch", "slot"]


def _slot():
    return F.pmod(F.xxhash64("course_id"), F.lit(SLOTS)).cast("int").alias("slot")


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def _manifest(spark: SparkSession, path: str, before: int | None = None, slots: list[int] | None = None) -> DataFrame | None:
    """Manifest rows from the batches before a number, of some slots: the newest base, and what came since."""
    rows, base = _table(spark, f"{path}/source_manifest"), _table(spark, f"{path}/manifest_base")
    if rows is None:
        return None
    old = F.lit(True) if before is None else F.col("batch") < before
    upto = None
    if base is not None:
        # partition values only; no file is read
        known = base.select("upto").distinct() if before is None else base.select("upto").distinct().filter(F.col("upto") < before)
        upto = known.agg(F.max("upto")).first()[0]
    rows = rows.filter(old).select(*_KEPT)
    if upto is not None:
        rows = rows.filter(F.col("batch") > upto).unionByName(base.filter(F.col("upto") == upto).select(*_KEPT))
    return rows if slots is None else rows.filter(F.col("slot").isin(slots))


def _seen(spark: SparkSession, path: str, before: int | None = None, slots: list[int] | None = None) -> DataFrame | None:
    """Latest manifest row per file from the batches before a number."""
    rows = _manifest(spark, path, before, slots)
    if rows is None:
        return None
    return rows.groupBy("course_id", "logical_path").agg(F.max_by("sha256", "batch").alias("sha256"), F.max("batch").alias("batch"))


def ingest_batch(batch: DataFrame, number: int, path: str, units: DataFrame | None = None) -> None:
    """One micro-batch: course_id, path, size, content (, mtime). Files go through the
    extractor of their type; ``units`` are those of types that have none here."""
    spark = batch.sparkSession
    stamped = batch if "mtime" in batch.columns else batch.withColumn("mtime", F.lit(None).cast("timestamp"))
    # a file without content has a hash of its own here, so that it is kept and reported
    sha = F.coalesce(F.sha2("content", 256), F.lit(""))
    mark, row = scale.unused(stamped.columns, "_sha256", "_row")
    # the batch is read once: hashed, and written with the bytes that will be read
    held = scale.checkpointed(extract.needed_bytes(stamped.withColumn(mark, sha)).withColumn(row, F.monotonically_increasing_id()))
    # a path that comes twice in a batch counts once: the later file, then the larger hash
    narrow = held.select("course_id", "path", "mtime", "size", mark, row)
    last = scale.first_rows(narrow, ["course_id", "path"], [F.col("mtime").desc_nulls_last(), F.col(mark).desc(), F.col(row)])
    current = scale.checkpointed(last.select(
        "course_id", T.snapshot_id("path").alias("source_id"), F.col("path").alias("logical_path"), F.nullif(mark, F.lit("")).alias("sha256"),
        "size", F.lit("course_material").alias("source_role"), row))
    slots = [r[0] for r in current.select(_slot()).distinct().collect()]       # at most ``SLOTS`` numbers
    prior = _seen(spark, path, number, slots)
    if prior is None:
        todo = current
    else:
        # files of the batch whose bytes are already known need no work
        todo = current.join(prior.select("course_id", "logical_path", "sha256"), ["course_id", "logical_path", "sha256"], "left_anti")
    todo = scale.checkpointed(todo)
    fresh = held.join(todo.select(row), row, "left_semi").drop(row, mark)
    parts = extract.extract(fresh, units)
    records = scale.checkpointed(corpus.build_records(parts.texts, unit_counts=extract.unit_counts(parts.units), statuses=parts.statuses))
    # a duplicate may become the first of its text later, so its chunks are made too
    ids = records.filter(F.col("status").isin("ready", "duplicate")).select("course_id", "source_id", F.col("source_path").alias("path"))
    bodies = parts.plain.join(ids, ["course_id", "path", "source_id"], "left_semi")
    cols = ["course_id", "source_id", "locator", "ordinal", "chunk_id", "text"]
    chunks = chunking.chunk_units(parts.units, of=ids.select("course_id", "source_id").distinct()).select(*cols).unionByName(
        chunking.chunk_bodies(bodies).withColumn("ordinal", F.col("ordinal").cast("long")).select(*cols))
    todo = todo.drop(row)
    out = {"records": records, "chunks": chunks}
    for name in TABLES[:2]:
        out[name].write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
    todo.select("*", _slot()).write.mode("overwrite").partitionBy("slot").parquet(f"{path}/source_manifest/batch={number}")
    if (number + 1) % COMPACT == 0:
        base = _seen(spark, path, number + 1).select("*", _slot())
        base.write.mode("overwrite").partitionBy("slot").parquet(f"{path}/manifest_base/upto={number}")


def start(files: DataFrame, path: str, checkpoint: str, available_now: bool = False, units: DataFrame | None = None):
    """Ingest a stream of files (``sources.files.stream_files`` or the same columns)."""
    writer = (files.writeStream.foreachBatch(lambda df, number: ingest_batch(df, number, path, units))
                   .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def current_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(records, chunks) as of now: the newest version of every file, duplicates
    decided over all of them."""
    newest = _seen(spark, path)
    records = (spark.read.parquet(f"{path}/records").withColumnRenamed("source_path", "logical_path")
                    .join(newest.select("course_id", "logical_path", "batch"), ["course_id", "logical_path", "batch"], "left_semi")
                    .withColumnRenamed("logical_path", "source_path"))
    batches = records.select("course_id", "source_id", "batch")
    decided = corpus.redecide(records.drop("batch"))
    ready = (decided.filter(F.col("status") == "ready").select("course_id", "source_id").join(batches, ["course_id", "source_id"])
                    .withColumnRenamed("batch", "_newest"))
    # joined by source, so that what is grouped by source next moves no text again
    chunks = (spark.read.parquet(f"{path}/chunks").filter(F.col("course_id").isNotNull()).join(ready, ["course_id", "source_id"])
                   .filter(F.col("batch") == F.col("_newest")).drop("_newest", "batch"))
    return decided, chunks
