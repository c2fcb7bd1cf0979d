"""Snapshots, refresh plans and what can be carried forward."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..plans import scale


def snapshot(files: DataFrame, content: str = "content") -> DataFrame:
    """Manifest rows of files; the bytes are hashed in the scan stage."""
    return files.select("course_id", T.snapshot_id("path").alias("source_id"), F.col("path").alias("logical_path"),
                        F.sha2(F.col(content), 256).alias("sha256"), "size",
                        F.lit("course_material").alias("source_role"))


def source_changes(current: DataFrame, prior: DataFrame) -> DataFrame:
    """new / changed / removed / reused per (course_id, logical_path). A file whose hash is unknown
    on both sides counts as reused."""
    key = ["course_id", "logical_path"]
    both = current.select(*key, F.col("sha256").alias("now"), F.lit(True).alias("_c")).join(
        prior.select(*key, F.col("sha256").alias("then"), F.lit(True).alias("_p")), key, "full_outer")
    change = (F.when(F.col("_p").isNull(), "new").when(F.col("_c").isNull(), "removed")
               .when(F.col("now").eqNullSafe(F.col("then")), "reused").otherwise("changed"))
    return both.select(*key, change.alias("change"))


def course_states(changes: DataFrame, packages: DataFrame, fingerprint: str) -> DataFrame:
    """State per course.

    ``packages``: course_id, has_manifest, viable, fingerprint; no row = missing.
    A course with a package that is not comparable counts all its files as new.
    """
    counts = changes.groupBy("course_id").agg(*[
        F.count_if(F.col("change") == c).alias(f"n_{c}") for c in ("new", "changed", "removed", "reused")])
    rows = counts.join(packages, "course_id", "full_outer").na.fill(0)
    touched = F.col("n_new") + F.col("n_changed") + F.col("n_removed")
    state = (F.when(F.col("has_manifest").isNull(), "missing")
              .when(~F.col("has_manifest"), "legacy")
              .when(~F.coalesce(F.col("viable"), F.lit(False)), "invalid")
              .when(F.coalesce(F.col("fingerprint"), F.lit("")) != fingerprint, "legacy")
              .when(touched == 0, "up_to_date").otherwise("dirty"))
    rows = rows.withColumn("state", state)
    usable = F.col("state").isin("up_to_date", "dirty")
    files_now = F.col("n_new") + F.col("n_changed") + F.col("n_reused")
    return rows.select(
        "course_id", "state", (F.col("state") != "up_to_date").alias("requires_rebuild"),
        F.when(usable, F.col("n_new")).otherwise(files_now).alias("n_new"),
        *[F.when(usable, F.col(c)).otherwise(0).alias(c) for c in ("n_changed", "n_removed", "n_reused")])


def refresh_plan(current: DataFrame, prior: DataFrame, packages: DataFrame, fingerprint: str):
    """(changes per path, state per course)."""
    changes = source_changes(current, prior)
    return changes, course_states(changes, packages, fingerprint)


def carry_forward(prior_docs: DataFrame, prior_chunks: DataFrame, changes: DataFrame):
    """Derived rows of reused sources; chunks follow their source."""
    reused = changes.filter(F.col("change") == "reused").select("course_id", F.col("logical_path").alias("source_path"))
    docs = prior_docs.join(reused, ["course_id", "source_path"], "left_semi")
    kept = docs.groupBy("course_id", "source_id").agg(F.lit(True).alias("_kept"))
    chunks = scale.lookup_join(prior_chunks, kept, ["course_id", "source_id"], how="inner").drop("_kept")
    return docs, chunks


def manifest_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Paths only in ``a``, only in ``b``, or in both."""
    key = ["course_id", "logical_path"]
    x, y = a.select(*key).distinct(), b.select(*key).distinct()
    return (x.exceptAll(y).withColumn("side", F.lit("only_a"))
             .unionByName(y.exceptAll(x).withColumn("side", F.lit("only_b")))
             .unionByName(x.intersect(y).withColumn("side", F.lit("both"))))
