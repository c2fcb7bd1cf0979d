"""Saved courses: roots on disk, sync results and batch import."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T, urls as U
from ..plans import scale


def name_key(name):
    return T.casefold(T.collapse(F.coalesce(T.col(name), F.lit(""))))


def resolve_roots(courses: DataFrame, folders: DataFrame) -> DataFrame:
    """Downloaded folder of each course.

    ``courses``: course_id, parent, url, name. ``folders``: parent, folder,
    has_metadata, root_course_url?, root_course?. Metadata with a URL matches by
    URL only; metadata without one matches by name; a folder without metadata is
    taken by its name only when no sibling has metadata.
    """
    want = (courses.withColumn("_url", U.canonical_course("url")).withColumn("_name", F.nullif(name_key("name"), F.lit("")))
                   .withColumn("_folder", F.nullif(T.safe_name("name", 150), F.lit("untitled"))))
    meta = folders.filter("has_metadata").withColumn("_url", F.nullif(F.trim("root_course_url"), F.lit("")))
    by_url = (meta.filter(F.col("_url").isNotNull()).withColumn("_url", U.canonical_course("_url"))
                  .groupBy("parent", "_url").agg(F.countDistinct("folder").alias("_n_url"), F.min("folder").alias("_f_url")))
    by_name = (meta.filter(F.col("_url").isNull()).withColumn("_name", F.nullif(name_key("root_course"), F.lit("")))
                   .filter(F.col("_name").isNotNull())
                   .groupBy("parent", "_name").agg(F.countDistinct("folder").alias("_n_name"), F.min("folder").alias("_f_name")))
    # a folder may be listed more than once: each fact about it is one row
    own_url = meta.filter(F.col("_url").isNotNull()).select(
        "parent", F.col("folder").alias("_folder"), U.canonical_course("_url").alias("_url"), F.lit(True).alias("_own_url")).distinct()
    own_name = meta.filter(F.col("_url").isNull()).select(
        "parent", F.col("folder").alias("_folder"), name_key("root_course").alias("_name"), F.lit(True).alias("_own_name")).distinct()
    plain = folders.filter("not has_metadata").select("parent", F.col("folder").alias("_folder"), F.lit(True).alias("_plain")).distinct()
    siblings = meta.groupBy("parent").agg(F.lit(True).alias("_siblings"))
    rows = scale.lookup_join(want, own_url, ["parent", "_folder", "_url"])
    rows = scale.lookup_join(rows, own_name, ["parent", "_folder", "_name"])
    rows = scale.lookup_join(rows, plain, ["parent", "_folder"])
    rows = scale.lookup_join(rows, by_url, ["parent", "_url"])
    rows = scale.lookup_join(rows, by_name, ["parent", "_name"])
    rows = scale.lookup_join(rows, siblings, ["parent"])
    exact = F.col("_own_url").isNotNull() | F.col("_own_name").isNotNull()
    n = F.coalesce("_n_url", F.lit(0)) + F.coalesce("_n_name", F.lit(0))
    legacy = F.col("_plain") & F.col("_siblings").isNull()
    how = (F.when(exact, "exact").when(n == 1, "metadata").when(n > 1, "ambiguous")
            .when(F.coalesce(legacy, F.lit(False)), "legacy").otherwise("missing"))
    return rows.withColumn("resolution", how).select(
        *courses.columns, "resolution",
        F.when(F.col("resolution").isin("exact", "legacy"), F.col("_folder"))
         .when(F.col("resolution") == "metadata", F.coalesce("_f_url", "_f_name")).alias("folder"))


def apply_results(courses: DataFrame, results: DataFrame, order: str = "finished_at") -> DataFrame:
    """Latest result per course written into the saved course."""
    last = results.groupBy(F.col("course_id").alias("id")).agg(
        F.max_by(F.struct("status", "downloaded", "skipped", "pages_saved", "errors", "name", F.col(order).alias("at")),
                 F.col(order)).alias("r"))
    rows = courses.join(last, "id", "left")
    some = F.col("r").isNotNull()
    name = F.when(some & (F.coalesce("r.name", F.lit("")) != ""), F.col("r.name")).otherwise(F.col("name"))
    fresh = (F.col("study_pack_path") != "") & ((F.col("r.downloaded") > 0) | (F.col("r.pages_saved") > 0))
    detected = F.when(some, T.course_code(name))
    updates = {
        "name": name,
        "code": F.coalesce(F.when(some & (F.coalesce("r.name", F.lit("")) != ""), detected),
                           F.nullif("code", F.lit("")), detected, F.lit("")),
        "last_sync": F.coalesce("r.at", "last_sync"),
        "last_status": F.coalesce("r.status", "last_status"),
        "last_downloaded": F.coalesce("r.downloaded", "last_downloaded"),
        "last_skipped": F.coalesce("r.skipped", "last_skipped"),
        "last_errors": F.coalesce("r.errors", "last_errors"),
        "study_pack_status": F.when(fresh, "dirty").otherwise(F.col("study_pack_status")),
    }
    return rows.select(*[updates[c].alias(c) if c in updates else F.col(c) for c in courses.columns])


def import_courses(existing: DataFrame, batch: DataFrame, hosts, order: str = "pos") -> DataFrame:
    """New courses of a batch: known URLs and repeats are skipped, one bad row
    rejects the whole batch. ``batch``: batch_id, pos, url, output, name, code."""
    valid = U.is_course("url", hosts)
    checked = batch.withColumn("_valid", valid).withColumn("url", U.canonical_course("url"))
    known = existing.select(U.canonical_course("url").alias("url")).distinct()
    new = checked.join(known, "url", "left_anti")
    first = scale.first_rows(new, ["batch_id", "url"], [F.col(order)])
    # an address that is already known is skipped before its folder is looked at
    bad = (checked.filter(~F.col("_valid")).select("batch_id")
                  .unionByName(first.filter(F.trim("output") == "").select("batch_id")).distinct())
    kept = scale.lookup_join(first, bad.withColumn("_bad", F.lit(True)), ["batch_id"]).filter(F.col("_bad").isNull())
    code = F.coalesce(F.nullif(F.upper(F.trim("code")), F.lit("")), T.course_code("name"), F.lit(""))
    return kept.select("batch_id", order, "url", F.trim("output").alias("output"), F.trim("name").alias("name"),
                       code.alias("code"), F.lit(False).alias("selected"))


def batch_outcome(results: DataFrame) -> DataFrame:
    """Succeeded, failed and with-warnings counts per batch.

    ``results``: batch_id, course_id, has_output, error?, n_warnings.
    """
    ok = F.col("has_output") & F.col("error").isNull()
    return results.groupBy("batch_id").agg(
        F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"),
        F.count_if(ok & (F.col("n_warnings") > 0)).alias("with_warnings"))


def mark_outcome(courses: DataFrame, results: DataFrame) -> DataFrame:
    """Success makes a package up to date; failure makes an existing one dirty."""
    ok = F.col("has_output") & F.col("error").isNull()
    # one result per course and batch; a later batch wins
    last = results.groupBy(F.col("course_id").alias("id")).agg(F.max_by(ok, F.col("batch_id")).alias("_ok"))
    status = (F.when(F.col("_ok"), "up_to_date")
               .when((F.col("_ok") == False) & (F.col("study_pack_path") != ""), "dirty")  # noqa: E712
               .otherwise(F.col("study_pack_status")))
    return courses.join(last, "id", "left").withColumn("study_pack_status", status).select(*courses.columns)


def sorted_courses(courses: DataFrame) -> DataFrame:
    """Global order of a course list: code, then case-folded name."""
    return courses.withColumn("_n", T.casefold("name")).orderBy("code", "_n", "id").drop("_n")


def sorted_output(df: DataFrame, keys: list) -> DataFrame:
    """Rows of one output file in order, for writing; no global sort."""
    return df.sortWithinPartitions(*keys)
