"""Crawl results: link reachability, sync diffs, summaries and failures."""
from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V, urls as U
from ..plans import scale
from .redact import redact_text, safe_source


def reachable(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None,
              closed: DataFrame | None = None) -> DataFrame:
    """Every node once, at its smallest depth from its seed's scope.

    ``edges``: scope, src, dst; without scope they hold in every scope, and are kept
    once. ``seeds``: scope, node. ``closed`` (scope, node) are nodes that are met but never
    entered. Without ``max_depth`` the walk ends when nothing new is met; with it, nodes first
    met beyond are reported with state ``max_depth``.
    """
    spark = edges.sparkSession
    at = [c for c in ("scope", "src") if c in edges.columns]
    links = scale.checkpointed(edges.select(*at, "dst"))
    hubs = scale.checkpointed(scale.heavy_keys(links, at).withColumn("_hub", F.lit(True)))    # few rows by definition
    salts = scale.shuffle_width(spark)
    salt = F.when(F.col("_hub"), F.pmod(F.xxhash64("dst"), F.lit(salts)).cast("int")).otherwise(0)
    dealt = scale.Bucketed(spark, [*at, "_salt"]).add(
        links.join(F.broadcast(hubs), at, "left").select(*at, salt.alias("_salt"), "dst"), deal=True)
    links = dealt.close()
    visited = scale.Bucketed(spark, ["scope", "node"]).add(
        seeds.select("scope", "node").distinct().withColumn("depth", F.lit(0)), deal=True)
    spread = F.explode(F.when(F.col("_hub"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))
    for depth in count(1) if max_depth is None else range(1, max_depth + 2):
        known = visited.read()
        frontier = known.filter(F.col("depth") == depth - 1)        # the files of other levels are passed over by their bounds
        if frontier.isEmpty():
            break
        if closed is not None:
            frontier = frontier.join(closed.select("scope", "node"), ["scope", "node"], "left_anti")
        frontier = (frontier.select("scope", F.col("node").alias("src")).join(F.broadcast(hubs), at, "left")
                            .select("scope", "src", spread.alias("_salt")))
        met = links.join(frontier, [*at, "_salt"]).select("scope", F.col("dst").alias("node")).distinct()
        visited.add(met.join(known.select("scope", "node"), ["scope", "node"], "left_anti").withColumn("depth", F.lit(depth)))
    state = F.lit("reached") if max_depth is None else F.when(F.col("depth") <= max_depth, "reached").otherwise("max_depth")
    return visited.close().select("scope", "node", "depth", state.alias("state"))


def sync_diff(remote: DataFrame, local: DataFrame, force: bool = False) -> DataFrame:
    """Decision per remote item: skipped_video, skipped or download.

    ``remote``: course_id, path, url, size (null when unknown). ``local``:
    course_id, path, size.
    """
    have = local.select("course_id", "path", F.col("size").alias("local_size"), F.lit(True).alias("_have"))
    same = F.col("size").isNull() | (F.col("size") == F.col("local_size"))
    action = (F.when(U.is_video("url"), "skipped_video")
               .when(F.col("_have") & same & F.lit(not force), "skipped").otherwise("download"))
    return remote.join(have, ["course_id", "path"], "left").withColumn("action", action).drop("_have")


def course_results(crawl_log: DataFrame) -> DataFrame:
    """Counters and status per course from its log rows."""
    counts = crawl_log.groupBy("course_id").agg(
        *[F.count_if(F.col("status") == s).alias(n) for s, n in (
            ("downloaded", "downloaded"), ("skipped", "skipped"), ("skipped_video", "skipped_video"),
            ("page_saved", "pages_saved"), ("error", "errors"))],
        F.bool_or((F.col("status") == "error") & (F.col("context") == "course")).alias("_fatal"))
    status = (F.when(F.col("_fatal"), "error").when(F.col("errors") > 0, "partial")
               .when(F.col("downloaded") > 0, "success").otherwise("up_to_date"))
    return counts.withColumn("status", status).drop("_fatal")


def sync_summary(crawl_log: DataFrame) -> DataFrame:
    """One row per course and one batch row (``course_id`` null)."""
    per = course_results(crawl_log)
    sums = ["downloaded", "skipped", "skipped_video", "pages_saved", "errors"]
    return (per.rollup("course_id").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count_if(F.col("status").isin("success", "up_to_date", "partial")).alias("synced_courses"),
        F.sum(F.when(F.col("status") == "partial", F.col("errors")).otherwise(0)).alias("partial_errors"),
        F.count_if(F.col("status") == "error").alias("fatal_course_failures"),
        F.when(F.grouping("course_id") == 0, F.max("status")).otherwise("batch").alias("status")))


def resource_failures(crawl_log: DataFrame, order: str = "seq", n: int | None = None) -> DataFrame:
    """Failed resources per course in order of ``order``, numbered and redacted;
    all of them, or the first ``n`` of a course for a report."""
    failed = crawl_log.filter((F.col("status") == "error") & (F.coalesce("context", F.lit("")) != "course"))
    first = (scale.numbered(failed, ["course_id"], [F.col(order)], "failure_no") if n is None
             else scale.first_rows(failed, ["course_id"], [F.col(order)], n, "failure_no"))
    last_part = F.regexp_replace(F.substring_index(F.coalesce("context", F.lit("")), " > ", -1), r"\Asection:", "")
    title = redact_text(last_part, "crawl")
    reason = F.coalesce(F.nullif("error", F.lit("")), F.lit(V.FAILURE_REASON_DEFAULT))
    return first.select(
        "course_id", "failure_no",
        F.when(title == "", V.FAILURE_TITLE_DEFAULT).otherwise(title).alias("title"),
        safe_source("source").alias("source"),
        redact_text(reason, "crawl").alias("reason"))
