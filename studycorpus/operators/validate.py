"""Corpus validation: one query per rule, severities from one table."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V, text as T
from ..plans import scale
from . import reports

SEVERITY = {
    "chunk_without_source": "error", "chunk_missing_source": "error", "chunk_without_locator": "error",
    "ready_without_output": "error", "chunk_path_missing": "error", "copy_not_retained": "error",
    "absolute_path": "error", "unsafe_inventory_path": "error", "coverage_omits_source": "error",
    "chapter_rollup_missing": "error", "chapter_rollup_empty": "error", "metric_differs": "error",
    "exam_source_missing": "error", "cache_path_leaked": "error", "not_viable": "error",
    "source_errors": "warning", "unsupported_sources": "warning", "visual_without_chapter": "warning",
    "chapter_gap": "warning",
}
METRICS = ["ready_source_count", "chunk_count", "retained_lecturer_source_count", "source_error_count",
           "unsupported_source_count", "meaningful_lecturer_source_count", "viable"]
EXCUSED_BY_TEXT = ("MARKDOWN_SUFFICIENT", "OMIT_BINARY_SIZE_BUDGET", "OMIT_VISUAL_BINARY_SIZE_BUDGET")


def _found(df: DataFrame, rule: str, subject: Column | str) -> DataFrame:
    value = F.col(subject) if isinstance(subject, str) else subject
    return df.select("course_id", F.lit(SEVERITY[rule]).alias("severity"), F.lit(rule).alias("rule"),
                     F.coalesce(value.cast("string"), F.lit("")).alias("subject"))


def _claim(rule: str, bad: Column, subject: Column | str, *refs: tuple[str, Column]) -> Column:
    """What one row says under a rule: nothing where ``bad`` does not hold, a finding where there are no
    ``refs``, else a finding unless one of the things that ``refs`` name (kind, key) exists."""
    subject = F.col(subject) if isinstance(subject, str) else subject
    listed = [F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key")) for kind, key in refs]
    none = F.array().cast("array<struct<kind:string,key:string>>")
    return F.when(bad, F.struct(F.lit(rule).alias("rule"), F.coalesce(subject.cast("string"), F.lit("")).alias("subject"),
                                (F.filter(F.array(*listed), lambda r: F.coalesce(r["key"], F.lit("")) != "") if refs else none).alias("refs")))


def _claims(df: DataFrame, claims: list[Column]) -> DataFrame:
    """All claims of a table's rows, in one pass over it: ``course_id, rule, subject, refs``."""
    each = F.explode(F.filter(F.array(*claims), lambda c: c.isNotNull()))
    return df.select("course_id", each.alias("c")).select("course_id", "c.rule", "c.subject", "c.refs")


def _unmet(claims: DataFrame, things: DataFrame) -> DataFrame:
    """Findings: claims none of whose references exist. ``things``: course_id, kind, key.

    One anti join for all rules. A claim counts how many of its references are missing, and is
    a finding if all are; claims without a reference go round the join.
    """
    numbered = scale.checkpointed(claims.withColumn("claim", F.monotonically_increasing_id()))
    sure, open_ = numbered.filter(F.size("refs") == 0), numbered.filter(F.size("refs") > 0)
    rows = open_.select("course_id", "rule", "subject", "claim", F.size("refs").alias("of"), F.explode("refs").alias("r")).select("*", "r.kind", "r.key")
    missing = rows.join(things, ["course_id", "kind", "key"], "left_anti")
    # most claims have one reference; only the others are counted
    several = (missing.filter("of > 1").groupBy("course_id", "rule", "subject", "claim", "of").count().filter(F.col("count") == F.col("of")))
    parts = [t.select("course_id", "rule", "subject") for t in (sure, missing.filter("of = 1"), several)]
    severity = reduce(lambda other, r: F.when(F.col("rule") == r[0], r[1]).otherwise(other), SEVERITY.items(), F.lit("error"))
    return reduce(DataFrame.unionByName, parts).select("course_id", severity.alias("severity"), "rule", "subject")


def _any_absolute(df: DataFrame, *cols: str) -> Column:
    return reduce(lambda a, b: a | b, [T.is_absolute(c) for c in cols if c in df.columns])


def validate_corpus(records: DataFrame, chunks: DataFrame, stored: DataFrame, *, visuals: DataFrame | None = None,
                    unsupported: DataFrame | None = None, coverage: DataFrame | None = None,
                    rollups: DataFrame | None = None, metrics: DataFrame | None = None,
                    exams: DataFrame | None = None) -> DataFrame:
    """Findings as (course_id, severity, rule, subject).

    ``stored`` lists what a package really holds (course_id, path). The other
    tables are optional; a rule whose table is missing is not checked.

    Each table is passed over once: its rows make claims under all rules that look at it, and
    those that refer to something (a source, a stored path, a listed subject, a rollup)
    are settled by one join with everything that exists.
    """
    key = ["course_id", "source_id"]
    # every table is read once: texts become a mark whether they are blank
    kept = [c for c in ("course_id", "source_id", "chunk_id", "chunk_path", "source_path", "locator") if c in chunks.columns]
    chunks = scale.checkpointed(chunks.select(*kept, F.when(T.strip("text") != "", "x").otherwise("").alias("text")))
    records = scale.checkpointed(records)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    things = [stored.select("course_id", F.lit("path").alias("kind"), F.col("path").alias("key")),
              records.select("course_id", F.lit("source").alias("kind"), F.col("source_id").alias("key"))]
    claims = [
        _claims(chunks, [
            _claim("chunk_without_source", blank("source_id"), "chunk_id"),
            _claim("chunk_without_locator", blank("locator"), "chunk_id"),
            _claim("absolute_path", _any_absolute(chunks, "source_path", "chunk_path"), "chunk_id"),
            _claim("chunk_path_missing", ~blank("chunk_path"), "chunk_path", ("path", F.col("chunk_path")))]),
        # the chunks of one source give one finding
        _claims(chunks.filter(~blank("source_id")).select(*key).distinct(), [
            _claim("chunk_missing_source", F.lit(True), "source_id", ("source", F.col("source_id")))])]

    ready = F.col("status") == "ready"
    visual = F.col("source_type").isin(*V.VISUAL_TYPES)
    decision = F.col("retention_decision")
    # visual originals: kept, represented by a known source, or excused by their text
    originals = [("path", F.col("source_copy_path")), ("source", F.when(decision == "OMIT_VERIFIED_DUPLICATE", F.col("represented_by_source_id"))),
                 ("path", F.when(decision.isin(*EXCUSED_BY_TEXT), F.col("output_path")))]
    of_records = [
        _claim("absolute_path", _any_absolute(records, "source_path", "output_path", "source_copy_path"), "source_id"),
        _claim("visual_without_chapter", visual & (F.size(reports.real_chapters()) == 0), "source_path"),
        _claim("ready_without_output", ready, "source_path", ("path", F.col("output_path"))),
        _claim("copy_not_retained", visual & F.col("status").isin("ready", "visual_only"), "source_path", *originals)]
    if coverage is not None:
        things.append(coverage.select("course_id", F.lit("covered").alias("kind"), F.col("subject").alias("key")))
        of_records.append(_claim("coverage_omits_source", F.col("status").isin("error", "link_only"), "source_path", ("covered", F.col("source_path"))))
    claims.append(_claims(records, of_records))
    if unsupported is not None:
        claims.append(_claims(unsupported, [_claim("unsafe_inventory_path", T.is_absolute("path") | T.has_parent_step("path"), "path")]))
    if rollups is not None:
        sizes = scale.checkpointed(rollups.groupBy("course_id", "group").agg(F.max(F.length(T.strip("text"))).alias("_len")))
        things.append(sizes.select("course_id", F.lit("rollup").alias("kind"), F.col("group").alias("key")))
        need = records.filter(ready).select("course_id", reports.study_group().alias("group")).filter(F.col("group").startswith("chapter_")).distinct()
        claims.append(_claims(need, [_claim("chapter_rollup_missing", F.lit(True), "group", ("rollup", F.col("group")))]))
        empty = need.join(sizes.filter("_len = 0"), ["course_id", "group"], "left_semi")      # a row for each chapter of a course
        claims.append(_claims(empty, [_claim("chapter_rollup_empty", F.lit(True), "group")]))
    if exams is not None:
        claims.append(_claims(exams, [
            _claim("exam_source_missing", ~blank("retained_source_path") & ~F.coalesce(T.is_absolute("retained_source_path"), F.lit(False)),
                   "retained_source_path", ("path", F.col("retained_source_path"))),
            _claim("cache_path_leaked", ~blank("cache_path"), "stable_id"),
            _claim("absolute_path", T.is_absolute("retained_source_path"), "stable_id")]))
    found = [_unmet(reduce(DataFrame.unionByName, claims), reduce(DataFrame.unionByName, things))]

    measured = scale.checkpointed(reports.source_metrics(records, chunks, visuals))
    if metrics is not None:
        wide = measured.join(metrics.select("course_id", *[F.col(m).alias(f"_s_{m}") for m in METRICS]), "course_id")
        differs = F.explode(F.filter(F.array(*[F.when(~F.col(m).eqNullSafe(F.col(f"_s_{m}")), F.lit(m)) for m in METRICS]),
                                     lambda x: x.isNotNull()))
        found.append(_found(wide.select("course_id", differs.alias("metric")), "metric_differs", "metric"))
    found.append(_found(measured.filter(~F.col("viable")), "not_viable", F.lit("")))
    found.append(_found(measured.filter(F.col("source_error_count") > 0), "source_errors", "source_error_count"))
    found.append(_found(measured.filter(F.col("unsupported_source_count") > 0), "unsupported_sources",
                        "unsupported_source_count"))
    found.append(_found(reports.chapter_gaps(records), "chapter_gap", "chapter"))
    return reduce(DataFrame.unionByName, found)
