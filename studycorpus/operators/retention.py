"""Which originals stay in a corpus, and the size budget."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V
from ..plans import scale

EVIDENCE = ["page_count", "text_pages", "zero_text_pages", "low_text_pages", "image_pages", "drawing_pages"]


def retention_decisions(sources: DataFrame, representatives: DataFrame, conversions: DataFrame,
                        evidence: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """Decision per source, in this order: verified duplicate, verified
    conversion, text says everything.

    ``sources``: course_id, source_id, source_type, copy_ext, size, cost, has_output.
    ``conversions``: course_id, source_id, verdict, converted_cost. ``evidence``: what
    ``page_evidence`` gives, course_id included. Missing
    evidence never drops anything.
    """
    key = ["course_id", "source_id"]
    dup = representatives.select(*key, "represented_by", F.lit(True).alias("_dup"), "text_similarity")
    fully = representatives.select("course_id", F.col("represented_by").alias("source_id"),
                                   F.lit(True).alias("_stands_in"))
    conv = conversions.select(*key, "verdict", "converted_cost").withColumnRenamed("verdict", "_cv")
    proof = evidence.select(*key, F.col("verdict").alias("_ev"), F.struct(*EVIDENCE).alias("evidence"))
    rows = (sources.join(dup, key, "left").join(fully.distinct(), key, "left")
                   .join(conv, key, "left").join(proof, key, "left"))
    saving = F.col("cost") - F.col("converted_cost")
    converts = ((F.col("copy_ext") == ".pptx") & F.col("_stands_in").isNull()
                & (F.col("size") >= V.CONVERSION_MIN_SOURCE) & (F.col("_cv") == "FULL_EQUIVALENCE")
                & (saving >= V.CONVERSION_MIN_SAVING)
                & (saving / F.greatest(F.lit(1), F.col("cost")) >= V.CONVERSION_MIN_RATIO))
    texty = (F.col("copy_ext") == ".pdf") & (F.col("source_type") == "lecture_pdf") & F.col("has_output") & (
        F.col("_ev") == "TEXT_DOMINANT")
    decision = (F.when(F.col("_dup"), "OMIT_VERIFIED_DUPLICATE")
                 .when(F.coalesce(converts, F.lit(False)), "REPLACE_WITH_VERIFIED_PDF")
                 .when(F.coalesce(texty, F.lit(False)), "MARKDOWN_SUFFICIENT"))
    new = (rows.withColumn("decision", decision).filter(F.col("decision").isNotNull())
               .select(*key, "decision", "represented_by", "text_similarity",
                       F.when(F.col("decision") == "MARKDOWN_SUFFICIENT", F.col("evidence")).alias("evidence")))
    return new if prior is None else merge_decisions(prior, new)


def merge_decisions(prior: DataFrame, new: DataFrame) -> DataFrame:
    """Earlier decisions survive, new ones are added."""
    return prior.unionByName(new, allowMissingColumns=True)


def size_budget(retained: DataFrame, totals: DataFrame, target: int = V.TARGET_BYTES) -> DataFrame:
    """Drop the costliest originals while the projected size is above the target.

    ``retained``: course_id, source_id, cost, verdict. ``totals``: course_id, total.
    A source is dropped when what the costlier ones free is not yet enough.
    """
    order = [F.col("cost").desc(), F.col("source_id")]
    freed = scale.running(retained, ["course_id"], order, {"_freed": F.col("cost").cast("long")})
    rows = scale.lookup_join(freed, totals.select("course_id", "total"), ["course_id"], how="inner")
    dropped = rows.filter(F.col("total") - (F.col("_freed") - F.col("cost")) > target)
    reason = F.when(F.col("verdict") == "TEXT_DOMINANT", "OMIT_BINARY_SIZE_BUDGET").otherwise(
        "OMIT_VISUAL_BINARY_SIZE_BUDGET")
    return dropped.select("course_id", "source_id", "cost", reason.alias("decision"),
                          (F.col("total") - F.col("_freed")).alias("projected_size"))
