"""Removal of credentials, sessions, query strings and local paths."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import fixed_values as V
from ..functions.text import col

PROFILES = {"log": V.REDACT_LOG, "crawl": V.REDACT_CRAWL, "pipeline": V.REDACT_PIPELINE, "path": V.REDACT_PATH}


def _prepared(c: Column, profile: str) -> Column:
    c = F.coalesce(c, F.lit(""))
    if profile != "path":
        return c
    c = F.replace(c, F.lit("\\"), F.lit("/"))
    return F.substring_index(F.substring_index(c, "?", 1), "#", 1)


def redact_text(c, profile: str) -> Column:
    out = _prepared(col(c), profile)
    for pattern, replacement in PROFILES[profile]:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def redact(df: DataFrame, cols: list[str], profile: str = "log") -> DataFrame:
    """Redact columns in place and add ``<col>_hits``: matches per rule, in order.

    Nothing is shortened; a report that wants a short text cuts it itself."""
    out = df
    for c in cols:
        step = _prepared(F.col(c), profile)
        hits = []
        for pattern, replacement in PROFILES[profile]:
            hits.append(F.regexp_count(step, F.lit(pattern)))
            step = F.regexp_replace(step, pattern, replacement)
        out = out.withColumn(f"{c}_hits", F.array(*hits)).withColumn(c, step)
    return out


def safe_source(c) -> Column:
    """Scheme, host and path of a link; other values lose query and fragment."""
    v = F.coalesce(col(c), F.lit(""))
    pattern, replacement = V.REDACT_CRAWL[0]
    plain = F.substring_index(F.substring_index(v, "?", 1), "#", 1)
    return F.when(v.rlike(r"(?i)\Ahttps?://[^/?#]"), F.regexp_replace(v, pattern, replacement)).otherwise(plain)
