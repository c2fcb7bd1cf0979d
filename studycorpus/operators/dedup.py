"""Exact duplicates, first-wins keys, superseded pages and media stubs."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V, text as T
from ..plans import scale


def fingerprints(sources: DataFrame, body: str = "body", placeholder: str | None = None) -> DataFrame:
    """Narrow facts of every source: the body is read once and never shuffled.

    ``placeholder`` names a boolean column that marks bodies which are only a
    notice; these never take part in the duplicate test.
    """
    clean = sources.withColumn("_clean", T.clean_block(body))
    norm = clean.withColumn("_norm", T.norm_compare("_clean"))
    long_enough = F.length("_norm") >= V.DEDUP_MIN_CHARS
    if placeholder:
        long_enough = long_enough & ~F.coalesce(F.col(placeholder), F.lit(False))
    return (norm.withColumn("chars", F.length("_clean"))
                .withColumn("words", T.clean_word_count("_clean"))
                .withColumn("text_key", F.when(long_enough, F.sha1(F.col("_norm"))))
                .drop("_clean", "_norm", body))


def mark_duplicates(facts: DataFrame, scope: str = "course_id") -> DataFrame:
    """Status of each source from its fingerprint.

    The first source of a text in (rank, lower-case path) order is ``ready``. The
    first path of a key comes from a partial aggregate; joining it back salts the
    keys that hold very many copies.
    """
    # the facts are used three times; a narrow table beats reading every body again
    facts = scale.checkpointed(facts)
    order = F.struct(F.col("rank"), F.lower("path").alias("lower_path"), F.col("path"))
    firsts = (facts.filter(F.col("text_key").isNotNull())
                   .groupBy(scope, "text_key")
                   .agg(F.min(order).alias("_first"), F.count("*").alias("_copies"))
                   .filter(F.col("_copies") > 1)
                   .select(scope, "text_key", F.col("_first.path").alias("_first_path"), "_copies"))
    joined = scale.salted_join(facts, firsts, [scope, "text_key"], "_copies")
    copy = F.col("_first_path").isNotNull() & (F.col("_first_path") != F.col("path"))
    return (joined.withColumn("status", F.when(F.col("chars") == 0, "empty").when(copy, "duplicate").otherwise("ready"))
                  .withColumn("duplicate_of", F.when(copy, F.col("_first_path")))
                  .drop("_first_path", "_copies"))


def dedup_exact(sources: DataFrame, body: str = "body", scope: str = "course_id") -> DataFrame:
    """Sources with status ready / duplicate / empty, sizes and note; no body."""
    out = mark_duplicates(fingerprints(sources, body), scope)
    note = F.when(F.col("duplicate_of").isNotNull(), F.concat(F.lit("Duplicate text of "), F.col("duplicate_of")))
    return (out.withColumn("note", F.coalesce(note, F.lit("")))
               .withColumn("chars", F.when(F.col("status") == "empty", 0).otherwise(F.col("chars"))))


def first_wins(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """Keep the first row of every key; ``last`` keeps the last one instead."""
    if last:
        order = [F.col(c).desc() if isinstance(c, str) else c for c in order]
    return scale.first_rows(df, keys, order)


def drop_superseded(files: DataFrame) -> DataFrame:
    """``content.html`` gives way to ``content.txt`` of the same directory."""
    html = T.suffix("path").isin(*V.HTML_EXTS) & F.lower(T.base_name("path")).startswith("content.")
    # only pages carry the join key; the other rows match nothing
    keyed = files.withColumn("_dir", F.when(html, F.coalesce(T.parent_dir("path"), F.lit(""))))
    canonical = (files.filter(T.base_name("path") == V.CONTENT_TEXT_NAME)
                      .select("course_id", F.coalesce(T.parent_dir("path"), F.lit("")).alias("_dir"),
                              F.lit(True).alias("_has_text"))
                      .distinct())
    return (scale.lookup_join(keyed, canonical, ["course_id", "_dir"])
                 .withColumn("status", F.when(F.col("_has_text"), "skipped_html_duplicate"))
                 .drop("_dir", "_has_text"))


def drop_media_stubs(sources: DataFrame, files: DataFrame, body: str = "body") -> DataFrame:
    """Tiny text pages that only wrap a video are marked ``skipped_media_stub``."""
    named = T.base_name(T.parent_dir("path")).rlike(r"(?i)(^|[ _-])video([ _-]|$)")
    facts = (sources.withColumn("words", T.word_count(body)).drop(body)
                    .withColumn("_short", F.col("words") < V.STUB_MAX_WORDS).withColumn("_named", named)
                    .withColumn("_dir", F.when(F.col("_short") & ~F.col("_named"), T.parent_dir("path"))))
    folder = T.parent_dir("path")
    media = (files.filter(T.suffix("path").isin(*V.VIDEO_EXTS, *V.AUDIO_EXTS) & (T.base_name(folder) == "assets"))
                  .select("course_id", T.parent_dir(folder).alias("_dir"), F.lit(True).alias("_media"))
                  .distinct())
    stub = F.col("_short") & (F.col("_named") | F.coalesce(F.col("_media"), F.lit(False)))
    return (scale.lookup_join(facts, media, ["course_id", "_dir"])
                 .withColumn("status", F.when(stub, "skipped_media_stub"))
                 .drop("_short", "_named", "_dir", "_media"))
