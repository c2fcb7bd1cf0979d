"""File name repair and unique target names."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import fixed_values as V, text as T, udfs
from ..plans import scale

_SUSPICIOUS = "|".join(V.MOJIBAKE_MARKERS) + r"|[\x80-\x9f]"


def repaired(name) -> "F.Column":
    """Name with UTF-8 that was read as Latin-1 put right; only suspicious
    names leave the JVM."""
    c = T.col(name)
    hit = F.when(c.rlike(_SUSPICIOUS), c)
    return T.nfc(F.coalesce(udfs.undo_mojibake(hit), c))


def repair_names(df: DataFrame, key: str, name: str = "name", scope: list[str] | None = None) -> DataFrame:
    """Report of the names that change: old name, new unique name.

    ``scope`` are the columns inside which names must be unique (a directory).
    """
    scope = scope or []
    fixed = (df.withColumn("_suspect", F.col(name).rlike(_SUSPICIOUS))
               .withColumn("_fixed", T.safe_name(repaired(name))))
    changed = fixed.filter(F.col("_fixed") != F.col(name))
    # untouched names keep their place: they are taken before any new name
    taken = (fixed.filter(F.col("_fixed") == F.col(name))
                  .select(*scope, F.col(name).alias("_fixed"), F.lit(0).alias("_new"),
                          F.col(key).cast("string").alias("_key")))
    wanted = changed.select(*scope, "_fixed", F.lit(1).alias("_new"), F.col(key).cast("string").alias("_key"))
    named = unique_names(taken.unionByName(wanted), "_key", "_fixed", scope,
                         [F.col("_new"), F.col("_key")])
    new = named.filter(F.col("_new") == 1).select(F.col("_key"), F.col("unique_name").alias("new_name"))
    return (changed.withColumn("_key", F.col(key).cast("string"))
                   .join(new, "_key")
                   .select(*df.columns, "new_name"))


def unique_names(df: DataFrame, source: str, name: str, scope: list[str] | None = None,
                 order: list | None = None) -> DataFrame:
    """Different sources with one target name get `` (2)``, `` (3)`` before the
    suffix; one source keeps one name. Numbers whose name is a real name of the
    same scope are passed over.
    """
    scope = scope or []
    order = order or [F.col(source)]
    first = scale.first_rows(df, [*scope, name, source], order)
    ranked = scale.numbered(first, [*scope, name], [*order, F.col(source)], "_n").select(
        *scope, name, source, F.col("_n").alias("_free"))
    # numbers already used by real names, as "how many free numbers lie before"
    pattern = r"(?s)\A(.*) \((\d{1,9})\)(\.[^.]+)?\z"
    real = (df.select(*scope, F.col(name).alias("_real")).distinct()
              .filter(F.col("_real").rlike(pattern))
              .withColumn("_k", F.regexp_extract("_real", pattern, 2).cast("long"))
              .withColumn(name, F.concat(F.regexp_extract("_real", pattern, 1), F.regexp_extract("_real", pattern, 3)))
              .filter((F.col("_k") >= 2) & (F.concat(F.lit(" ("), F.col("_k"), F.lit(")")) ==
                                          F.regexp_extract("_real", r"( \(\d{1,9}\))(?:\.[^.]+)?\z", 1))))
    extras = ranked.filter(F.col("_free") > 1)
    real = real.join(extras.select(*scope, name).distinct(), [*scope, name], "left_semi")
    gaps = scale.numbered(real.select(*scope, name, "_k"), [*scope, name], [F.col("_k")], "_i").select(
        *scope, name, (F.col("_k") - F.col("_i") - 1).alias("_at"), F.lit(None).cast("string").alias(source),
        F.lit(1).alias("_taken"))
    wanted = extras.select(*scope, name, (F.col("_free") - 1).alias("_at"), F.col(source).cast("string").alias(source),
                           F.lit(0).alias("_taken"))
    # a taken number counts for every wanted place after it: at < wanted place
    merged = scale.running(gaps.unionByName(wanted), [*scope, name],
                           [F.col("_at"), F.col("_taken"), F.coalesce(F.col(source), F.lit(""))],
                           {"_skip": F.col("_taken").cast("long")})
    number = (merged.filter(F.col("_taken") == 0)
                    .select(*scope, name, source, (F.col("_at") + 1 + F.col("_skip")).alias("_no")))
    base, ext = T.stem(name), F.regexp_extract(name, r"[^.](\.[^.]+)\z", 1)
    out = df.withColumn("_src", F.col(source).cast("string")).join(
        number.withColumnRenamed(source, "_src"), [*scope, name, "_src"], "left")
    made = F.concat(base, F.lit(" ("), F.col("_no"), F.lit(")"), ext)
    return out.withColumn("unique_name", F.when(F.col("_no").isNull(), F.col(name)).otherwise(made)).select(
        *df.columns, "unique_name")
