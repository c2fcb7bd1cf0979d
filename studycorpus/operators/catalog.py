"""Public catalog: fill-down, candidates and conservative matching."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import text as T, urls as U
from ..plans import scale

BUCKET = 4096
PAIRS_PER_SALT = 1_000_000   # pairs of a course and a candidate of one key that a task gets


def fill_down(rows: DataFrame, table: list[str], position: str, cols: list[str]) -> DataFrame:
    """Blank cells take the last non-blank one above in the same table.

    Positions are integers: inside a bucket of rows a window does it, and each
    bucket gets the last value of the buckets before it.
    """
    given = {c: F.nullif(T.clean_line(c), F.lit("")) for c in cols}
    base = rows.withColumn("_b", F.floor(F.col(position) / BUCKET))
    for c in cols:
        base = base.withColumn(f"_g_{c}", given[c])
    ends = base.groupBy(*table, "_b").agg(*[
        F.max_by(f"_g_{c}", F.when(F.col(f"_g_{c}").isNotNull(), F.col(position))).alias(f"_e_{c}") for c in cols])
    before = W.partitionBy(*table).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*table, "_b", *[F.last(f"_e_{c}", True).over(before).alias(f"_c_{c}") for c in cols])
    inside = W.partitionBy(*table, "_b").orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    out = base
    for c in cols:
        out = out.withColumn(f"_g_{c}", F.last(f"_g_{c}", True).over(inside))
    out = out.join(carried, [*table, "_b"])
    for c in cols:
        out = out.withColumn(c, F.coalesce(f"_g_{c}", f"_c_{c}", F.lit("")))
    return out.select(*rows.columns)


def usable_rows(rows: DataFrame) -> DataFrame:
    """Catalog rows with a code or a name, and at least one link."""
    return (rows.withColumn("course_code", T.catalog_code("course_code"))
                .withColumn("course_name", T.clean_line("course_name"))
                .filter(((F.col("course_code") != "") | (F.col("course_name") != "")) & (F.size("material_links") > 0)))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with their candidate key (code, name_key); rows without any are dropped."""
    return (rows.withColumn("code", T.catalog_code("course_code"))
                .withColumn("name_key", T.catalog_name_key("course_name"))
                .filter((F.col("code") != "") | (F.col("name_key") != "")))


def aggregate_candidates(rows: DataFrame) -> DataFrame:
    """One row per (code, name key) with the first name and the value counts.

    Lecturers, categories and links of a candidate are the rows of
    ``candidate_values`` and ``candidate_links``: none of them is collected.
    """
    named = F.when(T.clean_line("course_name") != "", F.struct("tab", "row_no", "course_name"))
    return (keyed(rows).groupBy("code", "name_key")
            .agg(F.coalesce(F.min(named)["course_name"], F.lit("")).alias("course_name"),
                 F.count("*").alias("n_rows"),
                 F.count_distinct(F.nullif("lecturer", F.lit(""))).alias("n_lecturers"),
                 F.count_distinct(F.nullif("category", F.lit(""))).alias("n_categories")))


def candidate_values(rows: DataFrame) -> DataFrame:
    """Distinct lecturers and categories per candidate, long form."""
    values = F.explode(F.array(
        F.struct(F.lit("lecturer").alias("kind"), F.col("lecturer").alias("value")),
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("value"))))
    return (keyed(rows).select("code", "name_key", values.alias("v")).select("code", "name_key", "v.*")
            .filter(F.coalesce("value", F.lit("")) != "").distinct())


def candidate_links(rows: DataFrame) -> DataFrame:
    """Links per candidate; the first link of a material wins."""
    links = (keyed(rows).select("code", "name_key", "tab", "row_no", F.posexplode("material_links").alias("pos", "link"))
             .select("code", "name_key", "tab", "row_no", "pos", "link.url", "link.label")
             .withColumn("material", U.material_key("url")))
    return scale.first_rows(links, ["code", "name_key", "material"],
                            [F.col("tab"), F.col("row_no"), F.col("pos")]).drop("pos")


def match_catalog(courses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decision per course: exact code, else unique exact name, else none.

    ``match_on`` and ``match_value`` lead to the candidates (``matched_candidates``).
    """
    by_code = candidates.filter(F.col("code") != "").groupBy("code").agg(F.count("*").alias("_n_code"))
    by_name = candidates.filter(F.col("name_key") != "").groupBy("name_key").agg(F.count("*").alias("_n_name"))
    keyed_courses = (courses.withColumn("code", F.nullif(T.catalog_code("course_code"), F.lit("")))
                            .withColumn("name_key", F.nullif(T.catalog_name_key("course_name"), F.lit(""))))
    rows = scale.lookup_join(keyed_courses, by_code, ["code"])
    rows = scale.lookup_join(rows, by_name, ["name_key"])
    exact, named = F.col("_n_code").isNotNull(), F.col("_n_name")
    status = (F.when(exact, "matched").when(F.col("name_key").isNull(), "no_match").when(named == 1, "matched")
               .when(named > 1, "ambiguous").otherwise("no_match"))
    reason = (F.when(exact, "exact course code").when(F.col("name_key").isNull(), "no reliable code or name")
               .when(named == 1, "exact course name").when(named > 1, "several courses of this name")
               .when(F.col("code").isNotNull(), "code not in the catalog").otherwise("name not in the catalog"))
    on = F.when(exact, "code").when(named.isNotNull(), "name")
    return rows.withColumn("match_on", on).select(
        *courses.columns, status.alias("status"),
        F.when(exact, "high").when(named == 1, "medium").otherwise("low").alias("confidence"),
        reason.alias("reason"), "match_on",
        F.when(F.col("match_on") == "code", F.col("code")).when(F.col("match_on") == "name", F.col("name_key"))
         .alias("match_value"),
        F.when(exact, F.col("_n_code")).otherwise(F.coalesce(named, F.lit(0))).alias("n_candidates"))


def matched_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates behind each decision; as long as the decisions say.

    A key may lead many courses to many candidates. Its courses are spread over as many salts
    as keep a salt at about ``PAIRS_PER_SALT`` pairs; only its candidates are copied.
    """
    keys = F.explode(F.array(F.struct(F.lit("code").alias("match_on"), F.col("code").alias("match_value")),
                             F.struct(F.lit("name").alias("match_on"), F.col("name_key").alias("match_value"))))
    on = ["match_on", "match_value"]
    wide = candidates.select("code", "name_key", keys.alias("k")).select("code", "name_key", "k.*")
    found = matches.filter(F.col("match_value").isNotNull()).select("course_id", "status", *on, "n_candidates")
    salts = found.groupBy(*on).agg(F.least(F.lit(scale.shuffle_width(matches.sparkSession)), F.ceil(F.sum("n_candidates") / PAIRS_PER_SALT)).cast("int").alias("_salts"))
    many = scale.checkpointed(salts.filter("_salts > 1"))
    lhs = scale.lookup_join(found, many, on).withColumn("_salt", F.pmod(F.xxhash64("course_id"), F.coalesce("_salts", F.lit(1))).cast("int"))
    rhs = scale.lookup_join(wide, many, on).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
    # the rows of the join are many times those that go in, so its tasks are not merged by their input
    lhs = lhs.select("course_id", "status", *on, "_salt").repartition(scale.shuffle_width(matches.sparkSession), *on, "_salt")
    return lhs.join(rhs.drop("_salts"), [*on, "_salt"]).drop("_salt")


def catalog_codes(rows: DataFrame) -> DataFrame:
    """The distinct codes of each tab, as rows."""
    code = F.nullif(T.catalog_code("course_code"), F.lit(""))
    return rows.select("tab", code.alias("code")).filter(F.col("code").isNotNull()).distinct()


def catalog_report(rows: DataFrame) -> DataFrame:
    """Rows and distinct codes per tab."""
    return rows.groupBy("tab").agg(F.count("*").alias("parsed_rows"),
                                   F.count_distinct(F.nullif(T.catalog_code("course_code"), F.lit(""))).alias("n_codes"))
