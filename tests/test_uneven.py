"""Work that one key or one folder for each row would stretch."""
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from bindings import ORACLES, QUERIES, scan
from studycorpus.operators import catalog
from studycorpus.plans import scale


def test_scanned_files_share_the_folders_of_courses(spark):
    base = scale.shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/files-*"))
    assert QUERIES["scan_files"](spark, "/root/testdata/sf0.001").count() == 200
    (root,) = set(glob.glob(f"{base}/files-*")) - before
    folders = [d for d, _, _ in os.walk(root)]
    assert len(glob.glob(f"{root}/*/*.txt")) == 200 and len(folders) <= 22       # the root, its courses, no folder a document


def test_candidates_of_one_key_are_spread(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PAIRS_PER_SALT", 500, raising=False)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        matches = spark.range(400).select(F.col("id").alias("course_id"), F.lit("matched").alias("status"), F.when(F.col("id") < 390, "code").alias("match_on"),
                                          F.when(F.col("id") < 380, "CO100").when(F.col("id") < 390, "CO200").alias("match_value"),
                                          F.when(F.col("id") < 390, 30).otherwise(0).alias("n_candidates"))
        candidates = spark.range(60).select(F.when(F.col("id") < 30, "CO100").otherwise("CO200").alias("code"), F.concat(F.lit("n"), "id").alias("name_key"))
        got = catalog.matched_candidates(matches, candidates)
        sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 390 * 30 and max(sizes) < 6000
        assert got.select("course_id", "name_key").distinct().count() == 390 * 30
        assert set(got.columns) == {"course_id", "status", "match_on", "match_value", "code", "name_key"}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_links_of_all_scopes_are_kept_once(spark, monkeypatch):
    from studycorpus.operators import crawl
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("c", "d"), ("d", "e")] + [("b", f"h{i}") for i in range(40)]
    plain = spark.createDataFrame(edges, "src string, dst string")
    scoped = plain.withColumn("scope", F.explode(F.array(F.lit("s"), F.lit("t"))))
    seeds = spark.createDataFrame([("s", "a"), ("t", "x")], "scope string, node string")
    closed = spark.createDataFrame([("t", "c")], "scope string, node string")
    monkeypatch.setattr(scale, "HEAVY_MIN_ROWS", 20)
    got = sorted(map(tuple, crawl.reachable(plain, seeds, None, closed).collect()))
    assert ("s", "d", 3, "reached") in got and not {"a", "d"} & {node for scope, node, _, _ in got if scope == "t"}
    assert got == sorted(map(tuple, crawl.reachable(scoped, seeds, None, closed).collect()))


@pytest.mark.parametrize("at_once", [250_000, 100])
def test_planted_files_are_one_each_and_scanned_together(spark, tmp_path, monkeypatch, at_once):
    """Names that need quoting, one plain file a document, far fewer tasks than files, and lists in parts."""
    monkeypatch.setattr(scan, "LISTED_AT_ONCE", at_once, raising=False)
    con, written, write = duckdb.connect(), [], scale.checkpointed
    con.execute(f"""copy (select i as doc_id, case i % 5 when 0 then 'a/b %41+c' when 1 then '' when 2 then null when 3 then 'ü = ".' else 'plain' end as source,
      repeat('wort ü ', i % 7) as text from (select unnest(range(-3, 397)) as i) union all select 5, 'plain', 'the same number') to '{tmp_path}/documents.parquet'""")
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet'")

    def noted(df):
        written.append(df.rdd.getNumPartitions())
        return write(df)

    monkeypatch.setattr(scale, "checkpointed", noted)
    base = scale.shared_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{base}/files-*"))
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    got = QUERIES["scan_files"](spark, str(tmp_path)).select("course_id", "doc_id", "ext", "size", "sha256")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(ORACLES["scan_files"]).fetchall()) and got.count() == 401
    (root,) = set(glob.glob(f"{base}/files-*")) - before
    assert sum(len(names) for _, _, names in os.walk(root)) == 401        # no checksum beside a file
    assert len(written) == (2 if at_once > 401 else 5) and max(written[1:]) <= 10 and spark.conf.get("spark.sql.files.openCostInBytes") == cost
