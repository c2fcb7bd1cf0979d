"""Columns of the caller keep their values, whatever names they have."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from studycorpus.llm import bpe, exact, mix, near, pii, queries, quality
from studycorpus.llm.base import free_names

NAMES = ["_sha", "_maybe", "_n", "_rn", "_rank", "_gone", "_id", "_source", "_hash", "_size", "_parts", "_0", "_1", "_text", "__text", "__spans", "_spans",
         "_score", "_SHA", "id", "key", "text_", "hash of the text", "old text"]
CLASHING = [n for n in NAMES if n != "_SHA"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "twice the same words over and over again" if i < 4 else f"words {i} of text number {i} and more of it " * 4, "en", f"s{i % 3}", 40)
            for i in range(30)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return table.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in CLASHING]).cache()


@pytest.fixture(scope="module")
def model(docs):
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    return queries.quality_model(docs, labels)


STAGES = {
    "exact": exact.drop_exact_copies,
    "near": near.drop_near_duplicates,
    "mix": mix.mixed,
    "bpe": lambda d: bpe.encode(d, queries.VOCABULARY),
    "pii": pii.detect,
    "masked": pii.masked,
}


def check(docs, out):
    assert out.columns[:len(docs.columns)] == docs.columns
    rows = out.collect()
    assert rows
    for r in rows:
        for n in CLASHING:
            assert r[n] == f"{n} {r.doc_id}", n


@pytest.mark.parametrize("stage", STAGES)
def test_names(docs, stage):
    check(docs, STAGES[stage](docs))


def test_quality(docs, model):
    check(docs, quality.score(docs, model))


def test_pipeline_stage(docs, spark, tmp_path):
    docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    check(docs, corpus_pipeline.by_quality(spark, docs, str(tmp_path)))


def test_free_names():
    assert free_names(["A", "b_"], "a", "b", "a") == ["a_", "b", "a__"]


def test_small_sources_take_their_target(spark):
    rows = [(i, "w " * (i + 1), f"tiny{i}") for i in range(7)] + [(100 + i, "many words here " * 50, "big") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix.plan_mix(docs).groupBy("source_name").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.first("source_size").alias("s")).collect()
    assert all(abs(r.t - r.n) <= 1 and r.n <= 2 * r.s for r in got)
    assert all(r.n > 0 for r in got)
