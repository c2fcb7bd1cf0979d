"""Documents to training tokens in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table; all but the last return the
columns of ``documents``. ``run`` writes each stage's rows as a table in the shared folder
before the next one reads them. Null and empty texts are texts like others (the quality
classifier decides on them); rows without id take part in each stage; rows that are repeated with
their id are one document from the second stage on. All but the last stage keep all columns
of ``documents`` and further ones, whatever their names, with their values.

1. quality: rows that the quality classifier scores below 0.7 go.
2. exact_dedup: of texts that are equal without white space one row stays.
3. near_dedup: one document of each group of near duplicates stays, the smallest id.
4. mix: sources are brought to their target weights; a row for each pass over a document,
   cut where the mix ends inside it.
5. bpe: token ids of each row and the digest of what they decode to.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings.base import ship
from studycorpus.llm import bpe, exact, mix, near, quality
from studycorpus.llm.base import checkpointed, free_names
from studycorpus.llm.queries import ACCEPT, VOCABULARY, quality_model


def by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (name,) = free_names(docs.columns, "_score")
    return quality.score(docs, model, score_col=name).filter(F.col(name) >= ACCEPT).drop(name)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near.drop_near_duplicates(docs)


def by_weight(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mix.mixed(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    # each text goes to the encoder once and does not come back
    encoded = bpe.encode(docs, VOCABULARY, digest_col="decoded_sha256", keep=["doc_id", "lang", "source", "n_chars"])
    return encoded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("quality", by_quality), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("mix", by_weight), ("bpe", to_tokens)]
#: No SQL for a classifier, signatures or an encoder: tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
