"""The operators on the driver's tables: one query each, with its SQL twin where SQL can say it."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bindings.base import ship
import public_tokenizers

from studycorpus.llm import bpe, counts, exact, idfile, leaks, mix, near, parallel, periods, pii, quality, repeats, vectors
from studycorpus.llm.base import crc32_mod4

ACCEPT = 0.7         # score from which a document counts as good
QUERIES = {}
ORACLES = {}
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


EXACT_SQL = r"""
with d as (select doc_id, length(coalesce(text, '')) as n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256 from documents),
w as (select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id nulls last) as keep_id,
    count(*) over (partition by text_sha256) as group_size from d)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, text_sha256 from w"""


@query("op4_exact_dedup", EXACT_SQL)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(documents(spark, sf_dir), VOCABULARY)


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), VOCABULARY)


@query("op9_token_files")
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.roundtrip(documents(spark, sf_dir), VOCABULARY, end_id=1)


@query("op7_mix_sources")
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix.plan_mix(documents(spark, sf_dir))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "taken_1", "taken_2")


@query("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(documents(spark, sf_dir))


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Model:
    """Fitted on labels whose crc32 of the id leaves no 2 when divided by 4; the rest is held out."""
    return quality.fit(docs, labels, crc32_mod4() != 2)


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (crc32_mod4() == 2).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


NEAR_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
reps as (select ws, min(doc_id) as rep from w group by ws),
s as (select rep, case when len(ws) < 5 then [array_to_string(ws, ' ')]
        else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end as ss from reps where len(ws) > 0),
c as (select rep, g, count(*) as n from (select rep, unnest(ss) as g from s) group by rep, g),
t as (select rep, len(ss) as total from s),
p as (select a.rep as a, b.rep as b, sum(least(a.n, b.n)) as common from c a join c b on a.g = b.g and a.rep < b.rep group by a.rep, b.rep),
l as (select a, b from p join t x on x.rep = a join t y on y.rep = b where common * 5 >= (x.total + y.total - common) * 4),
e as (select a, b from l union all select b, a from l),
r(a, b) as (select a, b from e union select r.a, e.b from r join e on r.b = e.a),
k as (select a, min(b) as m from r group by a)
select w.doc_id, case when len(w.ws) = 0 then w.doc_id else least(coalesce(k.m, reps.rep), reps.rep) end as class_id,
  case when len(w.ws) = 0 then w.doc_id else reps.rep end as copy_of,
  w.doc_id = case when len(w.ws) = 0 then w.doc_id else least(coalesce(k.m, reps.rep), reps.rep) end as kept
from w join reps on reps.ws = w.ws left join k on k.a = reps.rep"""


@query("op1_near_duplicates", NEAR_SQL)
def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir))


VECTOR_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
u as (select vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as norm from v),
l as (select a.vec_id as a, b.vec_id as b from u a join u b on a.vec_id <> b.vec_id and a.norm > 0 and b.norm > 0
  where list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a),
k as (select a, min(b) as m from r group by a), n as (select a, count(*) as n from l group by a)
select x.vec_id, coalesce(n.n, 0)::bigint as n_links, least(x.vec_id, coalesce(k.m, x.vec_id)) as component_id,
  x.vec_id = least(x.vec_id, coalesce(k.m, x.vec_id)) as kept
from embeddings x left join n on n.a = x.vec_id left join k on k.a = x.vec_id"""


@query("op2_near_vectors", VECTOR_SQL)
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op3_repeats")
def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(documents(spark, sf_dir))


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: in one of ten documents the words from place a on repeat with a period.
    With h the crc32 of the id, 0 modulo 10, g = h div 10 and n words: a = g mod n, period
    1 + (n - a) div (3 + g mod 8). Rows without id or words are left alone."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("planted", F.coalesce(F.col("h") % 10 == 0, F.lit(False)))
    rows = rows.withColumn("ws", F.when(F.col("planted"), F.split(F.regexp_replace("text", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")).otherwise(F.array()))
    rows = rows.withColumn("n", F.when(F.get("ws", 0) == "", 0).otherwise(F.size("ws"))).withColumn("g", F.expr("h div 10"))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % greatest(n, 1) as int)")))
    rows = rows.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    words = F.expr("transform(sequence(0, n - 1), i -> get(ws, if(i < a, i, a + (i - a) % p)))")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digests(periods.periodic_runs(with_planted_runs(documents(spark, sf_dir))))


LEAK_SQL = r"""
with low as (select *, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
d as (select row_number() over () as r, doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from low),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
i as (select item, ws, least(len(ws), 10) as t from b where len(ws) > 0),
w as (select distinct item, t, array_to_string(ws[k:k + t - 1], ' ') as w from (select *, unnest(range(1, len(ws) - t + 2)) as k from i)),
x as (select r, t, k, array_to_string(ws[k:k + t - 1], ' ') as w
  from (select r, t, ws, unnest(range(1, len(ws) - t + 2)) as k from d, (select distinct t from i) where len(ws) >= t)),
m as (select x.r, x.k, x.t, w.item from x join w on x.w = w.w and x.t = w.t),
h as (select r, count(distinct p) as n from (select r, unnest(range(k, k + t)) as p from (select distinct r, k, t from m)) group by r),
n as (select r, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct r, item from m) group by r)
select doc_id, len(ws)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(n.n, 0)::bigint as n_items,
  sha256(coalesce(n.items, '')) as items_sha256, h.n is not null as contaminated
from d left join h on h.r = d.r left join n on n.r = d.r"""


@query("op12_contamination", LEAK_SQL)
def op12_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), "contaminated")


@query("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return parallel.alignment(documents(spark, sf_dir), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"),
                              ranks_path=path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
