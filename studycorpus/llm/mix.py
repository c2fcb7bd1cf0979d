"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

1. A source's target is its share of the wanted total by weight, at most ``epochs`` times
   its size; what is cut off is shared again by weight among the others.
2. The total is cut into blocks of ``BLOCK`` words, fewer if a target is less; the last block
   of a source and of a shard may be a part of one. Sources get whole blocks by the highest
   quotients target / (2 blocks + 1), which is the Sainte-Lague rule.
3. A source is dealt over shards by a seeded hash, and its blocks are apportioned to the
   shards by the same rule on the shards' sizes.
4. Inside a shard the seed orders the documents; their words, laid end to end ``epochs``
   times, form the blocks. The shard takes its quota of blocks in that order, so each
   document is taken whole, several times or not at all, but for the one at the end.

Only sums per source and per shard are gathered: at most ``MAX_SHARDS`` rows a source.
A shard holds about ``SHARD_WORDS`` words, more only where a source has over
``MAX_SHARDS`` shards; its documents pass one task as rows of a few numbers.
"""
from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from studycorpus.llm.base import checkpointed, free_names, portions, text_of

BLOCK = 16
SHARD_WORDS = 1 << 16
MAX_SHARDS = 4096
MAX_SOURCES = 100_000
#: The weights of the sources in order, repeating (fixed by the definition of the mix).
WEIGHTS = (3, 1, 2)
#: A word: anything between blanks and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def shared_targets(sizes: Sequence[int], weights: Sequence[float], total: float, epochs: int) -> list[float]:
    """``total`` shared by weight, none above ``epochs`` times its size. The sources whose
    bound binds are those with the least bound per weight, so one pass in that order does."""
    bounds = [float(epochs * s) for s in sizes]
    out, left, weight = [0.0] * len(sizes), float(total), float(sum(weights))
    for i in sorted(range(len(sizes)), key=lambda i: bounds[i] / weights[i]):
        out[i] = min(bounds[i], left * weights[i] / weight) if weight > 0 else 0.0
        left, weight = left - out[i], weight - weights[i]
    return out


def sainte_lague(votes: Sequence[float], seats: int, most: Sequence[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2 seats + 1), nobody above ``most``; ties go to the first.

    The seats that everybody gets at a slightly too high price are given at once, the rest
    one by one: the rule never takes a seat back when the house grows.
    """
    votes = np.asarray(votes, dtype=float)
    bound = np.full(len(votes), seats) if most is None else np.asarray(most, dtype=np.int64)
    if not len(votes) or votes.sum() <= 0 or seats <= 0:
        return [0] * len(votes)
    bound = np.where(votes > 0, bound, 0)
    price = votes.sum() / seats
    while True:                                    # seats with a quotient above price / 2 are safe
        safe = np.minimum(np.ceil(votes / price - 0.5).astype(np.int64).clip(0), bound)
        if safe.sum() <= seats:
            break
        price *= 1 + max(1e-9, (safe.sum() - seats) / max(seats, 1))
    got = safe.tolist()
    heap = [(-votes[i] / (2 * got[i] + 1), i) for i in range(len(got)) if got[i] < bound[i]]
    heapq.heapify(heap)
    for _ in range(seats - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < bound[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _keyed(rows: DataFrame, by_source: DataFrame, seed: int) -> DataFrame:
    """Rows ``id, source, h`` with the place of their source and shard, and their order in it."""
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    return (rows.withColumn("key", key).join(F.broadcast(by_source.withColumn("key", key).drop("source")), "key").drop("key")
                .withColumn("order", F.xxhash64(F.lit(seed), "id", "h"))
                .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "h"), F.col("shards"))))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, share: float, epochs: int, weights: Sequence[float],
            seed: int) -> tuple[DataFrame, DataFrame]:
    """``(rows, by_source)``: narrow rows of the documents with their place in their shard (``at``: the words
    before them, ``words``: all of the shard) and ``end``, where the shard's quota ends."""
    spark = docs.sparkSession
    text = text_of(text_col)
    narrow = checkpointed(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                                      F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("h")))
    sums = narrow.groupBy("source").agg(F.sum("size").alias("s")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sums.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    sizes = [r["s"] for r in sums]
    targets = shared_targets(sizes, [weights[i % len(weights)] for i in range(len(sums))], share * sum(sizes), epochs)
    # blocks are smaller where a target is, so that no source is too small for one
    block = max(1, min([BLOCK, *(int(t) for t in targets if t > 0)]))
    blocks = sainte_lague(targets, round(sum(targets) / block), [-(-epochs * s // block) for s in sizes])
    plan = [(i, r["source"], sizes[i], targets[i], blocks[i], min(MAX_SHARDS, max(1, -(-sizes[i] // SHARD_WORDS)))) for i, r in enumerate(sums)]
    by_source = spark.createDataFrame(plan, "source_no int, source string, source_size long, target double, blocks long, shards long")

    keyed = _keyed(narrow, by_source, seed)
    shard_sums = keyed.groupBy("source_no", "shard", "blocks").agg(F.sum("size").alias("words"))

    def apportion(key, table):
        rows = sorted(zip(table.column("shard").to_pylist(), table.column("words").to_pylist()))
        quota = sainte_lague([w for _, w in rows], table.column("blocks")[0].as_py(), [-(-epochs * w // block) for _, w in rows])
        return pa.table({"no": pa.array([key[0].as_py()] * len(rows), pa.int32()), "sh": pa.array([s for s, _ in rows], pa.int64()),
                         "words": pa.array([w for _, w in rows], pa.int64()), "quota": pa.array(quota, pa.int64())})

    quotas = shard_sums.groupBy("source_no").applyInArrow(apportion, "no int, sh long, words long, quota long")
    before = W.partitionBy("source_no", "shard").orderBy("order", "id", "h").rowsBetween(W.unboundedPreceding, -1)
    placed = keyed.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)))
    # the last block of a shard may be a part of one
    joined = placed.join(quotas, (F.col("source_no") == F.col("no")) & (F.col("shard") == F.col("sh"))).withColumn("end", F.col("quota") * block)
    return joined, by_source


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5,
             epochs: int = 2, weights: Sequence[float] = WEIGHTS, seed: int = 17) -> DataFrame:
    """One row per document: ``id_col``, ``size``, ``source_size``, ``target`` (of its source), ``taken``, and ``taken_1`` to ``taken_<epochs>``.

    Sources by code point, null last, have the given weights in turn. ``taken`` is the
    number of words that the mix takes, repeats counted: ``taken_k`` of the document's
    first words in pass k. Documents without words take nothing. A table without words has
    targets of 0. The same rows give the same result in any order; rows that agree in id,
    source and text are ordered alike, so it does not matter which comes first. More than
    ``MAX_SOURCES`` sources are an error, for their sums are planned on the driver.
    """
    joined, _ = _placed(docs, id_col, text_col, source_col, share, epochs, weights, seed)
    passes = [F.least(F.col("size"), F.greatest(F.lit(0), F.col("end") - F.col("words") * k - F.col("at"))).cast("long") for k in range(epochs)]
    out = joined.select(F.col("id").alias(id_col), "size", "source_size", "target", *[p.alias(f"taken_{k + 1}") for k, p in enumerate(passes)],
                        F.col("h").alias("text_hash"), F.col("source").alias("source_name"))
    return out.withColumn("taken", sum((F.col(f"taken_{k + 1}") for k in range(1, epochs)), F.col("taken_1")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str | None = "n_chars",
          share: float = 1.5, epochs: int = 2, weights: Sequence[float] = WEIGHTS, seed: int = 17) -> DataFrame:
    """The documents of the mix, with their columns: a row for each pass that takes words of one.

    A row holds the first ``taken_k`` words with the white space between them; a document
    that is taken whole keeps its text as it is. ``length_col``, if the table has it, is set
    to the new number of characters. Rows that agree in id, source and text are one document
    here, with the words of one of them. Columns may have any names.

    What each pass takes of a shard ends at one document of its order. Only these ends, a row
    for each shard, meet the documents, which decide where they are read: no text moves, as long
    as Spark can broadcast the ends (a row for 65,536 words).
    """
    placed, by_source = _placed(docs, id_col, text_col, source_col, share, epochs, weights, seed)
    same = W.partitionBy("source_no", "shard", "order", "id", "h")
    firsts = placed.withColumn("at", F.min("at").over(same))
    ends = []
    for k in range(epochs):
        until = F.col("end") - F.col("words") * k
        last = F.struct("order", "id", "h", F.greatest(F.lit(0), until - F.col("at")).cast("long").alias("n"))
        ends.append(F.min(F.when(F.col("at") + F.col("size") > until, last)).alias(f"end_{k}"))
    ends = checkpointed(firsts.groupBy(F.col("source_no").alias("no"), F.col("shard").alias("sh")).agg(*ends))

    columns = docs.columns
    old = [f"old {c}" for c in columns]
    was = dict(zip(columns, old))
    text = F.coalesce(F.col(was[text_col]).cast("string"), F.lit(""))
    rows = docs.toDF(*old).withColumn("h", F.xxhash64(text)).withColumn("id", F.col(was[id_col])).withColumn("source", F.col(was[source_col]))
    rows = _keyed(rows, by_source, seed).join(ends, (F.col("source_no") == F.col("no")) & (F.col("shard") == F.col("sh")))
    place, everything = F.struct("order", "id", "h"), F.lit(-1).cast("long")
    takes = []
    for k in range(epochs):
        end = F.col(f"end_{k}")
        mark = F.struct(end["order"].alias("order"), end["id"].alias("id"), end["h"].alias("h"))
        takes.append(F.when(end.isNull() | (place < mark), everything).when(place == mark, end["n"]).otherwise(F.lit(0)))
    (n,) = free_names(columns, "_n")
    taken = rows.select(*[F.col(f"`{was[c]}`").alias(c) for c in columns], F.explode(F.array(*takes)).alias(n)).filter(F.col(n) != 0)
    # texts without words are never taken
    taken = taken.filter(F.col(f"`{text_col}`").rlike(WORD))
    whole = F.col(n) < 0
    schema = StructType(docs.schema.fields)

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        word, at = re.compile(WORD), columns.index(text_col)
        for batch in portions(batches, at):
            texts = []
            for text, most in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                for k, m in enumerate(word.finditer(text), 1):
                    if k == most:
                        text = text if word.search(text, m.end()) is None else text[:m.end()]
                        break
                texts.append(text)
            cols = [pa.array(texts, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(columns))]
            yield pa.RecordBatch.from_arrays(cols, names=columns)

    part = taken.filter(~whole).mapInArrow(shorten, schema)
    if length_col in columns:
        part = part.withColumn(length_col, F.length(text_col).cast(schema[length_col].dataType))
    return taken.filter(whole).select(*[f"`{c}`" for c in columns]).unionAll(part)
