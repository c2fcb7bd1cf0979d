"""Token counts of documents without making token ids.

The pieces of each distinct pre-token are counted once, in its own Spark stage; documents
hold frequencies of pre-tokens and are joined to these counts. Word frequencies are very
uneven, so the join has two parts: at most ``HEAD`` pre-tokens, those in the most
documents, come to the tasks as a broadcast of bounded size and cover nearly every
occurrence; the rest is a shuffle join on narrow rows.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from studycorpus.llm.base import checkpointed, portions, text_of
from studycorpus.llm.words import LONG_WORD, Memory, memory, words
from studycorpus.plans.scale import lookup_join

HEAD = 1 << 17           # bound of the broadcast: pre-tokens
KNOWN = 250_000          # words whose pre-tokens a worker remembers
HEAD_CHARS = 24          # longer pre-tokens are never in it


def _pre_tokens(w, text: str, known: dict) -> dict[str, int]:
    """Frequencies of the pre-tokens of a text; a special token counts as one."""
    out: dict[str, int] = {}
    get = out.get
    for word, n in Counter(w.split(text)).items():
        parts = known.get(word)
        if parts is None:
            parts = (word,) if word in w.special else tuple(w.pieces_of_word(word))
            if len(word) <= LONG_WORD:
                known[word] = parts
        for p in parts:
            out[p] = get(p, 0) + n
    return out


def _in_room(known: Memory, texts: list[str], w) -> None:
    if len(known) > KNOWN:
        known.room(set().union(*(w.split(t) for t in texts)), KNOWN)


def _most_frequent(pieces: DataFrame, most: int) -> DataFrame:
    """The rows with the largest ``df``, at most ``most``: those from the least ``df`` on that
    keeps within it. Frequencies are counted in steps of an eighth, so a few rows decide."""
    step = F.floor(F.log2(F.col("df")) * 8)
    seen, least = 0, None
    for r in sorted(pieces.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):     # at most 8 * 63 steps
        seen += r["count"]
        if seen > most:
            break
        least = r["step"]
    return pieces.filter(F.lit(False)) if least is None else pieces.filter(step >= least)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                 head: int = HEAD) -> DataFrame:
    """One row per document: ``id_col``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit``).

    ``n_tokens`` is the number of ids that the library gives without added special tokens;
    strings of special tokens inside a text count as one each, which is its default. Null
    and empty texts have none. Each row stands for itself, also where ids repeat.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = words(vocabulary), memory(vocabulary, "pre-tokens")
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["p", "df"])

        for batch in portions(batches, column=0):
            texts = batch.column(0).to_pylist()
            _in_room(known, texts, w)
            for text in texts:
                found.update(_pre_tokens(w, text, known).keys())
                if len(found) > 500_000:
                    yield out()
                    found.clear()
        yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(vocabulary)
        for batch in batches:
            p = batch.column(0).to_pylist()
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([1 if x in w.special else w.count(x) for x in p], pa.int32())],
                                  names=["p", "df", "pieces"])

    vocabulary_rows = rows.select("text").mapInArrow(distinct, "p string, df long").groupBy("p").agg(F.sum("df").alias("df"))
    pieces = checkpointed(vocabulary_rows.mapInArrow(count, "p string, df long, pieces int"))
    top = _most_frequent(pieces.filter(F.length("p") <= HEAD_CHARS), head).select("p", "pieces").toArrow()
    common = spark.sparkContext.broadcast(dict(zip(top.column("p").to_pylist(), top.column("pieces").to_pylist())))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each text a row with the tokens of its common pre-tokens, and one for each rare pre-token."""
        w, known, pieces_of = words(vocabulary), memory(vocabulary, "pre-tokens"), common.value
        row = TaskContext.get().partitionId() << 33
        for batch in portions(batches):
            _in_room(known, batch.column(1).to_pylist(), w)
            cols: tuple = ([], [], [], [], [], [])
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total, rare = 0, []
                for p, n in _pre_tokens(w, text, known).items():
                    if (k := pieces_of.get(p)) is None:
                        rare.append((p, n))
                    else:
                        total += n * k
                for values in ((row, id_, len(text.encode()), total, None, 0), *((row, id_, 0, 0, p, n) for p, n in rare)):
                    for c, v in zip(cols, values):
                        c.append(v)
                row += 1
            yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], batch.schema.field(0).type), pa.array(cols[2], pa.int64()),
                                   pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64())],
                                  names=["row", "id", "n_bytes", "known", "p", "n"])

    id_type = rows.schema["id"].dataType.simpleString()
    freq = rows.mapInArrow(frequencies, f"row long, id {id_type}, n_bytes long, known long, p string, n long")
    joined = lookup_join(freq, pieces.select("p", "pieces"), ["p"])
    tokens = F.sum(F.col("known") + F.coalesce(F.col("n") * F.col("pieces"), F.lit(0)))
    return (joined.groupBy("row", "id").agg(F.sum("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
                  .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")))
