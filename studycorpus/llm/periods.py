"""Periodic runs of words by seeds on diagonals.

A run is a stretch of consecutive words that has smallest period ``q`` (words ``q`` apart are
equal), is at least ``max(least, times * q)`` words long, and that no neighbouring word extends
with that period. On the diagonal of lag ``q`` (word ``i`` against word ``i + q``) it is a
stretch of at least ``max(least, times * q) - q`` matches.

Seeds. Lags are handled in levels. The level of lags ``lo`` to ``k`` indexes the k-grams,
where ``k`` is the overlap that the definition guarantees to each of its lags. As ``k >= q``, a
run's k-grams cannot recur inside the run before ``q`` words are over (the run would have a
smaller period), so it is enough to look at pairs of adjacent occurrences in one document.
``k`` triples from level to level, so there are about log3(n / 4) levels.

Extension. Seeds are taken by lag, from left to right. A table holds for each lag how far
the last extension reached; a seed before that is part of a run that is known and is passed
over. Any other seed is extended in both directions, by blocks that double.

K-grams are named by 64-bit hashes, and words compared by them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from studycorpus.llm.base import portions, text_of
from studycorpus.llm.near import _mix, _word_hashes, words_of

LEAST, TIMES = 6, 4
_STRUCT = "array<struct<start:long,length:long,period:long>>"


def levels(n: int, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int]]:
    """``(k, lo)`` for texts of ``n`` words: k-grams of ``k`` words find the runs of periods ``lo`` to ``k``."""
    lo = 1
    while max(least, times * lo) <= n:
        k = (times - 1) * lo
        while all(max(least, times * q) - q > k for q in range(lo, k + 2)):
            k += 1
        yield k, lo
        lo = k + 1


class _Grams:
    """Hashes of the k-grams of a sequence: of two overlapping ones of a power of two."""

    def __init__(self, words: np.ndarray):
        self.width, self.hash, self.words = 1, words, words

    def of(self, k: int) -> np.ndarray:
        while 2 * self.width <= k:
            self.hash = _mix(self.hash[:-self.width] + np.uint64(self.width) ^ _mix(self.hash[self.width:]))
            self.width *= 2
        rest = k - self.width
        return self.hash if not rest else _mix(self.hash[:-rest] + np.uint64(k) ^ _mix(self.hash[rest:]))


def _matches(words: np.ndarray, at: int, lag: int, step: int) -> int:
    """How many words from ``at`` on (``step`` 1) or up to ``at`` (-1) equal the word ``lag`` later."""
    found, block = 0, 16
    while True:
        if step > 0:
            lo, hi = at + found, min(at + found + block, len(words) - lag)
        else:
            lo, hi = max(at + 1 - found - block, 0), at + 1 - found
        if lo >= hi:
            return found
        differ = np.flatnonzero(words[lo:hi] != words[lo + lag:hi + lag])
        if len(differ):
            return found + int(differ[0] if step > 0 else hi - lo - 1 - differ[-1])
        found += hi - lo
        block *= 2


def runs_of(words: np.ndarray, longest: int, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """Runs ``(start, length, period)`` of a sequence of word hashes, no document of which has
    more than ``longest`` words; values that occur once end all runs, so documents may stand in a row."""
    grams, out = _Grams(words), []
    for k, lo in levels(longest, least, times):
        if k >= len(words):
            break
        hashes = grams.of(k)
        order = np.argsort(hashes, kind="stable")
        again = hashes[order[1:]] == hashes[order[:-1]]
        seed = order[:-1][again]
        lag = order[1:][again] - seed
        near = (lag >= lo) & (lag <= k)
        seed, lag = seed[near], lag[near]
        order = np.lexsort((seed, lag))
        seed, lag = seed[order], lag[order]
        reached = {}
        at = 0
        while at < len(seed):
            i, q = int(seed[at]), int(lag[at])
            if i < reached.get(q, 0):
                # on to the first seed of this lag that is not covered
                at += int(np.searchsorted(seed[at:np.searchsorted(lag, q, "right")], reached[q]))
                continue
            left, right = _matches(words, i - 1, q, -1), _matches(words, i, q, 1)
            reached[q] = i + max(right, 1)
            if left + right + q >= max(least, times * q):
                out.append((i - left, left + right + q, q))
            at += 1
    return out


def _found(least: int, times: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            texts = [words_of(t) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(w) for w in texts])
            first = np.concatenate([[0], np.cumsum(sizes + 1)])
            row = _mix(np.arange(int(first[-1]), dtype=np.uint64))       # a value of its own after each document
            for at, words in zip(first.tolist(), texts):
                if words:
                    row[at:at + len(words)] = _word_hashes(words)
            runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for start, length, q in runs_of(row, int(sizes.max(initial=0)), least, times):
                d = int(np.searchsorted(first, start, "right")) - 1
                runs[d].append((start - int(first[d]), length, q))
            kept = []
            for words, some in zip(texts, runs):
                some.sort(key=lambda r: (r[0], r[2]))
                if some:
                    drop = np.zeros(len(words), bool)
                    for start, length, q in some:
                        drop[start + q:start + length] = True
                    words = [w for w, d in zip(words, drop.tolist()) if not d]
                kept.append(" ".join(words))
            listed = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in some] for some in runs],
                              pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), listed, pa.array(kept, pa.string())],
                                  names=["id", "n_words", "runs", "collapsed"])
    return found


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per document ``id_col``, ``n_words``, ``runs`` (by start, then period), ``collapsed``: its words
    joined by blanks, without those that any run holds after its first ``period`` words.

    Words are what blank and U+0009 to U+000D leave. A null or empty text has no words and no
    runs, and its ``collapsed`` is empty. Ids may be null or repeat: rows are independent of
    each other. Other columns are not read. Whole texts are searched; nothing is shuffled.
    """
    if times < 2:
        raise ValueError("a run repeats its period at least twice")
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(_found(least, times), f"id {kind}, n_words long, runs {_STRUCT}, collapsed string")
                .withColumnRenamed("id", id_col))


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``periodic_runs`` in numbers: ``n_runs``, the longest run (ties: first start, then
    smallest period; nulls where there is none), digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                                                   F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    return (found.withColumn("best", best)
                 .select(id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.n").alias("length"),
                         (-F.col("best.q")).alias("period"), F.floor(F.expr("1000 * best.n div -best.q")).cast("long").alias("exponent_milli"),
                         F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
