"""Alignment of two tokenizers by the byte places where tokens of both end.

A text's tokens of A and of B spell the same bytes. Places where tokens of both end cut the two
sequences into groups, and the tokens of a group are linked, each of A with each of B.

Galloping intersection. The places are two ascending lists. The shorter one drives: from where
the last leading value (every ``LEAP``-th one) was found, each of its values takes steps of 1, 2, 4, ... in
the longer list until it is passed, and the last step is searched by halves. Indices that both lists
share slice the groups; differences of adjacent ranks give the ranges that overlap. The
texts of a portion lie behind one another in one list, so short texts cost little.

Counts. Each text keeps its distinct linked id pairs and how often each is linked. Spark counts
in how many documents a pair is linked, by partial aggregates, and the largest count of
each id of A. ``COMMON`` pairs with the largest counts are broadcast and looked up where a
text's pairs are stored; only the others are shuffled, a row for each text and pair.
"""
from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from studycorpus.llm.base import checkpointed, portions, text_of

COMMON = 1 << 18             # pairs that are broadcast: 13 bytes each
LEAP = 8                     # values of the driving list from one that is placed first to the next
LINKS = 1 << 20              # links that are listed at once
PLAIN = "\u0300"             # letters before this one are the same in every release of Unicode


class Pair:
    """Two tokenizers, their token bytes, and encoders of lists of texts."""

    def __init__(self, a_path: str, b_path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        # the byte-level alphabet: printable bytes are themselves, the others follow from 256 on
        self.letters = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.a_bytes = [bytes(self.letters.get(c, 0) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-Fa-f]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.a_sizes = np.array([len(x) for x in self.a_bytes])
        self.b_sizes = np.array([len(x) for x in self.b_bytes])
        # each id as text with what may follow it in a list of groups: the next id, B's ids, the next group
        self.width = max(len(self.a_bytes), len(self.b_bytes))
        self.written = np.array([f"{i}{end}" for end in ",|;" for i in range(self.width)], object)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as file:
                ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, file)}
            if any(self.a_bytes[r] != t for t, r in ranks.items()):
                raise ValueError(f"{ranks_path} is not the vocabulary of {a_path}")
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        spaced = [" " + t for t in texts]
        if self.fast:
            plain = [t.isascii() or max(t) < PLAIN for t in spaced]
            a = [self.fast.encode_ordinary(t) if p else None for t, p in zip(spaced, plain)]
            rest = iter(self.a.encode_batch([t for t, p in zip(spaced, plain) if not p], add_special_tokens=False))
            a = [next(rest).ids if x is None else x for x in a]
        else:
            a = [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        return a, self.b.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def _pair(*paths: str | None) -> Pair:
    """One per worker process."""
    return Pair(*paths)


def _reached(x: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each of the ascending ``x`` the first index of ``long`` whose value is not less. Every
    ``LEAP``-th value is placed first; the others gallop from the one placed before them."""
    if len(x) > LEAP:
        below = np.repeat(_reached(x[::LEAP], long), LEAP)[:len(x)] - 1
    else:
        below = np.full(len(x), -1)
    above, live, step = np.full(len(x), len(long)), np.arange(len(x)), 1
    while len(live):                          # long[below] < x <= long[above]
        ahead = below[live] + step
        passed = long[np.minimum(ahead, len(long) - 1)] >= x[live]
        passed |= ahead >= len(long)
        above[live[passed]] = np.minimum(ahead[passed], len(long))
        live, ahead, step = live[~passed], ahead[~passed], step * 2
        below[live] = ahead
    live = np.flatnonzero(above - below > 1)
    while len(live):
        middle = (below[live] + above[live]) >> 1
        less = long[middle] < x[live]
        below[live[less]] = middle[less]
        above[live[~less]] = middle[~less]
        live = live[above[live] - below[live] > 1]
    return above


def gallop(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the values that two ascending lists share, in ``short`` and in ``long``."""
    if not len(short) or not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = _reached(short, long)
    hit = np.flatnonzero(long[np.minimum(at, len(long) - 1)] == short)
    return hit, at[hit]


def _summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights[:0]


def linked_pairs(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray, a_many: np.ndarray, b_many: np.ndarray,
                 doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, pair, links)`` for the distinct id pairs of each document. Group ``g`` of document
    ``doc[g]`` has ``a_many[g]`` ids of ``a`` from ``a_first[g]`` on, likewise ``b``; a pair is
    ``id of a * width + id of b``. Links are listed ``LINKS`` at a time and summed."""
    many = a_many * b_many
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def merge() -> None:
        nonlocal held
        if len(found) > 1:
            found[:] = [_summed(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]))]
        held = len(found[0][0]) if found else 0

    # a group beyond LINKS is cut by its ids of A
    wide = np.maximum(1, np.minimum(a_many, LINKS // np.maximum(b_many, 1)))
    parts = -(-a_many // wide)
    g = np.repeat(np.arange(len(many)), parts)
    part = np.arange(len(g)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = a_first[g] + part * wide[g]
    rows = np.minimum(wide[g], a_many[g] - part * wide[g])
    links = rows * b_many[g]
    ends = np.cumsum(links)
    at = 0
    while at < len(g):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LINKS, "right")))
        n = links[at:to]
        owner = np.repeat(np.arange(at, to), n)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        width_b = b_many[g[owner]]
        ids = a[first[owner] + inside // width_b] * width + b[b_first[g[owner]] + inside % width_b]
        found.append(_summed(doc[g[owner]] * np.int64(1 << 40) + ids, np.ones(len(ids), np.int64)))
        held += len(found[-1][0])
        if held > 4 * LINKS:
            merge()
        at = to
    merge()
    if not found:
        return (np.zeros(0, np.int64),) * 3
    key, times = found[0]
    return key >> 40, key & ((1 << 40) - 1), times


def align(pair: Pair, texts: list[str]) -> list[tuple]:
    """For each text ``(n_a, n_b, n_groups, n_links, groups, pairs, links)``; ``groups`` is written
    ``a1,a2|b1;a3|b2,b3``, ``pairs`` are its distinct id pairs and ``links`` how often each is
    linked. Texts that are empty or that the tokens do not spell give zeros and ''."""
    width = len(pair.b_bytes)
    if len(pair.a_bytes) * width >= 1 << 40:
        raise ValueError("vocabularies too large for pair numbers")
    out: list[tuple] = [(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    a_ids, b_ids = pair.encode([texts[i] for i in some]) if some else ([], [])
    good = []
    for i, x, y in zip(some, a_ids, b_ids):
        want = b" " + texts[i].encode()
        if b"".join(map(pair.a_bytes.__getitem__, x)) == want and b"".join(map(pair.b_bytes.__getitem__, y)) == want:
            good.append((i, x, y))
    if not good:
        return out
    a, b = (np.array(list(itertools.chain.from_iterable(r[k] for r in good)), np.int64) for k in (1, 2))
    a_ends, b_ends = np.cumsum(pair.a_sizes[a]), np.cumsum(pair.b_sizes[b])
    at_a, at_b = gallop(a_ends, b_ends) if len(a) <= len(b) else gallop(b_ends, a_ends)[::-1]
    a_first, b_first = np.concatenate([[0], at_a[:-1] + 1]), np.concatenate([[0], at_b[:-1] + 1])
    a_many, b_many = at_a + 1 - a_first, at_b + 1 - b_first
    last = np.cumsum([len(x) for _, x, _ in good]) - 1
    until = np.searchsorted(at_a, last) + 1                         # texts end where both have an end
    doc = np.repeat(np.arange(len(good)), np.diff(np.concatenate([[0], until])))
    owner, ids, times = linked_pairs(a, b, a_first, b_first, a_many, b_many, doc, width)
    cut = np.searchsorted(owner, np.arange(len(good) + 1))
    links = np.add.reduceat(a_many * b_many, np.concatenate([[0], until[:-1]]))
    # the ids in the order in which they are written: group by group, A's before B's
    stream = np.empty(len(a) + len(b), np.int64)
    code = a.copy()
    code[at_a] += pair.width
    stream[np.arange(len(a)) + np.repeat(b_first, a_many)] = code
    code = b.copy()
    code[at_b] += 2 * pair.width
    stream[np.arange(len(b)) + np.repeat(at_a + 1, b_many)] = code
    stream = pair.written[stream].tolist()
    g = at = 0
    for d, (i, x, y) in enumerate(good):
        to = at + len(x) + len(y)
        out[i] = (len(x), len(y), int(until[d]) - g, int(links[d]), "".join(stream[at:to])[:-1], ids[cut[d]:cut[d + 1]], times[cut[d]:cut[d + 1]])
        g, at = int(until[d]), to
    return out


def _aligned(paths: tuple, texts_too: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*paths)
        for batch in portions(batches, most=1 << 19):
            rows = align(pair, batch.column(1).to_pylist())
            shas = [hashlib.sha256(r[4].encode()).hexdigest() if r[0] else "" for r in rows]
            ends = np.concatenate([[0], np.cumsum([len(r[5]) for r in rows])]).astype(np.int32)
            pairs, links = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([r[k] for r in rows]), pa.int64())) for k in (5, 6))
            yield pa.record_batch([batch.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array(shas), pairs, links]
                                  + ([pa.array([r[4] for r in rows])] if texts_too else []),
                                  names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"] + (["groups"] if texts_too else []))
    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None,
            pattern: str | None = None, groups: bool = False) -> DataFrame:
    """Per document the alignment itself: ``id, n_a, n_b, n_groups, n_links, groups_sha256, pairs,
    links`` and, if wanted, ``groups`` as text. See ``alignment`` for the rules."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_aligned((a_path, b_path, ranks_path, pattern), groups),
                           f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<long>"
                           + (", groups string" if groups else ""))


def pair_counts(rows: DataFrame, width: int) -> DataFrame:
    """``pair, docs`` (documents that link it), ``best`` (no pair of the same id of A has more)."""
    counts = checkpointed(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs")))
    most = counts.groupBy(F.expr(f"pair div {width}").alias("a")).agg(F.max("docs").alias("most"))      # a row for each id of A
    return checkpointed(counts.join(most, F.expr(f"pair div {width}") == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")))


def alignment(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None,
              pattern: str | None = None, common: int = COMMON) -> DataFrame:
    """Per document ``n_a, n_b, n_groups, n_links`` (tokens, groups, pairs of token occurrences that
    share a group), ``n_best`` (links whose id pair is linked in as many documents as any pair of its
    id of A), ``count_sum`` (that number, over the links), ``groups_sha256``.

    A is a byte-level file of ``tokenizers`` and reads a blank and the text; B is a ``sentencepiece``
    model, which adds a blank itself. Special tokens in texts are plain text. A null or empty text
    has no tokens (zeros, ''), likewise one whose bytes A or B do not keep. With ``ranks_path``
    and ``pattern``, the same vocabulary as ranks, plain letters are encoded by ``tiktoken``, which is
    faster. Each row is a document, also where ids are null or repeat. Other columns are not read.
    """
    stored = checkpointed(aligned(docs, a_path, b_path, id_col, text_col, ranks_path, pattern).withColumn("row", F.monotonically_increasing_id()))
    width = len(_pair(a_path, b_path, ranks_path, pattern).b_bytes)
    counts = pair_counts(stored, width)
    head = counts.orderBy(F.desc("docs"), "pair").limit(common).toPandas().sort_values("pair")      # at most ``common`` rows
    sent = docs.sparkSession.sparkContext.broadcast(tuple(head[c].to_numpy() for c in ("pair", "docs", "best")))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n_docs, best = sent.value
        for batch in batches:
            pairs, links = batch.column(len(batch.columns) - 2), batch.column(len(batch.columns) - 1)
            ends = pairs.offsets.to_numpy().astype(np.int64)
            ids, times = (c.values.slice(int(ends[0]), int(ends[-1] - ends[0])).to_numpy() for c in (pairs, links))
            ends = ends - ends[0]
            hit = np.zeros(len(ids), bool)
            if len(known):
                at = np.searchsorted(known, ids).clip(max=len(known) - 1)
                hit = known[at] == ids
                sums = [np.concatenate([[0], np.cumsum(times * hit * of[at])])[ends].astype(np.int64) for of in (best, n_docs)]
            else:
                sums = [np.zeros(len(ends), np.int64)] * 2
            left = np.concatenate([[0], np.cumsum(~hit)])[ends].astype(np.int32)
            yield pa.record_batch([*batch.columns[:-2], *(pa.array(np.diff(s)) for s in sums),
                                   *(pa.ListArray.from_arrays(left, pa.array(v[~hit])) for v in (ids, times))], names=names)

    kept = [c for c in stored.columns if c not in ("pairs", "links")]
    names = [*kept, "n_best", "count_sum", "pairs", "links"]
    kinds = ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in kept)
    looked = checkpointed(stored.select(*kept, "pairs", "links").mapInArrow(
        look_up, f"{kinds}, n_best long, count_sum long, pairs array<long>, links array<long>"))
    rare = looked.filter(F.size("pairs") > 0).select("row", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select("row", "p.pairs", "p.links")
    more = (rare.join(counts, F.col("pairs") == F.col("pair")).groupBy(F.col("row").alias("row1"))
                .agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("best1"), F.sum(F.col("links") * F.col("docs")).alias("sum1")))
    out = looked.join(more, F.col("row") == F.col("row1"), "left")
    out = out.withColumn("n_best", F.col("n_best") + F.coalesce("best1", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("sum1", F.lit(0)))
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
