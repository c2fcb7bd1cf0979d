"""Byte-pair encoding by a pair occurrence index, and decoding.

All pre-tokens of a partition that are not known yet are encoded together: the index maps
the rank of each adjacent pair to all its positions, ranks are applied in ascending order,
and each merge enters the two pairs that it makes. A merge only makes pairs whose rule was
learned after it, so one ascending pass gives what word-by-word merging gives.
"""
from __future__ import annotations

import functools
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from studycorpus.llm.base import free_names, portions, text_of
from studycorpus.llm.words import LONG_WORD, Words, memory, words

REMEMBERED = 80_000        # words whose ids a worker process remembers
CHUNK = 16_000           # new words that are encoded together


class PairIndex:
    def __init__(self, w: Words):
        self.w = w
        self.ids: dict[str, int] = dict(w.spec["vocab"])
        named = {i: s for s, i in self.ids.items()} | {i: s[1:] for s, i in w.special.items()}
        self.pieces = [named.get(i, "") for i in range(max(named) + 1)]
        pairs = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in w.spec["merges"]]
        self.pair_of = [(self.ids[a], self.ids[b], self.ids[a + b]) for a, b in pairs]
        self.rule = {(a, b): rank for rank, (a, b, _) in enumerate(self.pair_of)}
        if len(self.rule) < len(pairs):
            raise ValueError("a pair has two ranks")
        keys = np.array([a << 32 | b for a, b, _ in self.pair_of], np.int64)
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]

    def encode(self, pre_tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token."""
        ids, suffix, rule = self.ids, self.w.suffix, self.rule
        sym: list[int] = []
        ends: list[int] = []
        for p in pre_tokens:
            sym += [ids[c] for c in p[:-1]]
            sym.append(ids[p[-1] + suffix])
            ends.append(len(sym))
        n = len(sym)
        if not n:
            return [[] for _ in pre_tokens]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        start = 0
        for e in ends:
            before[start], after[e - 1], start = -1, -1, e

        # rank -> positions of its pair, left to right; at first from all adjacent pairs at once
        index: dict[int, list[int]] = {}
        flat = np.array(sym, np.int64)
        keys = flat[:-1] << 32 | flat[1:]
        keys[np.array(ends[:-1], np.int64) - 1] = -1
        place = np.searchsorted(self.keys, keys).clip(0, len(self.keys) - 1)
        at_all = np.flatnonzero(self.keys[place] == keys)
        ranks = self.ranks[place[at_all]]
        order = np.argsort(ranks, kind="stable")
        at_all, ranks = at_all[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, some in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else [], np.split(at_all, cuts)):
            index[r] = some.tolist()
        active = list(index)                       # ascending, so a heap

        pair_of, get = self.pair_of, rule.get
        while active:
            r = heappop(active)
            left, right, new = pair_of[r]
            at_all = index.pop(r)
            if left == right:
                at_all.sort()                      # in a run of equal symbols the left pair goes first
            for at in at_all:
                if sym[at] != left:
                    continue
                b = after[at]
                if b < 0 or sym[b] != right:
                    continue
                sym[at], sym[b] = new, -1
                c = after[at] = after[b]
                if c >= 0:
                    before[c] = at
                    s = get((new, sym[c]))
                    if s is not None:
                        if s in index:
                            index[s].append(at)
                        else:
                            index[s] = [at]
                            heappush(active, s)
                a = before[at]
                if a >= 0:
                    s = get((sym[a], new))
                    if s is not None:
                        if s in index:
                            index[s].append(a)
                        else:
                            index[s] = [a]
                            heappush(active, s)
        out, start = [], 0
        for e in ends:
            out.append([s for s in sym[start:e] if s >= 0])
            start = e
        return out

    def decode(self, ids) -> str:
        """As the library without a decoder: pieces with a blank between."""
        return " ".join(map(self.pieces.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def pair_index(path: str) -> PairIndex:
    return PairIndex(words(path))


def word_ids(path: str, words_of: set[str], known: dict) -> dict:
    """Ids of the words that are not known as little-endian unsigned 32-bit integers. New words
    are cut into pre-tokens, and their distinct pre-tokens go through the pair index."""
    w, index = words(path), pair_index(path)
    new = list(words_of - known.keys())
    out: dict[str, bytes] = {}
    for at in range(0, len(new), CHUNK):
        plain, other = {}, {}
        for x in new[at:at + CHUNK]:
            if x in w.special:
                continue
            if w.is_plain(x):
                plain[x] = w.parts_of_plain(x)
            else:
                other[x] = w.pieces_of_word(x)
        # a part of a plain word is what it is as a word, so it may be known
        parts = list({p for ps in plain.values() for p in ps} - known.keys() - out.keys())
        rest = list({p for ps in other.values() for p in ps})
        ids = [array("I", i).tobytes() for i in index.encode([w.mapped(p) for p in parts] + rest)]
        out.update(zip(parts, ids))
        for x, ps in plain.items():
            if len(ps) > 1:
                out[x] = b"".join([out[p] if p in out else known[p] for p in ps])
        of_rest = dict(zip(rest, ids[len(parts):]))
        for x, ps in other.items():
            out[x] = b"".join([of_rest[p] for p in ps])
    out |= {x: array("I", [i]).tobytes() for x, i in w.special.items()}
    return out


def encode_texts(path: str, texts: list[str]) -> Iterator[bytes]:
    """Ids of each text; a worker process remembers short words within a bound."""
    w, known = words(path), memory(path, "ids")
    for at in range(0, len(texts), 512):
        lists = [w.split(t) for t in texts[at:at + 512]]
        distinct = set().union(*lists)
        known.room(distinct, REMEMBERED)
        known.update(new := word_ids(path, distinct, known))
        for words_ in lists:
            yield b"".join(map(known.__getitem__, words_))
        for x in new:
            if len(x) > LONG_WORD:
                del known[x]


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None,
           digest_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """The documents with a column of token ids (int array), and the decoded text or its SHA-256
    if named; the digest is made in the task that encodes, so that the decoded text stays there.
    ``keep`` names the columns that pass, all of them by default.

    Null and empty texts have no ids and decode to the empty text. Other columns pass;
    one that has the name of a new column is replaced.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, column=-1):
            at = batch.num_columns - 1
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in encode_texts(vocabulary, batch.column(at).to_pylist())]
            cols = [batch.column(i) for i in range(batch.num_columns) if i != at]
            names = [n for i, n in enumerate(batch.schema.names) if i != at]
            cols.append(pa.array(ids, pa.list_(pa.int32())))
            names.append(ids_col)
            if digest_col:
                index = pair_index(vocabulary)
                cols.append(pa.array([hashlib.sha256(index.decode(i.tolist()).encode()).hexdigest() for i in ids], pa.string()))
                names.append(digest_col)
            if decoded_col:
                index = pair_index(vocabulary)
                cols.append(pa.array([index.decode(i.tolist()) for i in ids], pa.string()))
                names.append(decoded_col)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rest = [c for c in (docs.columns if keep is None else keep) if c not in (ids_col, decoded_col, digest_col)]
    from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
    schema = StructType([docs.schema[c] for c in rest] + [StructField(ids_col, ArrayType(IntegerType()))]
                        + ([StructField(digest_col, StringType())] if digest_col else [])
                        + ([StructField(decoded_col, StringType())] if decoded_col else []))
    (text,) = free_names(docs.columns, "_text")
    return docs.select(*[f"`{c}`" for c in rest], text_of(text_col).alias(text)).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, made in the task that encodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = pair_index(vocabulary)
        for batch in portions(batches):
            n, a, b = [], [], []
            for ids in encode_texts(vocabulary, batch.column(1).to_pylist()):
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(index.decode(array("I", ids)).encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                  names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    return (rows.mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
                .withColumnRenamed("id", id_col))
