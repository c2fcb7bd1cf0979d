"""Near duplicates by DartMinHash and banding, with exact verification.

Similarity is the weighted Jaccard similarity of shingles of five words, a shingle's weight
being how often it occurs (the plain Jaccard similarity where none repeats). Words are
what white space (blank, U+0009 to U+000D) leaves; a text of one to four words is one shingle.

Signatures (Christiani, 2020): darts are thrown at the region of each element, which is as
wide as its weight and grows with time. The darts of a unit of weight are hashed from the
element and the unit alone, so equal regions get equal darts. Each dart falls on one of
``K`` coordinates and a coordinate keeps its earliest dart. The time is chosen so that
about ``K ln K + 2 K`` darts hit, whatever the text's length; where a coordinate stays
empty the time is doubled. Two texts agree in a coordinate with the probability of their similarity.

Banding: ``BANDS`` bands of ``ROWS`` coordinates. A pair of similarity 0.8 shares no band
with probability (1 - 0.8**4)**26 = 1e-6.

Copies collapse first. Then, in every bucket:
1. each text is compared with the bucket's first one, exactly. This joins nearly all of a
   large group without looking at its pairs;
2. in buckets that still hold several components, texts of different components are
   compared by their signatures, in blocks of bounded size; where a pair agrees in
   ``LEAST_EQUAL`` of the coordinates (one of 0.8 agrees in fewer with probability 1e-8), the
   shingles of both are brought to the block and counted exactly, by products of their
   incidence matrices.
So each pair that shares a band is compared or already joined, and no link is lost.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from studycorpus.llm.base import checkpointed, components, free_names, portions, slices, text_of
from studycorpus.llm.exact import maybe_among
from studycorpus.llm.vectors import _labels
from studycorpus.llm.words import LONG_WORD, memory

WORDS, SIMILAR = 5, (4, 5)       # words of a shingle; least similarity as a fraction
BANDS, ROWS = 26, 4
K = BANDS * ROWS
DARTS = K * np.log(K) + 2 * K
LEAST_EQUAL = 60
HELD_BYTES = 16 << 20            # of texts and their shingles that a comparing task remembers
REMEMBERED = 100_000             # word hashes that a worker process remembers
BLOCK = 256                      # texts of a bucket that are compared with as many others at once
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = str.maketrans({c: " " for c in "\t\n\x0b\x0c\r"})


def words_of(text: str) -> list[str]:
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w for w in text.translate(_SPACE).split(" ") if w]


def _word_hashes(words: list[str]) -> np.ndarray:
    known, out = memory("word hashes").room(most=REMEMBERED), []
    for w in words:
        h = known.get(w)
        if h is None:
            h = xxhash.xxh3_64_intdigest(w)
            if len(w) <= LONG_WORD:
                known[w] = h
        out.append(h)
    return np.array(out, np.uint64)


def cells(words: list[str], width: int = WORDS) -> np.ndarray:
    """A number for each unit of weight: a shingle's hash, mixed with how often it came before. Sorted, all different."""
    if not words:
        return np.zeros(0, np.uint64)
    h = _word_hashes(words)
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = _mix(out ^ h[i:len(h) - n + 1 + i])
    out.sort()
    new = np.flatnonzero(np.concatenate([[True], out[1:] != out[:-1]]))
    if len(new) == len(out):
        return out
    times = np.arange(len(out)) - np.repeat(new, np.diff(np.concatenate([new, [len(out)]])))
    return np.sort(np.where(times > 0, _mix(out + times.astype(np.uint64) * _GOLD), out))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    num, den = SIMILAR
    if not small or small * den < large * num:
        return False
    if len(a) > len(b):
        a, b = b, a
    both = int((b[np.searchsorted(b, a).clip(max=large - 1)] == a).sum())        # both are sorted
    return both * den >= (small + large - both) * num


def signatures(texts: list[np.ndarray]) -> np.ndarray:
    """``K`` numbers for each set of cells (none of them empty)."""
    out = np.zeros((len(texts), K), np.uint64)
    todo = np.arange(len(texts))
    until = np.array([DARTS / len(c) for c in texts])
    while len(todo):
        owner = np.repeat(np.arange(len(todo)), [len(texts[i]) for i in todo])
        cell = np.concatenate([texts[i] for i in todo])
        last = until[todo][owner]
        time, throw = np.zeros(len(cell)), 0
        times, places, darts = [], [], []
        while len(cell):                      # the next dart of each cell, as long as it comes in time
            throw += 1
            dart = _mix(cell + np.uint64(throw * 0xD1B54A32D192ED03 % (1 << 64)))
            time = time - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53)
            hit = time <= last
            cell, owner, time, last, dart = cell[hit], owner[hit], time[hit], last[hit], _mix(dart[hit])
            times.append(time)
            places.append(owner * K + (dart % np.uint64(K)).astype(np.int64))
            darts.append(dart | np.uint64(1))
        time, place, dart = np.concatenate(times), np.concatenate(places), np.concatenate(darts)
        late = np.argsort(-time, kind="stable")
        got = np.zeros(len(todo) * K, np.uint64)
        got[place[late]] = dart[late]         # the earliest is written last
        got = got.reshape(-1, K)
        full = (got != 0).all(axis=1)
        out[todo[full]] = got[full]
        todo = todo[~full]
        until[todo] *= 2
    return out


def _band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        out = _mix(out ^ sig.reshape(len(sig), BANDS, ROWS)[:, :, r])
    return out.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        words = [words_of(t) for t in batch.column(1).to_pylist()]
        full = [i for i, w in enumerate(words) if w]
        sig = signatures([cells(words[i]) for i in full])
        bands, short = _band_keys(sig), np.ascontiguousarray((sig >> np.uint64(40)).astype("<u2"))
        place = dict(zip(full, range(len(full))))
        digests = [xxhash.xxh3_128_digest(" ".join(w)) if w else None for w in words]
        yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()),
                               pa.array([bands[place[i]] if i in place else None for i in range(len(words))], pa.list_(pa.int64())),
                               pa.array([short[place[i]].tobytes() if i in place else None for i in range(len(words))], pa.binary())],
                              names=["id", "content", "bands", "sig"])


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` whose texts are similar. ``docs`` has ``id, text``."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}          # texts come in many pairs
        held = 0

        def of(text: str) -> np.ndarray:
            nonlocal held
            if text not in known:
                if held > HELD_BYTES:
                    known.clear()
                    held = 0
                known[text] = cells(words_of(text))
                held += known[text].nbytes + 4 * len(text)
            return known[text]

        for batch in portions(batches, column=2):
            yes = [similar(of(x), of(y)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    nodes = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    # texts of other documents are not shuffled; those that pass in error fall out of the join
    texts = checkpointed(docs.filter(maybe_among(nodes, "node")("id")).distinct())
    rows = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
                 .join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b").select("a", "b", "x", "y"))
    return checkpointed(rows.mapInArrow(compare, "a long, b long").distinct())


def _grid(members: DataFrame) -> DataFrame:
    """Large buckets as a grid of pairs of blocks ``i <= j``: a task holds at most twice
    ``BLOCK`` rows at once. ``o`` is a row's own block."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    cell = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1),
                                 lambda j: F.struct(F.least(j, F.col("o")).alias("i"), F.greatest(j, F.col("o")).alias("j"))))
    own = F.pmod(F.xxhash64("node", "key"), blocks).cast("int")
    return members.withColumn("o", own).withColumn("g", cell).select("key", "g.i", "g.j", "o", "node", "comp", "sig")


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """Rows in order of ``key, i, j`` as ``((key, i, j), the other columns by row)``."""
    held, at = [], None
    for batch in slices(batches):
        for key, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, i, j) != at:
                if len(held) > 1:
                    yield at, held
                held, at = [], (key, i, j)
            held.append(rest)
    if len(held) > 1:
        yield at, held


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block pair ``o, node, comp, sig`` that agree enough with one of another component."""
    for (key, i, j), held in _by_block(batches):
        o, node, comp = (np.array([r[k] for r in held]) for k in range(3))
        if (comp == comp[0]).all():
            continue
        sig = np.frombuffer(b"".join(r[3] for r in held), "<u2").reshape(len(held), K)
        a, b = np.flatnonzero(o == i), np.flatnonzero(o == j)
        hit = np.zeros(len(held), bool)
        for x in a:                             # one row against a block: memory stays small
            y = b[comp[b] != comp[x]]
            y = y[(sig[y] == sig[x]).sum(axis=1) >= LEAST_EQUAL]
            hit[y] = True
            hit[x] |= len(y) > 0
        n = int(hit.sum())
        if n:
            yield pa.record_batch([pa.array([key] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()),
                                   pa.array(o[hit], pa.int32()), pa.array(node[hit], pa.int64())], names=["key", "i", "j", "o", "n"])


def _shared(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many cells each set of ``a`` shares with each of ``b``: products of their
    incidence matrices, a few thousand columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    owner, column = owner[keep], np.unique(column[keep], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        first, last = np.searchsorted(column, [lo, lo + 4096])
        one = np.zeros((len(sets), 4096), np.float32)
        one[owner[first:last], column[first:last] - lo] = 1
        out += one[a] @ one[b].T                # whole numbers below 4096 are exact
    return out.astype(np.int64)


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block pair ``o, node, cells`` to links: each text with the smallest node that
    it reaches by similar texts of the block pair."""
    num, den = SIMILAR
    for (_, i, j), held in _by_block(batches):
        o, node = (np.array([r[k] for r in held]) for k in range(2))
        sets = [np.frombuffer(r[2], np.uint64) for r in held]
        size = np.array([len(x) for x in sets])
        a, b = np.flatnonzero(o == i), np.flatnonzero(o == j)
        both = _shared(sets, a, b)
        graph = np.zeros((len(held), len(held)), bool)
        graph[np.ix_(a, b)] = both * den >= (size[a][:, None] + size[b][None, :] - both) * num
        least = node[_labels(graph | graph.T)]         # rows are in order of node
        moved = least != node
        if moved.any():
            yield pa.record_batch([pa.array(node[moved], pa.int64()), pa.array(least[moved], pa.int64())], names=["a", "b"])


def _cross_links(members: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between texts of a bucket that are in different components.

    ``members``: ``key, node, comp, sig, m`` (size of the bucket). Signatures tell which texts
    may be similar; their shingles then meet in the same blocks and are compared exactly.
    Both steps give at most a row for each text and block, never a list of pairs.
    """
    near = checkpointed(_grid(members).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
                                      .mapInArrow(_candidates, "key long, i int, j int, o int, n long"))
    nodes = checkpointed(near.select(F.col("n").alias("node")).distinct())

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            sets = [cells(words_of(t)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["node", "cells"])

    texts = docs.filter(maybe_among(nodes, "node")("id")).distinct().join(nodes, F.col("id") == F.col("node"), "left_semi")
    sets = checkpointed(texts.mapInArrow(shingled, "node long, cells binary"))
    rows = near.join(sets, F.col("n") == F.col("node")).select("key", "i", "j", "o", "node", "cells")
    return checkpointed(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_linked, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, ``class_id`` (smallest id of its class), ``copy_of``
    (smallest id with the same words), ``kept`` (own id is the class's).

    A class is what links of similarity 0.8 or more join, directly or by way of others.
    Null and empty texts, and texts of white space, are each a class of their own. Ids are
    64-bit integers; a row without id gets the class of its text, or none. Rows that are
    repeated with their id are one document; different texts under one id are joined by it
    where both are the first of their copies.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    signed = checkpointed(rows.mapInArrow(_signed, "id long, content binary, bands array<long>, sig binary"))
    contents = signed.filter("content is not null").groupBy("content").agg(F.min("id").alias("rep"))
    # one row per distinct text: of the rows of its first document
    firsts = signed.filter("id is not null and content is not null").select("id", "content", "bands", "sig")
    reps = checkpointed(firsts.join(contents.filter("rep is not null").withColumnRenamed("content", "c"),
                                    (F.col("id") == F.col("rep")) & (F.col("content") == F.col("c")), "left_semi").dropDuplicates(["id", "content"]))

    banded = reps.select(F.explode("bands").alias("key"), F.col("id").alias("node"))
    buckets = (banded.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("pivot"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
                     .filter("m > 1").groupBy("m", "pivot", "s").agg(F.min("key").alias("key")).select("key", "m", "pivot"))
    members = checkpointed(banded.join(buckets, "key"))
    stars = members.filter("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    near = _verified(checkpointed(stars), rows)
    comps = checkpointed(components(near))

    placed = (members.join(comps.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left")
                     .select("key", "m", "pivot", "node", F.coalesce("component", "node").alias("comp")))
    open_ = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select(F.col("key").alias("k"))
    left = placed.join(open_, F.col("key") == F.col("k"), "left_semi")
    sigs = reps.select(F.col("id").alias("n"), "sig").dropDuplicates(["n"])
    more = _cross_links(left.join(sigs, F.col("node") == F.col("n")).select("key", "node", "comp", "sig", "m"), rows)
    if not more.isEmpty():
        comps = checkpointed(components(near.select("a", "b").unionAll(more)))

    named = (signed.select("id", "content").join(contents.withColumnRenamed("content", "c"), F.col("content") == F.col("c"), "left")
                   .join(comps.withColumnRenamed("node", "n"), F.col("rep") == F.col("n"), "left"))
    copy_of = F.coalesce("rep", "id")
    return named.select(F.col("id").alias(id_col), F.coalesce("component", copy_of).alias("class_id"), copy_of.alias("copy_of"),
                        F.coalesce(F.col("id") == F.coalesce("component", copy_of), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, of each class the one with the smallest id. Rows
    without id stay. Texts of documents that cannot be dropped are not shuffled. Columns may
    have any names."""
    classes = near_duplicates(docs, id_col, text_col)
    flag, lost = free_names(docs.columns, "_maybe", "_gone")
    columns = [f"`{c}`" for c in docs.columns]
    gone = checkpointed(classes.filter("not kept").select(F.col(id_col).alias(lost)).distinct())
    flagged = docs.withColumn(flag, F.coalesce(maybe_among(gone, lost)(F.col(id_col).cast("long")), F.lit(False)))
    safe, rest = flagged.filter(~F.col(flag)), flagged.filter(F.col(flag))
    return safe.select(*columns).unionAll(rest.join(gone, F.col(id_col).cast("long") == F.col(lost), "left_anti").select(*columns))
