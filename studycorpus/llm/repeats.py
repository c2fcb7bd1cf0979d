"""Repeated byte strings by two-stage suffix sorting, in buckets that Spark deals out.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts elsewhere, in
the same document or another. Strings never cross documents.

Dealing out. Each window of ``LENGTH`` bytes is named by the least hash among its strings
of ``ANCHOR`` bytes, the leftmost one if it occurs twice. Equal windows have equal names,
and neighbouring windows mostly share one, so a document falls into runs of windows with
one name: about one in (LENGTH - ANCHOR) / 2 bytes. Windows of different names never have
to meet. Names that occur once are done. Runs of equal bytes collapse and count with their number.

Sorting. What is left are names with several different runs. Each task takes buckets of
whole names, and sorts the suffixes of their runs by two stages (Itoh and Tanaka, 1999):
suffixes smaller than their successor are sorted directly, by groups of eight bytes to the
depth of ``LENGTH``; a scan of the buckets of first bytes in ascending order then induces
the order of all others. Adjacent common prefixes of ``LENGTH`` bytes mark the repeats.

A name with more than ``HOT`` different runs, such as a frequent line with different
surroundings, would be too much for one task. Its windows are dealt out one by one, by a
128-bit digest of their bytes, and those whose digest occurs again are the repeats.

Copies of whole texts collapse before all this, and only texts that are needed again, to
cut out runs or to remove spans, are shuffled.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from studycorpus.llm.base import checkpointed, portions, text_of
from studycorpus.llm.exact import maybe_among

LENGTH, ANCHOR = 200, 64
HOT = 8_000                  # different runs of a name that one task sorts together
SORT_BYTES = 1 << 19         # text that is sorted at once
CHUNK = 1 << 18              # windows of a document that are named at once


def _named(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a document: names, first and last window."""
    starts, lasts, names = [], [], []
    total = len(data) - LENGTH + 1
    for lo in range(0, max(total, 0), CHUNK):
        hi = min(lo + CHUNK, total)
        b = np.frombuffer(data, np.uint8, count=hi - lo + LENGTH - 1, offset=lo).astype(np.uint64)
        # polynomial hash of ANCHOR bytes by doubling
        h, width, factor = b + np.uint64(1), 1, 0x9E3779B97F4A7C15
        while width < ANCHOR:
            h = h[:-width] * np.uint64(factor) + h[width:]
            width, factor = width * 2, factor * factor % (1 << 64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        # least (hash, place) of each window: the hash gives the upper bits, the place the lower
        span = LENGTH - ANCHOR + 1
        bits = 21                          # the same for every chunk, or equal windows could differ
        low = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        if width < span:
            low = np.minimum(low[:len(low) - (span - width)], low[span - width:])
        at = (low & np.uint64((1 << bits) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        starts.append(first + lo)
        lasts.append(np.concatenate([first[1:] - 1, [len(at) - 1]]) + lo)
        names.append(h[at[first]].view(np.int64))
    if not starts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(names), np.concatenate(starts), np.concatenate(lasts)


def suffix_order(text: np.ndarray, depth: int = LENGTH, words: np.ndarray | None = None) -> np.ndarray:
    """Suffixes of ``text`` (uint8) in order of their first ``depth`` bytes at least.

    Two stages. A suffix is *small* if it is less than the one that starts after it; the
    last one is large, as its successor is the empty suffix. Small suffixes are sorted
    directly. Then the buckets of first bytes are scanned in ascending order: the large
    suffixes of a bucket come before its small ones, and each of them was placed by its
    successor, which stands earlier; those that start with a run of one byte follow in rounds.
    ``words`` is ``_words(text, depth)``, if it is known.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int32)
    # small or large: by the next byte that differs
    differ = np.flatnonzero(text[1:] != text[:-1])
    end = np.concatenate([differ, [n - 1]])            # last place of each run of equal bytes
    rises = np.zeros(len(end), bool)
    rises[:-1] = text[differ] < text[differ + 1]
    small = np.repeat(rises, np.diff(np.concatenate([[-1], end])))
    del differ, end, rises
    starts = np.flatnonzero(small).astype(np.int32)
    del small
    direct = _direct(_words(text, depth) if words is None else words, starts, depth)
    small_of = np.split(direct, np.searchsorted(text[direct], np.arange(1, 256)))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1], np.int32))      # induced by the empty suffix
    out = []
    for c in range(256):
        fronts, waiting[c] = waiting[c], []
        front = np.concatenate(fronts) if fronts else np.zeros(0, np.int32)
        placed = []
        while len(front):                              # rounds of runs of this byte
            placed.append(front)
            before = front[front > 0] - np.int32(1)
            front = before[text[before] == c]
        bucket = np.concatenate([*placed, small_of[c]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - np.int32(1)
        before = before[text[before] > c]
        if len(before):
            first = text[before]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cut = np.flatnonzero(np.diff(first)) + 1
            for part in np.split(before, cut):
                waiting[text[part[0]]].append(part)
    return np.concatenate(out)


def _words(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Eight bytes from each place as one number, so that numbers compare as bytes do. Behind
    the text come zeros, for places up to ``depth`` bytes after its end."""
    out = np.zeros(len(text) + depth + 16, np.uint64)
    for k in range(8):
        out[:len(text)] <<= np.uint64(8)
        out[:len(text) - k] |= text[k:] if k < len(text) else np.uint64(0)
    return out


def _numbered(new: np.ndarray) -> np.ndarray:
    """Number of the group of each place, from the marks where a new one starts (not for the first)."""
    out = np.zeros(len(new) + 1, np.int32)
    np.cumsum(new, out=out[1:])
    return out


def _direct(words: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in order of their first ``depth`` bytes: by eight bytes, then ties by the next."""
    if not len(starts):
        return starts
    key = words[starts]
    sort = np.argsort(key, kind="stable")
    order, key = starts[sort], key[sort]
    group, tied = _numbered(key[1:] != key[:-1]), np.arange(len(order), dtype=np.int32)
    for at in range(8, depth, 8):
        same = group[1:] == group[:-1]
        inside = np.zeros(len(group), bool)
        inside[1:] |= same
        inside[:-1] |= same
        tied, group = tied[inside], group[inside]
        if not len(tied):
            break
        key = words[order[tied] + at]
        sort = np.lexsort((key, group))
        order[tied] = order[tied][sort]
        key = key[sort]
        group = _numbered((group[1:] != group[:-1]) | (key[1:] != key[:-1]))
    return order


def common_prefixes(text: np.ndarray, places: np.ndarray, most: int = LENGTH, words: np.ndarray | None = None) -> np.ndarray:
    """Length of the common prefix of each place and the next in ``places``, up to ``most`` bytes."""
    words = _words(text, most) if words is None else words
    a, b = places[:-1], places[1:]
    out, live = np.zeros(len(a), np.int32), np.arange(len(a), dtype=np.int32)
    for at in range(0, most, 8):
        differ = words[a[live] + at]
        differ ^= words[b[live] + at]
        stop = differ != 0
        rest = differ[stop]
        equal = np.zeros(len(rest), np.int32)
        for k in range(1, 8):
            equal += rest < (np.uint64(1) << np.uint64(64 - 8 * k))
        out[live[stop]] = at + equal
        live = live[~stop]
        if not len(live):
            break
    out[live] = most
    return np.minimum(out, most)


def repeated_windows(runs: list[bytes], again: list[bool]) -> list[np.ndarray]:
    """For each run of bytes, which of its windows occur elsewhere: in another run, twice in
    this one, or all of them if the run itself occurs ``again``."""
    text = np.frombuffer(b"".join(runs), np.uint8)
    sizes = np.array([len(r) for r in runs])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    window = np.ones(len(text), bool)                   # places where a whole window starts in a run
    for back in begin[1:]:
        window[max(0, back - LENGTH + 1):back] = False
    words = _words(text)
    order = suffix_order(text, words=words)
    order = order[window[order]]
    equal = common_prefixes(text, order, words=words) >= LENGTH
    marked = np.zeros(len(text), bool)
    marked[order[:-1][equal]] = True
    marked[order[1:][equal]] = True
    return [np.ones(n - LENGTH + 1, bool) if more else marked[a:a + n - LENGTH + 1] for a, n, more in zip(begin, sizes, again)]


def _spans(marks: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
    return edge[::2].tolist(), (edge[1::2] - 1).tolist()


def _fields(lists: pa.ListArray, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Bounds of the lists of structs of a column, and the fields of all of them."""
    ends = lists.offsets.to_numpy()
    values = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0]))
    return ends - ends[0], [values.field(n).to_numpy(zero_copy_only=False) for n in names]


def _runs_of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (np.int64, np.int64, np.int32, np.int32)
    for batch in portions(batches):
        keys, ends, cols = [], [0], ([], [], [], [])
        for key, data in zip(batch.column(0), batch.column(1)):
            data = data.as_py()
            name, first, last = _named(data)
            if len(name):
                keys.append(key.as_py())
                ends.append(ends[-1] + len(name))
                view = memoryview(data)
                digest = [xxhash.xxh3_64_intdigest(view[a:b + LENGTH]) for a, b in zip(first.tolist(), last.tolist())]
                for c, v in zip(cols, (name, np.array(digest, np.uint64).view(np.int64), first.astype(np.int32), last.astype(np.int32))):
                    c.append(v)
        offsets = pa.array(ends, pa.int32())
        yield pa.record_batch([pa.array(keys, pa.binary()), *(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c) if c else np.zeros(0, k)))
                                                              for c, k in zip(cols, kinds))], names=["key", "name", "digest", "first", "last"])


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with a list of runs to the runs' bytes."""
    for batch in portions(batches, column=0, most=1 << 19):
        ends, (first, last, *rest) = _fields(batch.column(1), ["first", "last", "name", "digest", "n", "hot"])
        cut = []
        for k, data in enumerate(batch.column(0)):
            lo, hi = ends[k], ends[k + 1]
            view = memoryview(data.as_py())
            cut += [bytes(view[a:b + LENGTH]) for a, b in zip(first[lo:hi].tolist(), last[lo:hi].tolist())]
        yield pa.record_batch([*(pa.array(r, t) for r, t in zip(rest, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()))), pa.array(cut, pa.binary())],
                              names=["name", "digest", "n", "hot", "bytes"])


def _sorted_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``name, digest, n, bytes`` in order of name to the spans of repeated windows. Whole
    names are sorted together, of about ``SORT_BYTES`` at once or a single larger one."""
    held: list[tuple] = []
    name: list[tuple] = []          # rows of the name that is being read
    size = more = 0

    def out(rows: list[tuple]) -> pa.RecordBatch:
        found = [_spans(m) for m in repeated_windows([r[3] for r in rows], [r[2] > 1 for r in rows])]
        some = [(r, f) for r, f in zip(rows, found) if f[0]]
        return pa.record_batch([pa.array([r[0] for r, _ in some], pa.int64()), pa.array([r[1] for r, _ in some], pa.int64()),
                                pa.array([f[0] for _, f in some], pa.list_(pa.int32())), pa.array([f[1] for _, f in some], pa.list_(pa.int32()))],
                               names=["name", "digest", "lo", "hi"])

    for batch in portions(batches, column=3):
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if name and row[0] != name[0][0]:
                if held and size + more > SORT_BYTES:
                    yield out(held)
                    held, size = [], 0
                held += name
                size, name, more = size + more, [], 0
            name.append(row)
            more += len(row[3])
    if held and size + more > SORT_BYTES:
        yield out(held)
        held = []
    if held or name:
        yield out(held + name)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``name, digest, n, bytes`` to a row for each window with its digest."""
    for batch in portions(batches, column=3):
        for name, digest, n, data in zip(*(c.to_pylist() for c in batch.columns)):
            view = memoryview(data)
            keys = [xxhash.xxh3_128_digest(view[i:i + LENGTH]) for i in range(len(data) - LENGTH + 1)]
            k = len(keys)
            yield pa.record_batch([pa.array(keys, pa.binary()), pa.array([name] * k, pa.int64()), pa.array([digest] * k, pa.int64()),
                                   pa.array([n] * k, pa.int64()), pa.array(range(k), pa.int32())], names=["w", "name", "digest", "n", "at"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with the spans of repeated windows to what is left of them."""
    for batch in portions(batches):
        ends, (lows, highs) = _fields(batch.column(2), ["lo", "hi"])
        rows: tuple[list, ...] = ([], [], [], [])
        for k, (key, data) in enumerate(zip(batch.column(0), batch.column(1))):
            data = np.frombuffer(data.as_py(), np.uint8)
            change = np.zeros(len(data) + 1, np.int32)
            np.add.at(change, lows[ends[k]:ends[k + 1]], 1)
            np.add.at(change, highs[ends[k]:ends[k + 1]] + LENGTH, -1)
            gone = np.cumsum(change)[:-1] > 0
            for c, v in zip(rows, (key.as_py(), int(gone.sum()), len(_spans(gone)[0]), data[~gone].tobytes())):
                c.append(v)
        yield pa.record_batch([pa.array(c, t) for c, t in zip(rows, (pa.binary(), pa.int64(), pa.int64(), pa.binary()))],
                              names=["key", "n_removed", "n_spans", "left"])


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    data = text_of(text_col).cast("binary")
    return docs.select(F.unhex(F.sha2(data, 256)).alias("key"), data.alias("data"))


def repeated_spans(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(texts, spans)``: the distinct texts ``key, n_bytes, copies``, and for those with one
    copy the spans ``key, lo, hi`` of windows (first to last) that also occur elsewhere.
    ``key`` is the SHA-256 of the text's bytes."""
    rows = _texts(docs, text_col)
    texts = checkpointed(rows.groupBy("key").agg(F.max(F.octet_length("data")).alias("n_bytes"), F.count("*").alias("copies")))
    copied = checkpointed(texts.filter("copies > 1 and n_bytes >= " + str(LENGTH)).select("key"))
    maybe = rows.withColumn("maybe", maybe_among(copied, "key")("key")).filter(F.octet_length("data") >= LENGTH)
    once = maybe.filter("not maybe").select("key", "data").unionAll(maybe.filter("maybe").select("key", "data").dropDuplicates(["key"]))
    parts = checkpointed(once.mapInArrow(_runs_of_docs, "key binary, name array<long>, digest array<long>, first array<int>, last array<int>"))

    names = checkpointed(parts.select(F.explode("name").alias("name")).groupBy("name").count().filter("count > 1").select("name"))
    flat = parts.select("key", F.explode(F.arrays_zip("name", "digest", "first", "last")).alias("r")).select("key", "r.*")
    runs = checkpointed(flat.filter(maybe_among(names, "name")("name")).join(names.withColumnRenamed("name", "m"), F.col("name") == F.col("m"), "left_semi"))
    # a text that has copies counts once here: all of it is removed anyway, and any match with it is a match
    kinds = runs.groupBy("name", "digest").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "last")).alias("place"))
    kinds = checkpointed(kinds)
    widths = kinds.groupBy("name").agg(F.count("*").alias("d")).withColumnRenamed("name", "m")
    sized = kinds.join(widths, F.col("name") == F.col("m")).drop("m")
    whole = sized.filter("d = 1").select("name", "digest")                       # n > 1: the run repeats as a whole
    wanted = (sized.filter("d > 1").select(F.col("place.key").alias("k"), F.struct("name", "digest", "n", F.col("place.first").alias("first"),
                                           F.col("place.last").alias("last"), (F.col("d") > HOT).alias("hot")).alias("r"))
                   .groupBy("k").agg(F.collect_list("r").alias("runs")))         # at most the runs of one text
    wanted = checkpointed(wanted)
    near = rows.filter(maybe_among(wanted, "k")("key")).join(wanted.withColumnRenamed("k", "kk"), F.col("key") == F.col("kk"))
    cut = checkpointed(near.select("key", "data", "runs").dropDuplicates(["key"]).select("data", "runs")
                           .mapInArrow(_cut_runs, "name long, digest long, n long, hot boolean, bytes binary"))

    marks = (cut.filter("not hot").drop("hot").repartition("name").sortWithinPartitions("name")
                .mapInArrow(_sorted_marks, "name long, digest long, lo array<int>, hi array<int>"))
    windows = cut.filter("hot").drop("hot").mapInArrow(_windows, "w binary, name long, digest long, n long, at int")
    often = windows.groupBy("w").agg(F.sum("n").alias("s")).filter("s > 1").withColumnRenamed("w", "v")
    hot = (windows.join(often, F.col("w") == F.col("v")).groupBy("name", "digest").agg(F.array_sort(F.collect_set("at")).alias("lo"))
                  .select("name", "digest", "lo", F.col("lo").alias("hi")))
    listed = checkpointed(marks.unionAll(hot))
    pairs = listed.select(F.col("name").alias("n2"), F.col("digest").alias("d2"), F.explode(F.arrays_zip("lo", "hi")).alias("s"))
    sure = whole.select(F.col("name").alias("n2"), F.col("digest").alias("d2"))
    in_part = runs.join(pairs, (F.col("name") == F.col("n2")) & (F.col("digest") == F.col("d2"))).select(
        "key", (F.col("first") + F.col("s.lo")).alias("lo"), (F.col("first") + F.col("s.hi")).alias("hi"))
    in_whole = runs.join(sure, (F.col("name") == F.col("n2")) & (F.col("digest") == F.col("d2"))).select(
        "key", F.col("first").alias("lo"), F.col("last").alias("hi"))
    return texts, in_part.unionAll(in_whole)


def without_repeats(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(texts, changed)``: as ``repeated_spans`` gives ``texts``, and for the texts that lose
    bytes ``key, n_removed, n_spans, left``. A text with copies of at least ``LENGTH`` bytes loses
    all and is not in ``changed``; shorter ones lose nothing."""
    texts, spans = repeated_spans(docs, text_col)
    by_text = checkpointed(spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))    # at most the runs of one text
    lone = texts.filter("copies = 1").select(F.col("key").alias("k1"))
    rows = _texts(docs, text_col)
    hit = rows.filter(maybe_among(by_text, "key")("key")).join(by_text.withColumnRenamed("key", "k"), F.col("key") == F.col("k"))
    hit = hit.join(lone, F.col("key") == F.col("k1"), "left_semi")
    return texts, hit.select("key", "data", "spans").mapInArrow(_removed, "key binary, n_removed long, n_spans long, left binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``.

    Texts are UTF-8 bytes; null is the empty text. Each row is a document, also where rows
    repeat: then each is a copy of the other and loses all, if it has ``LENGTH`` bytes.
    """
    texts, changed = without_repeats(docs, text_col)
    changed = changed.select(F.col("key").alias("k"), "n_removed", "n_spans", F.sha2("left", 256).alias("sha"))
    data = text_of(text_col).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(data).cast("long").alias("n_bytes"), F.unhex(F.sha2(data, 256)).alias("key"))
    copied = texts.filter(f"copies > 1 and n_bytes >= {LENGTH}").select(F.col("key").alias("c"))
    joined = rows.join(copied, F.col("key") == F.col("c"), "left").join(changed, F.col("key") == F.col("k"), "left")
    gone, nothing = F.col("c").isNotNull(), hashlib.sha256(b"").hexdigest()
    return joined.select(F.col("id").alias(id_col), "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                         F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                         F.when(gone, F.lit(nothing)).otherwise(F.coalesce("sha", F.lower(F.hex("key")))).alias("kept_sha256"))
