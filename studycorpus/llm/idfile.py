"""Token ids in files: documents compressed one by one with a shared zstandard dictionary.

The file format is a table of shards in ascending order of ``doc_id``. A shard holds the
frames of its documents one after the other (``frames``), an offset index (``index``: for
each document the offset of its frame and the number of its ids, as little-endian
unsigned 64-bit integers, with one closing entry), the documents' ids (``doc_ids``), the
number of token ids before it in its range of documents (``ids_before``), and the SHA-256 of the dictionary its frames need (``dictionary``). The dictionary itself is
stored beside the shards. One document is read by its shard's row, two index entries and
one frame.
"""
from __future__ import annotations

import functools
import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from studycorpus.llm.base import portions, shared_folder, slices, text_of
from studycorpus.llm.words import LONG_WORD, memory, words

SAMPLE_DOCS = 2_000          # bound of the sample that the dictionary is trained on
SAMPLE_IDS = 4_096           # most ids of a sample document
DICTIONARY_BYTES = 64 << 10
SHARD_BYTES = 4 << 20        # frames in a shard before the next begins
SHARD_DOCS = 20_000
RANGE_DOCS = 5_000           # documents of a range of ids, the unit of the shuffle
LEVEL = 3
PORTION_DOCS = 2_048         # documents, and bytes of text, whose words are looked up together
PORTION_BYTES = 8 << 20


def _library_ids(path: str, texts: list[str], end_id: int) -> Iterator[bytes]:
    """Ids as the library gives them, with the end id. Each distinct word of the texts is looked
    up once and each new pre-token encoded once; words that occur twice are remembered."""
    w, known, end = words(path), memory(path, "library ids"), array("I", [end_id]).tobytes()
    new: dict[str, bytes] = {}

    def of(word: str) -> bytes:
        if word in w.special:
            out = array("I", [w.special[word]]).tobytes()
        elif word.isascii() and word.isalpha():
            out = array("I", w.ids(word)).tobytes()
        elif not w.is_plain(word):
            out = array("I", [i for p in w.pieces_of_word(word) for i in w.ids(p)]).tobytes()
        elif len(parts := w.parts_of_plain(word)) == 1:
            out = array("I", w.ids(w.mapped(word))).tobytes()
        else:                                      # each part is what it is as a word
            out = b"".join([known.get(p) or new.get(p) or of(p) for p in parts])
        new[word] = out
        return out

    lowered = [w.lowered(t) for t in texts]
    lists = pc.ascii_split_whitespace(pa.array([t or "" for t in lowered], pa.large_string()))
    ends = lists.offsets.to_pylist()
    coded = lists.flatten().dictionary_encode()
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    known.room(distinct)
    ids = [known.get(x) or new.get(x) or of(x) for x in distinct]
    for i in np.flatnonzero(np.bincount(coded.indices) > 1).tolist():
        if len(distinct[i]) <= LONG_WORD:
            known[distinct[i]] = ids[i]
    # the words of all texts in a row become their ids in a row, so that a text is a slice of them
    row = pa.array(ids, pa.large_binary()).take(coded.indices)
    lowered = [t is not None for t in lowered]
    del lists, coded, distinct, ids
    pa.default_memory_pool().release_unused()      # else a worker keeps what the row was made of
    at = np.frombuffer(row.buffers()[1], np.int64)[row.offset:] if len(row) else np.zeros(1, np.int64)
    data = memoryview(row.buffers()[2] or b"")
    for text, in_row, lo, hi in zip(texts, lowered, ends, ends[1:]):
        if not in_row:
            yield b"".join([known.get(x) or new.get(x) or of(x) for x in w.split(text)]) + end
        else:
            yield bytes(data[at[lo]:at[hi]]) + end


@functools.lru_cache(maxsize=4)
def _codec(dictionary: bytes):
    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (zstandard.ZstdCompressor(level=LEVEL, dict_data=d), zstandard.ZstdDecompressor(dict_data=d))


def train_dictionary(docs: DataFrame, vocabulary: str, id_col: str, text_col: str, end_id: int) -> bytes:
    """Dictionary from the id arrays of ``SAMPLE_DOCS`` documents, those with the smallest
    hash of their id; empty if there are too few to train one. It changes the size of the
    files only."""
    h = F.xxhash64(F.col(id_col).cast("string"))
    last = docs.select(h.alias("h")).orderBy("h").limit(SAMPLE_DOCS).agg(F.max("h")).first()[0]
    sample = docs.filter(h <= (last if last is not None else 0)).select(text_of(text_col).alias("text")).limit(2 * SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0, PORTION_BYTES, PORTION_DOCS):
            texts = [t[:8 * SAMPLE_IDS] for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([b[:4 * SAMPLE_IDS] for b in _library_ids(vocabulary, texts, end_id)], pa.binary())], names=["ids"])

    ids = sorted(bytes(r[0]) for r in sample.mapInArrow(run, "ids binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, ids).as_bytes() if len(ids) >= 8 else b""
    except zstandard.ZstdError:                  # too little or too uniform data
        return b""


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, add ``end_id``, and write the files to ``folder``.

    Documents are in ascending order of id; a null id comes first, equal ids are ordered by
    their frames' bytes. Null and empty texts have the end id alone. The scan encodes and
    compresses, only frames are shuffled, to ranges of ids with about ``RANGE_DOCS``
    documents; a range with a hot id is as large as that id.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, vocabulary, id_col, text_col, end_id)
    mark = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(mark, bytearray(dictionary))], "dictionary string, bytes binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ranges = _ranges(rows.select("doc_id"))
    edges = spark.sparkContext.broadcast(np.array(ranges, np.int64))

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _codec(shared.value)[0].compress
        for batch in portions(batches, 1, PORTION_BYTES, PORTION_DOCS):
            n, frames = [], []
            for b in _library_ids(vocabulary, batch.column(1).to_pylist(), end_id):
                n.append(len(b) // 4)
                frames.append(pack(b))
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            at = np.searchsorted(edges.value, ids, side="right")
            yield pa.record_batch([pa.array(at.astype(np.int32)), batch.column(0), pa.array(n, pa.int64()), pa.array(frames, pa.binary())],
                                  names=["range", "doc_id", "n", "frame"])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, n, data, size, at, before = [], [], [], 0, None, 0

        def out() -> pa.RecordBatch:
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in data])]).astype("<u8")
            index = np.stack([offsets, np.array([*n, 0], "<u8")], axis=1).tobytes()
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([next((i for i in ids if i is not None), None)], pa.int64()), pa.array([ids[-1]], pa.int64()), pa.array([len(ids)], pa.int64()),
                                    pa.array([sum(n)], pa.int64()), pa.array([before], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([index], pa.binary()),
                                    pa.array([b"".join(data)], pa.binary()), pa.array([mark], pa.string())],
                                   names=["range", "first_id", "last_id", "n_docs", "n_ids", "ids_before", "doc_ids", "index", "frames", "dictionary"])

        for batch in slices(batches, 2048):
            for r, i, k, f in zip(*(c.to_pylist() for c in batch.columns)):
                if ids and (r != at or size >= SHARD_BYTES or len(ids) >= SHARD_DOCS):
                    yield out()
                    before = before + sum(n) if r == at else 0
                    ids, n, data, size = [], [], [], 0
                at = r
                ids.append(i)
                n.append(k)
                data.append(f)
                size += len(f)
        if ids:
            yield out()

    parts = max(1, min(len(ranges) + 1, 100_000))
    # one Python stage: a second one behind it would double the worker processes and what they remember
    ordered = (rows.mapInArrow(compress, "range int, doc_id long, n long, frame binary")
                   .repartition(parts, "range").sortWithinPartitions("range", "doc_id", "frame"))
    (ordered.mapInArrow(shards, "range int, first_id long, last_id long, n_docs long, n_ids long, ids_before long, doc_ids array<long>, "
                                "index binary, frames binary, dictionary string")
            .write.parquet(f"{folder}/shards"))


def _ranges(ids: DataFrame) -> list[int]:
    """Edges that cut the ids into ranges of about ``RANGE_DOCS`` documents: approximate
    quantiles of all ids, at most 100,000 of them."""
    n = ids.count()
    parts = min(n // RANGE_DOCS, 100_000)
    if parts < 2:
        return []
    cuts = ids.filter("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted({int(c) for c in cuts})


def read_dictionary(spark: SparkSession, folder: str) -> dict[str, bytes]:
    return {r["dictionary"]: bytes(r["bytes"]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}


def range_starts(shards: DataFrame) -> DataFrame:
    """Number of ids before each range; at most 100,000 ranges (see ``_ranges``), a row each."""
    totals = shards.groupBy("range").agg(F.sum("n_ids").alias("t"))
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))


def read_ids(spark: SparkSession, folder: str, as_crc32: bool = False) -> DataFrame:
    """The files as rows ``doc_id, start, n_tokens, ids`` (ids as little-endian unsigned 32-bit
    integers), or with ``ids_crc32`` in their place, worked out in the task that reads them."""
    shards = spark.read.parquet(f"{folder}/shards")
    dictionaries = read_dictionary(spark, folder)
    name = "ids_crc32" if as_crc32 else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for doc_ids, index, frames, mark, start in zip(*(c.to_pylist() for c in batch.columns)):
                unpack = _codec(dictionaries[mark])[1].decompress
                index = np.frombuffer(index, "<u8").reshape(-1, 2)
                at, n = index[:, 0].astype(np.int64), index[:-1, 1].astype(np.int64)
                starts = start + np.concatenate([[0], np.cumsum(n)[:-1]])
                for lo in range(0, len(n), 512):
                    hi = min(lo + 512, len(n))
                    ids = (unpack(frames[at[i]:at[i + 1]], max_output_size=int(4 * n[i])) for i in range(lo, hi))
                    last = pa.array(map(zlib.crc32, ids), pa.int64()) if as_crc32 else pa.array(ids, pa.binary())
                    yield pa.record_batch([pa.array(doc_ids[lo:hi], pa.int64()), pa.array(starts[lo:hi], pa.int64()), pa.array(n[lo:hi], pa.int64()), last],
                                          names=["doc_id", "start", "n_tokens", name])

    rows = shards.join(F.broadcast(range_starts(shards)), "range")
    return rows.select("doc_ids", "index", "frames", "dictionary", F.col("start") + F.col("ids_before")).mapInArrow(run, f"doc_id long, start long, n_tokens long, {name} {'long' if as_crc32 else 'binary'}")


def read_one(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with this id: reads the shards whose span holds it, and of those one frame each."""
    dictionaries, out = read_dictionary(spark, folder), []
    rows = spark.read.parquet(f"{folder}/shards").filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("range", "ids_before")
    hit = rows.select("dictionary", "index", F.array_position("doc_ids", F.lit(doc_id).cast("long")).alias("k"),
                      F.size(F.filter("doc_ids", lambda x: x == doc_id)).alias("m"), "frames").filter("k > 0")
    for r in hit.toLocalIterator():
        index = np.frombuffer(bytes(r["index"]), "<u8").reshape(-1, 2).astype(np.int64)
        for i in range(r["k"] - 1, r["k"] - 1 + r["m"]):
            frame = bytes(r["frames"][index[i, 0]:index[i + 1, 0]])
            out.append(np.frombuffer(_codec(dictionaries[r["dictionary"]])[1].decompress(frame, max_output_size=int(4 * index[i, 1])), "<u4"))
    return out


def roundtrip(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder, read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, folder, vocabulary, end_id, id_col, text_col)
    return read_ids(spark, folder, as_crc32=True)
