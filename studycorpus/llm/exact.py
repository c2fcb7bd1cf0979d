"""Exact duplicates by two passes over a Bloom filter.

First pass: every task marks the bits of its text hashes in two bit sets, *once* and
*twice*; merging the sets of all tasks leaves in *twice* each bit that two rows have set.
Second pass: a row all of whose bits are in *twice* may be repeated and is shuffled; any
other row is unique for certain and passes straight through.

The filter has about 16 bits a row, at least 2**16 and at most ``MAX_BITS`` (32 MB), which
bounds what is collected and broadcast. Beyond that size more unique rows are taken for
possible repeats; the result stays the same.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from studycorpus.llm.base import checkpointed, free_names, text_of
from studycorpus.plans.scale import first_rows

#: Fixed by the definition of equal texts: blank and U+0009 to U+000D.
WHITE = " \t\n\x0b\x0c\r"
MAX_BITS = 1 << 28
BLOCK = 1 << 15          # bits that are merged together
FEW = 1 << 10            # up to so many bits of a block are sent as positions


def normal_hash(text: Column) -> Column:
    """SHA-256 of the text without white space, as 32 bytes."""
    return F.unhex(F.sha2(F.translate(text, WHITE, ""), 256))


def _positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two different bits for each hash."""
    h = hashes.astype(np.int64).view(np.uint64)
    p, q = h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)
    return np.stack([p, np.where(p == q, p ^ np.uint64(1), q)]).astype(np.int64)


def _set(store: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(store, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))


def _get(store: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (store[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _packed(block: np.ndarray) -> bytes:
    at = np.flatnonzero(np.unpackbits(block, bitorder="little"))
    return b"p" + at.astype("<u2").tobytes() if len(at) <= FEW else b"b" + block.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if data[:1] == b"b":
        return np.frombuffer(data, np.uint8, offset=1)
    block = np.zeros(BLOCK // 8, np.uint8)
    _set(block, np.frombuffer(data, "<u2", offset=1).astype(np.int64))
    return block


def bit_filter(hashes: DataFrame, bits: int, times: int) -> np.ndarray:
    """Bit set *once* (``times`` 1) or *twice* (2) of a one-column table of 64-bit hashes."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at, times = np.unique(_positions(batch.column(0).to_numpy(zero_copy_only=False), bits), return_counts=True)
            _set(twice, at[(times > 1) | _get(once, at)])
            _set(once, at)
        blocks = once.reshape(-1, BLOCK // 8)
        for k in np.array_split(used := np.flatnonzero(blocks.any(axis=1)), max(1, len(used) // 256)):
            yield pa.record_batch([pa.array(k.astype(np.int32)), pa.array([_packed(blocks[i]) for i in k], pa.binary()),
                                   pa.array([_packed(twice.reshape(-1, BLOCK // 8)[i]) for i in k], pa.binary())],
                                  names=["block", "once", "twice"])

    def merge(key, table):
        once, twice = np.zeros(BLOCK // 8, np.uint8), np.zeros(BLOCK // 8, np.uint8)
        for o, t in zip(table.column("once").to_pylist(), table.column("twice").to_pylist()):
            o = _unpacked(o)
            twice |= _unpacked(t) | (once & o)
            once |= o
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "set": pa.array([(once, twice)[times - 1].tobytes()], pa.binary())})

    sets = hashes.mapInArrow(fill, "block int, once binary, twice binary")
    merged = sets.groupBy("block").applyInArrow(merge, "block int, set binary")
    out = np.zeros((bits // BLOCK, BLOCK // 8), np.uint8)
    for row in merged.toLocalIterator():   # at most MAX_BITS / 8 bytes
        out[row["block"]] = np.frombuffer(row["set"], np.uint8)
    return out.reshape(-1)


def _tester(hashes: DataFrame, rows: int, times: int, max_bits: int):
    """A function from a column of hashes to a column that is false only for hashes that
    occur fewer than ``times`` times."""
    bits = min(max(1 << 16, 1 << int(16 * max(rows, 1) - 1).bit_length()), max_bits)
    store = hashes.sparkSession.sparkContext.broadcast(bit_filter(hashes, bits, times))

    @F.pandas_udf(BooleanType())
    def test(h):
        import pandas as pd
        at = _positions(h.to_numpy(), bits)
        return pd.Series(_get(store.value, at[0]) & _get(store.value, at[1]))

    return test


def maybe_repeated(digests: DataFrame, column: str = "sha", max_bits: int = MAX_BITS):
    """A function from a digest column to a column that is false only for unique rows."""
    test = _tester(digests.select(F.xxhash64(column).alias("h")), digests.count(), 2, max_bits)
    return lambda c: test(F.xxhash64(c))


def maybe_among(ids: DataFrame, column: str, max_bits: int = MAX_BITS):
    """A function from an id column to a column that is false only for ids that are not in ``ids``."""
    test = _tester(ids.select(F.xxhash64(column).alias("h")), ids.count(), 1, max_bits)
    return lambda c: test(F.xxhash64(c))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: which document of its group of equal texts stays.

    Texts are equal when they are identical without white space; null counts as empty, so
    empty and white texts form one group. The text with the most code points stays, then
    the smallest id (null last). Returns ``id_col``, ``keep_id``, ``group_size``, ``kept``
    (own id is the one that stays), ``text_sha256`` (of the text without white space).
    A row that is repeated with its id counts twice in its group and is kept both times.
    Texts are read once; only 48-byte digests of possibly repeated rows are shuffled.
    """
    text = text_of(text_col)
    digests = checkpointed(docs.select(F.col(id_col).alias("id"), F.length(text).alias("n"), normal_hash(text).alias("sha")))
    flagged = digests.withColumn("maybe", maybe_repeated(digests, max_bits=max_bits)("sha"))
    shuffled, alone = flagged.filter("maybe"), flagged.filter("not maybe")
    first = shuffled.groupBy("sha").agg(F.count("*").alias("group_size"),
                                        F.min(F.struct(-F.col("n"), F.col("id").isNull().alias("last"), "id")).alias("w"))
    joined = shuffled.join(first.withColumnRenamed("sha", "k"), F.col("sha") == F.col("k"))
    rows = joined.select("id", F.col("w.id").alias("keep_id"), "group_size", "sha").unionAll(
        alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long"), "sha"))
    return rows.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
                       F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The documents without exact copies, with all their columns: the row that stays, once.

    Same rule as ``exact_groups``; of a row that is repeated with its id, one stays. Rows
    that the filter clears are not shuffled; of the others each task sends one per text.
    Columns may have any names.
    """
    sha = normal_hash(text_of(text_col))
    maybe = maybe_repeated(checkpointed(docs.select(sha.alias("sha"))), max_bits=max_bits)
    key, flag, n, rank = free_names(docs.columns, "_sha", "_maybe", "_n", "_rank")
    columns = [f"`{c}`" for c in docs.columns]
    flagged = docs.withColumn(key, sha).withColumn(flag, maybe(key))
    firsts = first_rows(flagged.filter(F.col(flag)).withColumn(n, F.length(text_of(text_col))), [key],
                        [F.col(n).desc(), F.col(id_col).asc_nulls_last()], rank=rank)
    return firsts.select(*columns).unionAll(flagged.filter(~F.col(flag)).select(*columns))
