"""Near-duplicate vectors by cross-polytope hashing, with verified links.

Hashing (Andoni et al., 2015): a vector is rotated by three rounds of random signs and a
fast Hadamard transform; its hash is the nearest of the 2d signed axes. A key joins
``FUNCTIONS`` such hashes. In each table a vector takes its own key and, as probes, the
keys with the second nearest axis in one function, and is entered under all of them. In 64
dimensions two vectors of cosine 0.95 share a key of a table with probability 0.67, so
``TABLES`` tables miss a pair with probability 2e-6; closer pairs are missed less. Other
dimensions and cosines get as many tables as ``MISS`` asks for; over ``MAX_TABLES`` is an error.

Verification: the vectors of a bucket are multiplied with each other in double precision,
in blocks of bounded size. A pair that shares several keys is counted under the least of
them only, so counts need no list of pairs: a block sends one row per vector, with its
number of links and the smallest vector that it reaches inside the block.

Equal vectors collapse first and count with their number. Buckets with one vector, or with
the same vectors as another bucket, are left out.
"""
from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from studycorpus.llm.base import checkpointed, components

COSINE = 0.95
TABLES, FUNCTIONS = 12, 3
#: Most probability to miss a pair of exactly the cosine, and the tables that may take.
MISS, MAX_TABLES = 2e-6, 256
PAIRS = 10_000
LEAST = 64
BLOCK = 512
SEED = 31


@functools.lru_cache(maxsize=8)
def _signs(dimension: int, tables: int) -> np.ndarray:
    rng = np.random.default_rng([SEED, dimension])
    return rng.choice(np.array([-1.0, 1.0]), (tables, FUNCTIONS, 3, dimension))


def _width(dimension: int) -> int:
    """Width of the transform. Three rounds of signs on less than ``LEAST`` values give too few rotations."""
    return max(LEAST, 1 << (dimension - 1).bit_length())


def _axes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest and second nearest signed axis of each row."""
    size, rows = np.abs(y), np.arange(len(y))
    first = size.argmax(axis=1)
    size[rows, first] = -1
    second = size.argmax(axis=1)
    return 2 * first + (y[rows, first] > 0), 2 * second + (y[rows, second] > 0)


@functools.lru_cache(maxsize=64)
def tables_for(dimension: int, cosine: float) -> int:
    """Tables that miss a pair of this cosine with probability ``MISS`` at most.

    The share of pairs with a common key of one table is counted on ``PAIRS`` pairs with
    evenly turned coordinates, two standard errors taken off.
    """
    width = _width(dimension)
    if dimension == 1 or (width <= LEAST and cosine >= COSINE):
        return TABLES if dimension >= 8 else TABLES + 4       # few values turn less evenly
    rng, shared = np.random.default_rng([SEED, width]), 0
    for at in range(0, PAIRS, 1000):
        a, b = np.zeros((2, 1 + FUNCTIONS, 1000), np.int64)
        for f in range(FUNCTIONS):
            x, y = rng.standard_normal((2, 1000, width), np.float32)
            y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y
            for keys, (near, next_) in ((a, _axes(x)), (b, _axes(y))):
                for probe in range(-1, FUNCTIONS):
                    keys[probe + 1] = keys[probe + 1] * 2 * width + (next_ if f == probe else near)
        shared += int((a[:, None] == b[None]).any(axis=(0, 1)).sum())
    share = min(shared, PAIRS - 1) / PAIRS
    share -= 2 * math.sqrt(share * (1 - share) / PAIRS)
    tables = math.ceil(math.log(MISS) / math.log1p(-share)) if share > 0 else MAX_TABLES + 1
    if tables > MAX_TABLES:
        raise ValueError(f"vectors of {dimension} dimensions need more than {MAX_TABLES} tables for cosine {cosine}")
    return max(TABLES, tables)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def keys_of(x: np.ndarray, cosine: float = COSINE) -> np.ndarray:
    """Keys of unit vectors, ``tables_for(...) * (1 + FUNCTIONS)`` a row."""
    n, dimension = x.shape
    width, tables = _width(dimension), tables_for(dimension, cosine)
    padded = np.zeros((n, width))
    padded[:, :dimension] = x
    signs, out = _signs(width, tables), []
    for table in range(tables):
        near, next_ = [], []
        for f in range(FUNCTIONS):
            y = padded
            for r in range(3):
                y = hadamard(y * signs[table, f, r])
            for found, axis in zip((near, next_), _axes(y)):
                found.append(axis)
        for probe in range(-1, FUNCTIONS):
            key = np.full(n, (dimension * MAX_TABLES + table) * (1 + FUNCTIONS), np.uint64)
            for f in range(FUNCTIONS):
                key = (key ^ (next_ if f == probe else near)[f].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out.append(key.view(np.int64))
    return np.stack(out, axis=1)


def _unit(values: list | None) -> np.ndarray | None:
    """The vector with length 1, or nothing if it cannot link."""
    if not values or any(v is None for v in values):
        return None
    x = np.asarray(values, float)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _hashed(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at in range(0, len(ids), 2048):
                raw = batch.column(1).slice(at, 2048).to_pylist()
                units = [_unit(v) if i is not None else None for i, v in zip(ids[at:at + 2048], raw)]
                keys: list = [None] * len(units)
                for d in {len(u) for u in units if u is not None}:
                    rows = [i for i, u in enumerate(units) if u is not None and len(u) == d]
                    for i, k in zip(rows, keys_of(np.stack([units[i] for i in rows]), cosine)):
                        keys[i] = np.unique(k)
                yield pa.record_batch([pa.array(ids[at:at + 2048], pa.int64()),
                                       pa.array([None if u is None else hashlib.blake2b(np.asarray(v, float).tobytes(), digest_size=16).digest()
                                                 for u, v in zip(units, raw)], pa.binary()),
                                       pa.array([None if u is None else u.tobytes() for u in units], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                                      names=["id", "content", "unit", "keys"])
    return run


def _labels(linked: np.ndarray) -> np.ndarray:
    """Smallest row that each row reaches over a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _block_links(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None
        out: tuple[list, list, list] = ([], [], [])

        def compare() -> None:
            key, i, j = at
            o = np.array([r[0] for r in held])
            a, b = np.flatnonzero(o == i), np.flatnonzero(o == j)
            if not len(a) or not len(b) or (i == j and len(a) < 2):
                return
            unit = np.stack([np.frombuffer(r[3]) for r in held])
            close = unit[a] @ unit[b].T >= cosine
            if i == j:
                np.fill_diagonal(close, False)
            if not close.any():
                return
            node, weight = np.array([r[1] for r in held]), np.array([r[2] for r in held])
            # the pairs that share a key before this one are counted there
            earlier = [np.frombuffer(r[4], np.int64) for r in held]
            earlier = [e[e < key] for e in earlier]
            names, place = np.unique(np.concatenate(earlier), return_inverse=True)
            if len(names):
                shared = np.zeros((len(held), len(names)), np.float32)
                shared[np.repeat(np.arange(len(held)), [len(e) for e in earlier]), place] = 1
                shared = shared[:, (shared.sum(axis=0) > 1)]
                counted = close & (shared[a] @ shared[b].T == 0)
            else:
                counted = close
            links = np.zeros(len(held), np.int64)
            links[a] += counted @ weight[b]
            if i != j:
                links[b] += counted.T @ weight[a]
            graph = np.zeros((len(held), len(held)), bool)
            graph[np.ix_(a, b)] = close
            graph |= graph.T
            least = node[_labels(graph)]           # rows are in order of node
            for row in np.flatnonzero((links > 0) | (least != node)):
                for c, v in zip(out, (int(node[row]), int(links[row]), int(least[row]))):
                    c.append(v)

        def send() -> pa.RecordBatch:
            got = pa.record_batch([pa.array(c, pa.int64()) for c in out], names=["node", "links", "least"])
            for c in out:
                c.clear()
            return got

        for batch in batches:
            for key, i, j, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, i, j) != at:
                    if held:
                        compare()
                    held, at = [], (key, i, j)
                    if len(out[0]) > 50_000:
                        yield send()
                held.append(rest)
        if held:
            compare()
        yield send()
    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per vector: ``id_col``, ``n_links`` (other vectors of cosine ``cosine`` or more),
    ``component_id`` (smallest id reachable by links, its own included), ``kept`` (own id is that one).

    Null and zero vectors, vectors with null or non-finite components and rows without id
    link with nothing. Vectors of different length do not link. Ids are 64-bit integers and
    name a vector; rows repeated with their id count as links of each other. A cosine that is
    too low for ``MAX_TABLES`` tables in a vector's dimension is an error.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    hashed = checkpointed(rows.mapInArrow(_hashed(cosine), "id long, content binary, unit binary, keys array<long>"))
    contents = hashed.filter("content is not null").groupBy("content").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = checkpointed(hashed.join(contents.withColumnRenamed("content", "c"), (F.col("content") == F.col("c")) & (F.col("id") == F.col("rep")))
                              .dropDuplicates(["id", "content"]).select(F.col("id").alias("node"), "n", "unit", "keys"))

    entered = reps.select(F.explode("keys").alias("key"), "node")
    buckets = (entered.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("lo"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"))
                      .filter("m > 1").groupBy("m", "lo", "s").agg(F.min("key").alias("key")).select("key", "m"))
    members = checkpointed(entered.join(buckets, "key"))
    own_keys = members.groupBy("node").agg(F.collect_list(F.struct("key", "m")).alias("ks"))     # at most MAX_TABLES * (1 + FUNCTIONS)
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    cell = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1),
                                 lambda j: F.struct(F.least(j, F.col("o")).alias("i"), F.greatest(j, F.col("o")).alias("j"))))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pa.array([np.array(sorted(k), np.int64).tobytes() for k in batch.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], keys], names=["node", "n", "unit", "ks", "keys"])

    carried = (reps.select("node", "n", "unit").join(own_keys.withColumnRenamed("node", "k"), F.col("node") == F.col("k"))
                   .select("node", "n", "unit", "ks", F.col("ks.key").alias("keys"))
                   .mapInArrow(packed, "node long, n long, unit binary, ks array<struct<key:bigint,m:bigint>>, keys binary"))
    grid = (carried.select("node", "n", "unit", "keys", F.explode("ks").alias("e")).select("node", "n", "unit", "keys", "e.key", "e.m")
                   .withColumn("o", F.pmod(F.xxhash64("node", "key"), blocks).cast("int")).withColumn("g", cell)
                   .select("key", "g.i", "g.j", "o", "node", "n", "unit", "keys"))
    links = checkpointed(grid.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
                             .mapInArrow(_block_links(cosine), "node long, links long, least long"))
    counts = links.groupBy(F.col("node").alias("c_node")).agg(F.sum("links").alias("links"))
    comps = components(links.filter("node <> least"), "node", "least").withColumnRenamed("node", "k_node")

    named = (hashed.select("id", "content").join(contents.withColumnRenamed("content", "c"), F.col("content") == F.col("c"), "left")
                   .join(counts, F.col("rep") == F.col("c_node"), "left").join(comps, F.col("rep") == F.col("k_node"), "left"))
    component = F.coalesce("component", "rep", "id")
    return named.select(F.col("id").alias(id_col), F.coalesce(F.col("links") + F.col("n") - 1, F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"),
                        component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
