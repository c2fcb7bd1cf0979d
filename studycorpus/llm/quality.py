"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Random indexing: each word unit has a fixed sparse index vector (``ONES`` entries of +1 or
-1, chosen by its hash); the vector of a unit is the sum of the index vectors of the units
next to it, over all documents. Units are hashed to ``UNITS`` rows, so the table of vectors
has one size whatever the corpus. Sums are integers, so they do not depend on the order of
tasks. A document is the mean of its units' normalised vectors, and a two-layer network
with one temperature, fitted on rows that did not train it, gives the probability.

Units of a word are its lower-cased letters, its runs of other signs, a mark for its
letter case and its length, and a mark if the word is the one before it. Label, language,
source and id are never looked at.
"""
from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from studycorpus.llm.base import free_names, portions, text_of
from studycorpus.llm.words import LONG_WORD, memory

UNITS, WIDTH, ONES = 1 << 13, 64, 4
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 0.003, 1e-2
#: Bound of the labelled rows that the network is fitted on, those with the smallest hash of
#: their id; the word vectors cover all documents.
FIT_ROWS = 20_000
CALIBRATION_SHARE = 5            # every fifth fitted row only sets the temperature
_PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
REPEAT, EMPTY = 0, 1             # rows of the marks
_REPEATED, _NOTHING = (np.array([row], "<u2").tobytes() for row in (REPEAT, EMPTY))
TOGETHER = 400_000               # units whose contexts are counted together


@functools.lru_cache(maxsize=1)
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each unit's index vector."""
    rng = np.random.default_rng(20)
    return rng.integers(0, WIDTH, (UNITS, ONES)), rng.choice(np.array([-1, 1]), (UNITS, ONES))


def _row(unit: str) -> int:
    return 2 + zlib.crc32(unit.encode()) % (UNITS - 2)


def _units_of_word(word: str) -> bytes:
    out: list[int] = []
    for part in _PARTS.findall(word):
        if part[0].isalpha():
            case = "upper" if part.isupper() and len(part) > 1 else "title" if part[0].isupper() else "lower"
            out += [_row(part.lower()), _row(f" {case}"), _row(f" length {min(len(part), 16) // 4}")]
        else:
            out.append(_row(f" digits {min(len(part), 8)}" if part[0].isdigit() else part))
    return np.array(out, "<u2").tobytes()


def units(text: str) -> np.ndarray:
    """Rows of the units of a text in order; a text without words has the one unit EMPTY."""
    known, out, last = memory("units").room(), [], None
    for word in text.split():
        got = known.get(word)
        if got is None:
            got = _units_of_word(word)
            if len(word) <= LONG_WORD:
                known[word] = got
        out.append(got)
        if word == last:
            out.append(_REPEATED)
        last = word
    return np.frombuffer(b"".join(out) or _NOTHING, "<u2")


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Normalised vectors of all units, from the contexts in all documents.

    Every task adds up its own table and sends the rows that it used; tables are added by
    row, and the result of ``UNITS`` x ``WIDTH`` numbers (2 MB) goes to the driver.
    """
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sign = index_vectors()
        pairs = np.zeros(UNITS * WIDTH, np.int64)
        waiting: list[np.ndarray] = []
        size = 0

        def count() -> None:
            here = np.concatenate(waiting).astype(np.int64)
            inner = np.ones(max(len(here) - 1, 0), bool)         # not across documents
            inner[np.cumsum([len(r) for r in waiting])[:-1] - 1] = False
            a, b = here[:-1][inner], here[1:][inner]
            for word, other in ((a, b), (b, a)):
                for j in range(ONES):
                    pairs[:] += np.bincount(word * WIDTH + at[other, j], sign[other, j], UNITS * WIDTH).astype(np.int64)
            waiting.clear()

        for batch in portions(batches, column=0):
            for text in batch.column(0).to_pylist():
                waiting.append(units(text))
                size += len(waiting[-1])
                if size >= TOGETHER:
                    count()
                    size = 0
        if waiting:
            count()
        table = pairs.reshape(UNITS, WIDTH)
        used = np.flatnonzero(table.any(axis=1))
        yield pa.record_batch([pa.array(used.astype(np.int32)), pa.array(list(table[used].astype(np.int32)), pa.list_(pa.int32()))], names=["unit", "v"])

    def add(key, table):
        total = np.stack([np.asarray(v, np.int64) for v in table.column("v").to_numpy()]).sum(axis=0)
        return pa.table({"unit": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.int64()))})

    sums = (docs.select(text_of(text_col).alias("text")).mapInArrow(contexts, "unit int, v array<int>")
                .groupBy("unit").applyInArrow(add, "unit int, v array<long>"))
    out = np.zeros((UNITS, WIDTH))
    for r in sums.toLocalIterator():
        out[r["unit"]] = r["v"]
    # the mark of a repeat and the unknown units keep their own index vector, so they count too
    at, sign = index_vectors()
    own = np.zeros_like(out)
    np.add.at(own, (np.arange(UNITS)[:, None], at), sign)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    own /= np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-9)
    return (out + own).astype(np.float32)


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    n = np.bincount(units(text), minlength=UNITS)
    row = np.flatnonzero(n)
    return (n[row] @ vectors[row].astype(np.float64)) / n.sum()


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Network:
    """Adam on the logistic loss with a fixed seed, the epoch and then the temperature with the
    least loss on the calibration rows. With one label only, the probability is that label's."""
    calibration = np.arange(len(x)) % CALIBRATION_SHARE == CALIBRATION_SHARE - 1
    if len(x) < 2 * CALIBRATION_SHARE:
        calibration[:] = False
    tx, ty = x[~calibration], y[~calibration]
    if len(ty) == 0 or ty.min() == ty.max():
        bias = 0.0 if len(ty) == 0 else (4.0 if ty[0] else -4.0)
        return Network(np.zeros(WIDTH), np.ones(WIDTH), np.zeros((WIDTH, 1)), np.zeros(1), np.zeros(1), bias, 1.0)
    mean, scale = tx.mean(axis=0), tx.std(axis=0) + 1e-6
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, np.sqrt(2 / WIDTH), (WIDTH, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    z = (tx - mean) / scale
    cx, cy, best = x[calibration], y[calibration], None
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for k in range(0, len(z), BATCH):
            rows = order[k:k + BATCH]
            h = np.maximum(z[rows] @ p[0] + p[1], 0)
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - ty[rows]) / len(rows)
            back = np.outer(g, p[2]) * (h > 0)
            grads = [z[rows].T @ back + DECAY * p[0], back.sum(axis=0), h.T @ g + DECAY * p[2], np.array([g.sum()])]
            step += 1
            for i, d in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.999 * v[i] + 0.001 * d * d
                p[i] = p[i] - RATE * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
        net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
        loss = _loss(net.logits(cx), cy) if len(cx) else 0.0
        if best is None or loss <= best[0]:
            best = (loss, net)
    net = best[1]
    if len(cx):
        logits = net.logits(cx)
        grid = np.exp(np.linspace(np.log(0.25), np.log(16), 121))
        net = net._replace(temperature=float(grid[np.argmin([_loss(logits / t, cy) for t in grid])]))
    return net


class Model(NamedTuple):
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        fit_rows: int = FIT_ROWS) -> Model:
    """Word vectors of all ``docs`` and a network fitted on labelled rows where ``trains`` holds.

    ``trains`` is a column of the id. Rows without id, label or document are left out; an id
    with labels of both kinds counts once for each. At most ``fit_rows`` rows are used; only
    their pooled vectors come to the driver.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, text_col)
    shared = spark.sparkContext.broadcast(vectors)
    chosen = (labels.filter(trains & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
                    .select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y")).distinct()
                    .withColumn("h", F.xxhash64(F.col("id").cast("string"))).orderBy("h", "id", "y").limit(fit_rows))
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, column=2):
            x = [pooled(t, shared.value) for t in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["h", "y", "x"])

    got = rows.select("h", "y", "text").mapInArrow(pool, "h long, y int, x array<double>").orderBy("h", "y", "x").limit(2 * fit_rows).toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(-1, WIDTH)
    return Model(vectors, fit_network(x, got.column("y").to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with a score from 0 to 1, made in the task that reads the text. Null and
    empty texts get the score of a text without words. A column named ``score_col`` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, network = shared.value
        for batch in portions(batches, column=-1):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            x = np.array([pooled(t, vectors) for t in texts]).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(network.probability(x))], names=[*batch.schema.names[:-1], score_col])

    rest = [c for c in docs.columns if c != score_col]
    schema = StructType([docs.schema[c] for c in rest]).add(score_col, "double")
    (text,) = free_names(docs.columns, "_text")
    return docs.select(*[f"`{c}`" for c in rest], text_of(text_col).alias(text)).mapInArrow(run, schema)
