"""The classifier's parts, and its accuracy on held-out labels."""
import zlib

import numpy as np

from studycorpus.llm import quality, queries


def test_units():
    row = quality._row
    assert quality.units("").tolist() == [quality.EMPTY] == quality.units(" \n").tolist()
    assert quality.units("ab AB!!").tolist() == [row("ab"), row(" lower"), row(" length 0"), row("ab"), row(" upper"), row(" length 0"), row("!!")]
    assert quality.REPEAT in quality.units("the the") and quality.REPEAT not in quality.units("the The")
    assert len(quality.units("x" * 100_000)) == 3


def test_word_vectors_are_sums_of_contexts(spark):
    texts = ["a b c a", "b a", None, "", "c" * 70]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    at, sign = quality.index_vectors()
    own = np.zeros((quality.UNITS, quality.WIDTH))
    np.add.at(own, (np.arange(quality.UNITS)[:, None], at), sign)
    want = np.zeros_like(own)
    for t in texts:
        u = quality.units(t or "")
        for x, y in zip(u[:-1], u[1:]):
            want[x] += own[y]
            want[y] += own[x]
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    assert np.allclose(quality.word_vectors(docs), unit(want) + unit(own), atol=1e-5)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, quality.WIDTH))
    y = (rng.random(4000) < 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))).astype(float)       # not linear
    net = quality.fit_network(x[:3000], y[:3000])
    p = net.probability(x[3000:])
    assert ((p > 0.5) == y[3000:]).mean() > 0.7
    for lo in (0.1, 0.3, 0.5, 0.7):
        part = (p >= lo) & (p < lo + 0.2)
        assert abs(p[part].mean() - y[3000:][part].mean()) < 0.15
    assert (quality.fit_network(x, np.ones(4000)).probability(x) > 0.9).all()
    assert (quality.fit_network(x[:0], y[:0]).probability(x) == 0.5).all()


def test_edges(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(["good text here", "BAD!! BAD!!", None, "", "x" * 50_000] * 6)] + [(None, "good", 0.1)],
                                 "doc_id long, text string, score double")
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (5, None, 0), (99, 1, 0), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels, queries.crc32_mod4() >= 0)
    rows = quality.score(docs, model).collect()
    assert len(rows) == 31 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.filter("false"), model).count() == 0
    quality.fit(docs.filter("false"), labels.filter("false"), queries.crc32_mod4() >= 0)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.QUERIES["op10_quality"](spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([p == q for p, q in held]) >= 0.95
    assert np.mean([p for p, q in held if q == 1]) >= 0.97
