"""Exact and near duplicates, documents and vectors, against brute force."""
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from studycorpus.llm import base, exact, near, vectors


def closed(pairs, nodes):
    low = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            low[a] = low[b] = min(low[a], low[b])
    return low


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows, n = [], 0

    def add(text, id_=None):
        nonlocal n
        n += 1
        rows.append((n if id_ is None else id_, text, "clash", "x"))

    for text in ("", None, " \n ", "one", "one two", "one  two", "a b c d e", "a b c d f", "z " * 4000, "z " * 3900):
        add(text)
    line = " ".join(word() for _ in range(12))
    for size in (30, 60, 200, 900):
        first = [word() for _ in range(size)]
        for edits in (0, 0, 1, 2, 3, 4, 6, 9, 14, 20):
            words = list(first)
            for _ in range(edits * size // 100 + (edits > 0)):
                words[rng.randrange(len(words))] = word()
            add(" ".join(words))
    for _ in range(60):                         # one line in many documents
        add(line + "\n" + " ".join(word() for _ in range(20)))
    chain = [word() for _ in range(120)]
    for k in range(12):                         # each is near its neighbours only
        add(" ".join(chain[k * 5:k * 5 + 60]))
    copies = " ".join(word() for _ in range(50))
    for _ in range(40):
        add(copies)
    for _ in range(700):                        # a large group of near copies
        words = copies.split()
        words[rng.randrange(50)] = word()
        add(" ".join(words))
    rows.append((5, "one two", "clash", "x"))   # a repeated row
    rows.append((None, "no id at all", "clash", "x"))
    rows.append((None, copies, "clash", "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, sha string, class_id string").repartition(5).cache()


def bag(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    k = min(5, len(words))
    return Counter(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def alike(a, b):
    if not a or not b:
        return False
    both = sum((a & b).values())
    return Fraction(both, sum(a.values()) + sum(b.values()) - both) >= Fraction(4, 5)


def test_exact_groups(docs):
    want, rows = {}, docs.collect()
    for r in rows:
        want.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    want = {(m[2]): (min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2], len(v)) for v in want.values() for m in v if m[2] is not None}
    for bits in (1 << 28, 1 << 16):
        got = exact.exact_groups(docs, max_bits=bits).collect()
        assert len(got) == len(rows)
        assert all((r.keep_id, r.group_size) == want[r.doc_id] and r.kept == (r.keep_id == r.doc_id) for r in got if r.doc_id is not None)
    kept = exact.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted({str(v[0]) for v in want.values()} | {"None"})
    assert exact.exact_groups(docs.filter("false")).count() == 0 == exact.drop_exact_copies(docs.filter("false")).count()


def test_bloom_bits_have_no_misses(spark):
    hashes = spark.range(5000).selectExpr("xxhash64(id % 4000) as h").repartition(7)
    bits = exact.bit_filter(hashes, 1 << 16, 2)
    twice = np.array([r.h for r in spark.range(1000).selectExpr("xxhash64(id) as h").collect()])
    at = exact._positions(twice, 1 << 16)
    assert (exact._get(bits, at[0]) & exact._get(bits, at[1])).all()


def test_near_duplicates(docs):
    rows = docs.collect()
    bags = {r.doc_id: bag(r.text) for r in rows if r.doc_id is not None}
    ids = sorted(bags)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if alike(bags[a], bags[b])]
    want = closed(pairs, ids)
    got = near.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.class_id == r.doc_id) for r in got)
    kept = near.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(want.values()) | {None}
    assert near.near_duplicates(docs.filter("false")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.8):
        a = np.unique(rng.integers(0, 2 ** 63, 900).astype(np.uint64))
        keep = round(len(a) * 2 * share / (1 + share))
        b = np.sort(np.concatenate([a[:keep], rng.integers(0, 2 ** 63, len(a) - keep).astype(np.uint64)]))
        agree = np.mean([(np.equal(*near.signatures([near._mix(a ^ np.uint64(s)), near._mix(b ^ np.uint64(s))]))).mean() for s in range(40)])
        assert abs(agree - share) < 0.03
    heavy, light = near.cells(["a"] * 8 + ["b"] * 6), near.cells(["a"] * 8)
    assert len(heavy) == 10 and len(light) == 4 and set(light) <= set(heavy)


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 180)] + [(5, i) for i in range(200, 300)] + [(7, 7), (None, 3), (300, 299)]
    got = dict(base.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 100 for i in range(100, 181)} | {i: 5 for i in [5, *range(200, 301)]}
    assert base.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(30, 24))
    x = np.concatenate([rng.normal(size=(60, 24)), *[c + rng.normal(size=(8, 24)) * s for c, s in zip(centre, np.linspace(0.05, 0.35, 30))],
                        centre[0] + rng.normal(size=(250, 24)) * 0.1]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [1.0, None] * 12), (1003, [float("nan")] * 24), (1004, [float("inf")] + [1.0] * 23), (1005, []),
             (1006, [1.0] * 7), (1007, [2.0] * 7), (None, x[0].tolist())] + [(2000 + i, x[70].tolist()) for i in range(20)]
    rows.append((70, x[70].tolist()))                                             # a repeated row
    frame = spark.createDataFrame([(i, v, "c") for i, v in rows], "vec_id long, embedding array<float>, n_links string").repartition(4)
    good = [(i, np.asarray(v, float)) for i, v in rows if i is not None and v and all(w is not None and np.isfinite(w) for w in v) and any(v)]
    links, pairs = Counter(), []
    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1:]:
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                links[i] += 1 if i != j else 0.5
                links[j] += 1 if i != j else 0.5
                pairs.append((i, j))
    want = closed(pairs, [i for i, _ in rows if i is not None])
    for block in (512, 16):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = vectors.near_vectors(frame).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: r.component_id for r in got if r.vec_id is not None} == want
        assert {r.vec_id: r.n_links for r in got if r.vec_id not in (None, 70)} == {i: links[i] for i in want if i != 70}
        assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    assert vectors.near_vectors(frame.filter("false")).count() == 0


def vector_pairs(rng, n, dimension, cosine):
    a, b = rng.normal(size=(2, n, dimension))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine * cosine) * b


@pytest.mark.parametrize("dimension, cosine", [(64, 0.95), (64, 0.8), (100, 0.85), (256, 0.95), (768, 0.95), (3, 0.95), (24, 0.95)])
def test_tables_cover_dimension_and_cosine(dimension, cosine):
    a, b = (vectors.keys_of(x, cosine) for x in vector_pairs(np.random.default_rng(8), 300, dimension, cosine))
    width = 1 + vectors.FUNCTIONS
    hits = [(a[:, i:i + width, None] == b[:, None, i:i + width]).any(axis=(1, 2)) for i in range(0, a.shape[1], width)]
    assert np.any(hits, axis=0).all() and (1 - np.mean(hits)) ** len(hits) < 3e-6


def test_near_vectors_of_a_low_cosine(spark):
    a, b = vector_pairs(np.random.default_rng(9), 300, 64, 0.801)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in vectors.near_vectors(frame, cosine=0.8).collect()}
    assert got == {i: i % 300 for i in range(600)}
    with pytest.raises(Exception, match="more than 256 tables"):
        vectors.near_vectors(frame, cosine=0.2).collect()
