"""Suffix order and repeated strings against plain definitions."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from studycorpus.llm import queries, repeats

LENGTH = repeats.LENGTH


def plain(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + LENGTH] for d in data for i in range(len(d) - LENGTH + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - LENGTH + 1):
            if seen[d[i:i + LENGTH]] > 1:
                gone[i:i + LENGTH] = b"\x01" * LENGTH
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()))
    return out


def test_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(200):
        n, letters = rng.randint(0, 200), rng.choice([2, 3, 26, 256])
        x = np.array([rng.randrange(letters) for _ in range(n)], np.uint8)
        if rng.random() < 0.3 and n:
            x = np.resize(x[:max(1, n // 7)], n)
        b = x.tobytes()
        want = sorted(range(n), key=lambda i: b[i:])
        assert repeats.suffix_order(x, 208).tolist() == want
        for k, got in enumerate(repeats.common_prefixes(x, np.array(want, int), 40)):
            p, q = b[want[k]:][:40], b[want[k + 1]:][:40]
            m = next((i for i, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))
            assert got == m or (m == min(len(p), len(q)) and got >= m)       # behind the end zeros may agree


def test_windows_of_equal_bytes_have_equal_names(monkeypatch):
    rng = random.Random(2)
    core = bytes(rng.randrange(97, 103) for _ in range(900))
    a, b = bytes(rng.randrange(97, 103) for _ in range(70)) + core, core + b"z" * 33
    for chunk in (1 << 20, 150):
        monkeypatch.setattr(repeats, "CHUNK", chunk)
        names = []
        for d in (a, b):
            name, first, last = repeats._named(d)
            assert first[0] == 0 and last[-1] == len(d) - LENGTH and (first[1:] == last[:-1] + 1).all()
            names.append(np.repeat(name, last - first + 1))
        assert (names[0][70:70 + 701] == names[1][:701]).all()
    assert len(repeats._named(b"x" * (LENGTH - 1))[0]) == 0 and len(repeats._named(b"x" * LENGTH)[0]) == 1


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnop éß\n") for _ in range(n))
    out = ["", None, "short", "short", noise(199), "x" * 199, "x" * 200, "x" * 201, "é" * 150, noise(5000) * 2]
    passage, line, base = noise(320), noise(110), noise(3000)
    out += [noise(rng.randint(0, 400)) + passage + noise(rng.randint(0, 400)) for _ in range(30)]
    out += [noise(150) + line + noise(150) for _ in range(60)]              # a frequent line that is too short
    for _ in range(25):                                                      # near copies
        t = list(base)
        for _ in range(4):
            t[rng.randrange(len(t))] = "#"
        out.append("".join(t))
    out += [base[500:800]] + [passage[:199], passage[:200], passage[120:]] + [noise(60) + "ab" * 400 + noise(60)]
    return out + [out[40]] * 9


def test_removal(spark, texts, monkeypatch):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)] + [(None, texts[11], None, 2)],
                                 "doc_id long, text string, key string, name int").repartition(4)
    want = plain(texts + [texts[11]])
    for hot, sort in ((8_000, 2 << 20), (3, 2_000)):
        monkeypatch.setattr(repeats, "HOT", hot)
        monkeypatch.setattr(repeats, "SORT_BYTES", sort)
        got = repeats.digests(docs).collect()
        assert len(got) == len(want)
        for r in got:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id if r.doc_id is not None else -1], (hot, r.doc_id)
    assert repeats.digests(docs.filter("false")).count() == 0


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in rows], plain([r.text for r in rows])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op3_repeats"](spark, sf).collect()}
    assert got == want


def test_a_flush_of_the_sort_is_small():
    """Text of the size of a flush takes at most 60 MB over the start."""
    import random
    import tracemalloc
    rng = random.Random(1)
    line = bytes(rng.randrange(97, 123) for _ in range(120))
    around = lambda: bytes(rng.randrange(97, 123) for _ in range(90))
    runs = [around() + line + around() for _ in range(repeats.SORT_BYTES // 300)]
    tracemalloc.start()
    try:
        assert not any(m.any() for m in repeats.repeated_windows(runs, [False] * len(runs)))
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()
