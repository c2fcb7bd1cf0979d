"""Periodic runs against the definition, tried for every period and place."""
import hashlib
import random
import re
import zlib

import pytest

from studycorpus.llm import periods, queries

SF = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, times * q) and j > i:
                s = words[i:j + q]
                if not any(s[p:] == s[:-p] for p in range(1, q)):
                    out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(words):
    runs = brute(words)
    keep = [True] * len(words)
    for start, length, q in runs:
        keep[start + q:start + length] = [False] * (length - q)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(w for w, k in zip(words, keep) if k).encode()).hexdigest())


def planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def made(rng):
    n, letters = rng.choice([1, 5, 6, 7, 30, 90, 260]), rng.choice(["a", "ab", "abc", "abcdefgh"])
    words = [rng.choice(letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        a, p = rng.randrange(n), rng.randrange(1, max(2, n // 4))
        words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
        words[rng.randrange(n)] = rng.choice(letters)
    return rng.choice([" ", "\n", " \t"]).join(words)


def test_made_texts(spark):
    rng = random.Random(11)
    texts = [None, "", " \n\t", "one", "x " * 50_000, ("a b " * 30 + "c ") * 40, *(made(rng) for _ in range(400))]
    rows = [(i if i % 7 else None, t, 1, "x") for i, t in enumerate(texts)] + [(5, "a a a a a a", 2, "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, runs string").repartition(3)
    found = periods.periodic_runs(docs)
    got = sorted(map(repr, (tuple(r) for r in periods.run_digests(found).collect())))
    slow = {"x " * 50_000: [(0, 50_000, 1)]}
    want = []
    for i, t, *_ in rows:
        if t in slow:
            want.append((i, 1, 0, 50_000, 1, 50_000_000, hashlib.sha256(b"0,50000,1\n").hexdigest(), hashlib.sha256(b"x").hexdigest()))
        else:
            want.append((i, *digest(words_of(t))))
    assert got == sorted(map(repr, want))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"]


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (9, 3), (20, 5)])
def test_levels_cover_every_period(least, times):
    seen = []
    for k, lo in periods.levels(3000, least, times):
        assert all(k >= q and k <= max(least, times * q) - q for q in range(lo, k + 1))
        seen += range(lo, k + 1)
    assert seen[:3000 // times] == list(range(1, 3000 // times + 1))[:len(seen)] or max(least, times) > 3000


def test_other_bounds(spark):
    rng = random.Random(5)
    texts = [made(rng) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for least, times in ((2, 2), (9, 3)):
        for r in periods.periodic_runs(docs, least=least, times=times).collect():
            assert [tuple(x) for x in r.runs] == brute(words_of(texts[r.doc_id]), least, times)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *digest(planted(r.doc_id, words_of(r.text)))) for r in docs)
    got = sorted(tuple(r) for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect())
    assert got == want
    assert sum(r[1] for r in got) > 10


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert periods.run_digests(periods.periodic_runs(queries.with_planted_runs(docs))).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (None, None), (0, "")], "doc_id long, text string")
    assert queries.with_planted_runs(odd).count() == 3
