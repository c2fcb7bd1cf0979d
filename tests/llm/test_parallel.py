"""Alignment against the libraries and the definition, link by link."""
import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from studycorpus.llm import parallel, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute(docs):
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()

    linked, rows = [], []
    for doc, text in docs:
        text = text or ""
        xs, ys = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xb, yb = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in xs], [piece(i) for i in ys]
        if not text or not b"".join(xb) == b"".join(yb) == b" " + text.encode():
            linked.append([])
            rows.append((doc, 0, 0, 0, ""))
            continue
        xe, ye = np.cumsum([len(t) for t in xb]).tolist(), np.cumsum([len(t) for t in yb]).tolist()
        groups, p, q = [], 0, 0
        for e in sorted(set(xe) & set(ye)):
            u, v = xe.index(e) + 1, ye.index(e) + 1
            groups.append((xs[p:u], ys[q:v]))
            p, q = u, v
        linked.append([(i, j) for x, y in groups for i in x for j in y])
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((doc, len(xs), len(ys), len(groups), hashlib.sha256(written.encode()).hexdigest()))
    count = collections.Counter(p for ls in linked for p in set(ls))
    most = collections.defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return sorted(repr((d, n, m, g, len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), s))
                  for (d, n, m, g, s), ls in zip(rows, linked))


def made():
    rng = random.Random(13)
    letters = "aabcé ßĀ中文🙂  \n\t​é<|endoftext|>▁<0x0A>'s123 ​"
    texts = [None, "", " ", "  two  blanks ", "<|endoftext|> <s> </s> <0x41>", "a" * 3000, "word " * 4000, "▁", "\x00", "ﬁ Å ½ ﻿"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(250)]
    return list(enumerate(texts)) + [(3, "again and again"), (3, "again and again"), (None, "no id")]


def test_made_texts(spark):
    docs = made()
    table = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, row int, pairs string").repartition(3)
    want = brute(docs)
    for common, ranks, pattern in ((1 << 18, RANKS, public_tokenizers.PATTERN), (0, None, None), (40, RANKS, public_tokenizers.PATTERN)):
        got = parallel.alignment(table, A, B, ranks_path=ranks, pattern=pattern, common=common)
        assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(repr(tuple(r)) for r in queries.QUERIES["op13_alignment"](spark, SF).collect()) == brute(docs)


def test_fast_encoder_equals_the_library(spark):
    texts = [r[0] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r[0]]
    rng = random.Random(4)
    texts += ["".join(chr(rng.randrange(0x300)) for _ in range(60)) for _ in range(2000)]
    fast, slow = parallel.Pair(A, B, RANKS, public_tokenizers.PATTERN), parallel.Pair(A, B)
    assert fast.encode(texts)[0] == slow.encode(texts)[0]


def test_gallop():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = (np.unique(rng.integers(0, rng.integers(1, 4000), rng.integers(0, 300))) for _ in range(2))
        i, j = parallel.gallop(x, y)
        both, at_x, at_y = np.intersect1d(x, y, return_indices=True)
        assert np.array_equal(i, at_x) and np.array_equal(j, at_y)


def test_large_groups(monkeypatch):
    monkeypatch.setattr(parallel, "LINKS", 50)
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 200), rng.integers(0, 7, 300)
    first_a, first_b = np.array([0, 90, 91]), np.array([0, 1, 200])
    many_a, many_b = np.array([90, 1, 109]), np.array([1, 199, 100])
    doc = np.array([0, 0, 1])
    want = collections.Counter((d, int(x) * 7 + int(y)) for d, p, n, q, m in zip(doc.tolist(), first_a, many_a, first_b, many_b)
                               for x in a[p:p + n] for y in b[q:q + m])
    got = parallel.linked_pairs(a, b, first_a, first_b, many_a, many_b, doc, 7)
    assert dict(zip(zip(got[0].tolist(), got[1].tolist()), got[2].tolist())) == want


def test_groups_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "hello world")], "doc_id long, text string")
    row = parallel.aligned(docs, A, B, groups=True).first()
    assert hashlib.sha256(row.groups.encode()).hexdigest() == row.groups_sha256 and row.n_groups == row.groups.count(";") + 1
    assert parallel.alignment(docs.limit(0), A, B).count() == 0
