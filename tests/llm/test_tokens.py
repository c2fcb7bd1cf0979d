"""Token operators against the library, document by document."""
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from studycorpus.llm import bpe, counts, idfile, queries

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def made_texts():
    rng = random.Random(3)
    letters = "aàéß İΣσ'’sStTlLm0123٣½<|>endoftext   \x1c\x85\t\n한글ก็éÅ中文🙂​!!%%% |"
    texts = ["", "  \n", None, "<|endoftext|>", "a<|startoftext|>b <|ENDOFTEXT|>", "I'LL don't 's", "x" * 5000, "a!" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return texts + texts[4:12]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(made_texts())] + [(3, "twice", 1, None), (3, "twice", 1, None), (None, "no id", 0, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, p string").repartition(3).cache()


def encoded(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_counts(docs, library):
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(encoded(library, r.text))) for r in docs.collect())
    for head in (0, 40, 1 << 17):                       # nearly all by the shuffle join, all by the broadcast
        got = counts.token_counts(docs, VOCABULARY, limit=5, head=head).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 5) for r in got)


def test_encode_and_decode(docs, library):
    rows = bpe.encode(docs, VOCABULARY, decoded_col="decoded").collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = encoded(library, r.text)
        assert r.ids == want and r.decoded == library.decode(want, skip_special_tokens=False)
    digests = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, VOCABULARY).collect())
    assert digests == sorted((str(r.doc_id), len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest(),
                              hashlib.sha256(r.decoded.encode()).hexdigest()) for r in rows)


def test_files(spark, docs, library, tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "RANGE_DOCS", 60)
    monkeypatch.setattr(idfile, "SHARD_DOCS", 25)
    folder = str(tmp_path / "ids")
    idfile.write_ids(docs, folder, VOCABULARY)
    got = [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in idfile.read_ids(spark, folder).collect()]
    got.sort(key=lambda r: r[1])
    assert [r[0] for r in got] == sorted([r.doc_id for r in docs.collect()], key=lambda i: (i is not None, i))
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([len(r[2]) for r in got])[:-1]]).astype(int).tolist()
    want = sorted((str(r.doc_id), encoded(library, r.text) + [1]) for r in docs.collect())
    assert sorted((str(r[0]), r[2]) for r in got) == want
    assert [a.tolist() for a in idfile.read_one(spark, folder, 7)] == [encoded(library, made_texts()[7]) + [1]]
    assert len(idfile.read_one(spark, folder, 3)) == 3 and idfile.read_one(spark, folder, 10 ** 9) == []


def test_ids_of_many_texts(library, monkeypatch):
    """Each pre-token of the texts is encoded once, however little is remembered, and the ids are the library's."""
    from studycorpus.llm import words
    rng = random.Random(5)
    first, second = ([f"{c}{''.join(rng.choices('abcdeé', k=7))}" for _ in range(200)] for c in "xy")
    texts = [" ".join(rng.choices(some, k=8)) for some in (first, second, first) for _ in range(512)]
    texts[3:3] = ["", "a\x0bb\x0cc\rd\x1ce Å\x85à\xa0b", f"{first[0]}<|endoftext|> {first[1]}!", "\x00 a\x00b", "long" * 40 + " long", " "]
    asked, ids, room = [], words.Words.ids, words.Memory.room
    words.memory("nothing")
    monkeypatch.setattr(words.Words, "ids", lambda self, p: asked.append(p) or ids(self, p))
    monkeypatch.setattr(words.Memory, "room", lambda self, now=frozenset(), most=0: room(self, now, 100))
    got = list(idfile._library_ids(VOCABULARY, texts, 1))
    assert len(asked) == len(set(asked))
    again = list(idfile._library_ids(VOCABULARY, texts, 1))
    want = [encoded(library, t) + [1] for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == want and again == got
    assert not [x for x in words.memory(VOCABULARY, "library ids") if len(x) > words.LONG_WORD]


def test_empty_table(spark, docs):
    none = docs.filter("doc_id = -1")
    assert counts.token_counts(none, VOCABULARY).count() == 0
    assert bpe.encode(none, VOCABULARY).count() == 0
    assert idfile.roundtrip(none, VOCABULARY).count() == 0


def test_queries_on_a_table(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    a = {r.doc_id: r for r in queries.QUERIES["op5_token_counts"](spark, sf).collect()}
    b = {r.doc_id: r for r in queries.QUERIES["op8_bpe"](spark, sf).collect()}
    c = {r.doc_id: r for r in queries.QUERIES["op9_token_files"](spark, sf).collect()}
    start = 0
    for d in docs:
        ids = encoded(library, d.text)
        assert a[d.doc_id].n_tokens == b[d.doc_id].n_tokens == len(ids) == c[d.doc_id].n_tokens - 1
        assert b[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert c[d.doc_id].start == start and c[d.doc_id].ids_crc32 == zlib.crc32(np.array(ids + [1], "<u4").tobytes())
        start += len(ids) + 1
    assert len(a) == len(b) == len(c) == len(docs)


def test_digests_in_place_of_decoded_texts(spark):
    """The digest made in the task is that of the decoded text, and the text does not pass."""
    from pyspark.sql import functions as F
    import corpus_pipeline
    texts = ["", None, "Plain words, 12 of them", "Ünïcode \U0001F600 text <|endoftext|> end", "again " * 300]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int")
    vocabulary = corpus_pipeline.VOCABULARY
    want = corpus_pipeline.bpe.encode(docs, vocabulary, decoded_col="decoded").select("doc_id", "ids", F.sha2("decoded", 256).alias("d"))
    got = corpus_pipeline.to_tokens(spark, docs, "")
    assert sorted(map(tuple, got.select("doc_id", "ids", "decoded_sha256").collect())) == sorted(map(tuple, want.collect()))
    kept = corpus_pipeline.bpe.encode(docs, vocabulary, digest_col="d", keep=["doc_id"])
    assert kept.columns == ["doc_id", "ids", "d"]
