"""Contamination against the definition and against the SQL twin."""
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from studycorpus.llm import leaks, queries

SF = "/root/testdata/sf0.001"
LOW = str.maketrans(leaks.UPPER, leaks.LOWER)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        t = min(window, len(w))
        for i in range(len(w) - t + 1 if t else 0):
            windows.setdefault(tuple(w[i:i + t]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for t in {len(x) for x in windows}:
            for i in range(len(w) - t + 1):
                if tuple(w[i:i + t]) in windows:
                    hit |= set(range(i, i + t))
                    found |= windows[tuple(w[i:i + t])]
        out.append((doc, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(map(repr, out))


def made():
    rng = random.Random(12)
    some = ["alpha", "Beta", "gämma", "DELTA", "é", "7", "x1", "ÉTÉ", "ß"]
    items = [(i, " ".join(rng.choice(some) for _ in range(rng.choice([10, 12, 25, 60])))) for i in range(12)]
    items += [(100, "tiny item here"), (101, "lone"), (102, None), (103, "  ... "), (104, ""), (None, "an item without any id of ten words or so"),
              (105, items[0][1]), (106, "prefix " + items[0][1]), (0, items[0][1]), (107, "same same same same same same same same same same same same")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "TINY, item: here"), (4, "a lone word"), (5, "same " * 40), (None, items[3][1].upper()), (6, "same " * 9)]
    for i in range(10, 120):
        filler = [rng.choice(some + ["zeta", "eta", "theta"]) for _ in range(rng.randrange(60))]
        item = rng.choice(items)[1] or ""
        part = item.split(" ")
        lo = rng.randrange(max(1, len(part)))
        at = rng.randrange(len(filler) + 1)
        docs.append((i, "; ".join(filler[:at] + part[lo:lo + rng.randrange(8, 40)] + filler[at:])))
    return docs + docs[20:22], items


@pytest.mark.parametrize("slice_rows", [leaks.SLICE, 60])
def test_made_tables(spark, slice_rows):
    docs, items = made()
    table = spark.createDataFrame([(a, b, 1, "k") for a, b in docs], "doc_id long, text string, words int, key string").repartition(3)
    bench = spark.createDataFrame([(a, b, 2) for a, b in items], "item_id long, text string, t int")
    got = leaks.contamination(table, bench, slice_rows=slice_rows)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == brute(docs, items)


def test_shared_spans_of_a_long_text(spark):
    """Each span of ten shared words is found, wherever it lies in a text of a megabyte."""
    rng = random.Random(2)
    item = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    text = [f"v{rng.randrange(10**6)}" for _ in range(150_000)]
    for k in range(50):
        at, lo = 2000 * k + rng.randrange(1000), rng.randrange(290)
        text[at:at + 10] = item[lo:lo + 10]
    docs, items = [(1, " ".join(text)), (2, "none of it")], [(7, " ".join(item))]
    got = leaks.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    rows = [tuple(r) for r in got.collect()]
    assert sorted(map(repr, rows)) == brute(docs, items)
    assert max(r[2] for r in rows) == 500


def test_query_and_its_sql(spark):
    got = sorted(tuple(r) for r in queries.QUERIES["op12_contamination"](spark, SF).collect())
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    assert got == sorted(con.execute(queries.ORACLES["op12_contamination"]).fetchall())
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = brute(docs, items)
    full = leaks.contamination(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert sorted(map(repr, (tuple(r) for r in full.collect()))) == want
    assert {r[4] for r in got if not r[5]} == {hashlib.sha256(b"").hexdigest()} and any(r[5] for r in got)


def test_empty_tables_and_plan(spark):
    docs, items = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert leaks.contamination(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in leaks.contamination(docs, items.limit(0)).collect()] == [(1, 1, 0, 0, "", False)]
    assert [tuple(r) for r in leaks.contamination(docs, items).collect()] == [(1, 1, 1, 1, "1", True)]
    plan = leaks._hits(leaks._fingerprinted(docs.select(F.col("doc_id").alias("id"), F.lit(b"k").alias("key"), leaks.words_of(F.col("text")).alias("words")), 10),
                       spark.createDataFrame([], "t int, fp long, whole binary, set long"), 10, [], True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
