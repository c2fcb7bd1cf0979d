"""Apportionment by the plain rule, and the mix's sums."""
import random
import re
from collections import Counter, defaultdict

import pytest

from studycorpus.llm import mix, queries


def plain_sainte_lague(votes, seats, most):
    got = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if got[i] < most[i] and votes[i] > 0]
        if not open_:
            break
        got[max(open_, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
    return got


def plain_targets(sizes, weights, total, epochs):
    out, open_ = {}, set(range(len(sizes)))
    while open_:
        left, weight = total - sum(out.values()), sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > epochs * sizes[i]}
        if not over:
            return [out.get(i, left * weights[i] / weight) for i in range(len(sizes))]
        out |= {i: float(epochs * sizes[i]) for i in over}
        open_ -= over
    return [out[i] for i in range(len(sizes))]


def test_highest_quotients():
    rng = random.Random(9)
    for _ in range(300):
        votes = [rng.choice([0, 1, 5, 5, rng.randint(0, 1000), rng.random()]) for _ in range(rng.randint(0, 9))]
        most = [rng.choice([0, 3, 1000]) for _ in votes]
        seats = rng.randint(0, 60)
        assert mix.sainte_lague(votes, seats, most) == plain_sainte_lague(votes, seats, most)
        sizes = [rng.randint(0, 50) for _ in votes]
        weights = [mix.WEIGHTS[i % 3] for i in range(len(sizes))]
        for a, b in zip(mix.shared_targets(sizes, weights, 1.5 * sum(sizes), 2), plain_targets(sizes, weights, 1.5 * sum(sizes), 2)):
            assert abs(a - b) < 1e-6


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, got, slack):
    by_source = defaultdict(int)
    for d in rows:
        by_source[d.source] += size(d.text)
    names = sorted(by_source, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, plain_targets([by_source[n] for n in names], [mix.WEIGHTS[i % 3] for i in range(len(names))],
                                            1.5 * sum(by_source.values()), 2)))
    taken = defaultdict(int)
    sources = {d.doc_id: d.source for d in rows}
    for r in got:
        source = sources[r.doc_id]
        assert r.source_size == by_source[source] and abs(r.target - targets[source]) < 1e-6 * max(1, targets[source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.taken_1 + r.taken_2 and r.taken_2 <= r.taken_1 <= r.size
        taken[source] += r.taken
    for n in names:
        assert abs(taken[n] - targets[n]) <= slack(n)
    return taken


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    rows = [(i, " \t" * rng.randint(0, 1) + "  ".join("w%d" % rng.randrange(99) for _ in range(rng.choice([0, 1, 7, 60, 400]))),
             rng.choice(["a", "a", "a", "a", "b", "Z", "é", "", None]), i, 5) for i in range(900)]
    rows += [(901, None, "only null", 0, 0), (902, "x " * 9000, "b", 0, 18000), (902, "x " * 9000, "b", 0, 18000), (None, "no id", "a", 1, 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, n_chars long").repartition(6).cache()


def test_plan(docs, monkeypatch):
    rows = docs.collect()
    for words in (1 << 16, 3000):
        monkeypatch.setattr(mix, "SHARD_WORDS", words)
        got = mix.plan_mix(docs).collect()
        assert len(got) == len(rows)
        shards = {r.source_name: -(-r.source_size // words) for r in got}
        check([r for r in rows], got, lambda n: mix.BLOCK * (2 + shards[n]))
        again = mix.plan_mix(docs.repartition(3)).collect()
        assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    assert mix.plan_mix(docs.filter("false")).count() == 0
    assert {r.taken for r in mix.plan_mix(docs.filter("text is null or text = ''")).collect()} == {0}


def test_mixed_rows(docs):
    plan = Counter()
    for r in mix.plan_mix(docs.filter("doc_id is null or doc_id <> 902")).collect():
        for n in (r.taken_1, r.taken_2):
            if n:
                plan[(r.doc_id, n)] += 1
    out = mix.mixed(docs.filter("doc_id is null or doc_id <> 902"))
    assert out.columns == docs.columns
    rows = out.collect()
    assert Counter((r.doc_id, size(r.text)) for r in rows) == plan
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        assert texts[r.doc_id].startswith(r.text) and (r.text == texts[r.doc_id] or r.n_chars == len(r.text))


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = queries.QUERIES["op7_mix_sources"](spark, sf).collect()
    assert len(got) == len(rows)
    check(rows, got, lambda n: 0.01 * sum(size(d.text) for d in rows if d.source == n) + mix.BLOCK)
