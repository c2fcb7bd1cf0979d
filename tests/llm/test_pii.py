"""Base kinds against the plain definitions, further kinds on known numbers."""
import hashlib
import random
import re

from studycorpus.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        d = int(c) * (1 + i % 2)
        total += d if d < 10 else d - 9
    return total % 10 == 0


def plain_base(text):
    out = []
    for at, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                  "card": lambda: 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((m.start(), at, f"{kind}:{m.start()}:{m.end()}"))
    return [x for _, _, x in sorted(out)]


def with_luhn(digits):
    return next(digits + str(d) for d in range(10) if plain_luhn(digits + str(d)))


def made_texts():
    rng = random.Random(5)
    bits = ["a@b.co", "@", "a", "x_y@", ".", "-", "c.de", " ", "+", "+49", "(0)", "1", "22", "255", "256", "1.2.3.4", "0001", "é", "%", "d@e-f.g.h",
            "4111111111111111", with_luhn("37828224631000"), with_luhn("1" * 18), "4111 1111-1111 1111", "\n", "555-1234", "12345678901"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["".join(rng.choice("@a.-+ 0123(_") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return ["", None, "9" * 3000, "a" * 3000 + "@", "1." * 3000, "+1" + " " * 3000 + "2", "a@" * 2000, *texts]


def test_base_kinds_as_defined():
    for text in made_texts():
        spans = pii.find_spans(text or "")
        assert [f"{s.kind}:{s.start}:{s.end}" for s in spans if s.kind in pii.BASE] == plain_base(text or ""), text


def test_further_kinds():
    kinds = lambda t: [s.kind for s in pii.find_spans(t) if s.kind not in pii.BASE]
    assert kinds("transfer to IBAN GB82 WEST 1234 5698 7654 32 today") == ["iban"]
    assert kinds("to DE89370400440532013000.") == ["iban"] and kinds("to DE89370400440532013001.") == []
    assert kinds("social security 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 666-45-6789") == []
    assert kinds("routing 021000021") == ["routing"] and kinds("number 021000021") == [] and kinds("routing 021000022") == []
    near = {s.kind: s.score for s in pii.find_spans("call +49 30 1234567")} | {}
    assert near["phone"] > pii.find_spans("order +49 30 1234567")[0].score


def with_mod_97(country, rest):
    return next(x for n in range(100) if pii.mod_97(x := f"{country}{n:02}{rest}"))


def test_iban_before_other_words():
    found = lambda t: [t[s.start:s.end] for s in pii.find_spans(t) if s.kind == "iban"]
    known = ["ES9121000418450200051332", "AT611904300234573201", "BE68539007547034", "DE89370400440532013000", "NO9386011117947",
             "SE4550000000058398257466", "PL61109010140000071219812874", "MT84MALT011000012345MTLCAST001S", "CZ6508000000192000145399"]
    known += [with_mod_97(c, ("0123456789" * 4)[:n - 4]) for c, n in pii.IBAN_LENGTHS.items()]
    known += [with_mod_97("ZZ", "1" * n) for n in (11, 16, 30)]
    groups = lambda x: " ".join(x[i:i + 4] for i in range(0, len(x), 4))
    for x in known:
        for form in (x, groups(x)):
            assert found(f"to {form}") == [form]
            for word in ("BIC CAIX", "I said", "TRANSFER", "EUR 20", ", then", "a"):
                assert found(f"to {form} {word}") == [form], (form, word)
            if x[:2] != "ZZ":
                for word in ("2024", "20", "1", "12345678 9012"):
                    assert found(f"to {form} {word}") == [form], (form, word)
    two = [groups("ES9121000418450200051332"), groups("AT611904300234573201")]
    assert found(" ".join(two)) == two and found("AB12 CDEF GHIJ " + two[0]) == [two[0]]
    assert found("ES91210004184502000513321") == [] and found("ES9121000418450200051331 BIC CAIX") == []
    assert found("xES9121000418450200051332") == [] and found("") == []


def test_on_spark(spark):
    texts = made_texts()[:400] + ["mail a@b.co or a@b.co"] * 2
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] + [(None, "a@b.co", None)], "doc_id long, text string, spans string")
    for r in pii.digests(docs).collect():
        want = plain_base(texts[r.doc_id] or "") if r.doc_id is not None else ["email:0:6"]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x.startswith(k + ":") for x in want) for k in pii.BASE)
    hidden = pii.masked(docs.filter(f"doc_id >= {len(texts) - 2} or text is null")).collect()
    assert sorted(str(r.text) for r in hidden) == ["None", "mail [EMAIL] or [EMAIL]", "mail [EMAIL] or [EMAIL]"]
    assert all(r.spans == "old" for r in hidden) and pii.digests(docs.filter("false")).count() == 0


def test_query_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op6_pii"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(rows)
    for d in rows:
        assert got[d.doc_id].base_sha256 == hashlib.sha256(",".join(plain_base(d.text)).encode()).hexdigest()
