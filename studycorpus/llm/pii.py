"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds (email, ip, card, phone) follow fixed definitions and are reported whatever
their score. Further kinds (iban, ssn, routing) are reported from ``THRESHOLD`` on: their
pattern and checksum give a first score, words within ``NEAR`` characters before the span
or ``AFTER`` behind it move it.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from studycorpus.llm.base import free_names, portions, text_of

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "routing")
BASE = KINDS[:4]
NEAR, AFTER, THRESHOLD = 48, 16, 0.6

#: The fixed patterns of the base kinds, with quantifiers that never go back where the
#: match cannot depend on it, so that long runs of digits take linear time.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# further kinds
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ ]?[A-Z0-9]{4})")
IBAN_GROUP, IBAN_TAIL = re.compile(r"[ ]?[A-Z0-9]{4}"), re.compile(r"[ ]?[A-Z0-9]{1,3}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
ROUTING = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")

#: Lengths of the IBAN registry.
IBAN_LENGTHS = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in codes.split()}

#: Words that raise the score of a kind.
WORDS = {
    "email": ("mail", "email", "contact", "write"),
    "ip": ("ip", "host", "server", "address", "ping"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer", "bic", "swift"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "routing": ("routing", "aba", "bank", "transit", "wire"),
}
#: Words that lower it: numbers of other things.
AGAINST = ("isbn", "order", "version", "invoice", "sku", "example")
FIRST_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.5, "routing": 0.35}
_TERMS = {k: re.compile(r"(?<![^\W_])(?:" + "|".join(v) + r")(?![^\W_])", re.I) for k, v in WORDS.items()}
_AGAINST = re.compile(r"(?<![^\W_])(?:" + "|".join(AGAINST) + r")(?![^\W_])", re.I)


SPAN = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType()), StructField("score", DoubleType())])


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod_97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def aba(digits: str) -> bool:
    return sum(int(d) * w for d, w in zip(digits, (3, 7, 1) * 3)) % 10 == 0 and digits != "0" * 9


def issued_ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that do not overlap, found from the @ signs: the part before one
    is the longest run of its characters that no earlier match has used."""
    free, seen, at = 0, 0, text.find("@")
    while at >= 0:
        start = at
        while start > max(free, seen) and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            free = m.end()
        seen = at
        at = text.find("@", max(at + 1, free))


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _emails(text):
        yield "email", a, b
    for m in IP.finditer(text):
        # compared as text: a run of digits may be too long for a number
        if all(len(p := part.lstrip("0")) <= 3 and (len(p) < 3 or p <= "255") for part in m[0].split(".")):
            yield "ip", *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 2 * 19:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield "phone", *m.span()


def _iban_ends(text: str, at: int) -> list[int]:
    """Ends of words at which a number may end whose first four characters end at ``at``, the longest first."""
    ends = []
    for _ in range(8):
        if tail := IBAN_TAIL.match(text, at):
            ends.append(tail.end())
        if not (group := IBAN_GROUP.match(text, at)):
            break
        at = group.end()
        if not (at < len(text) and text[at].isascii() and text[at].isalnum()):
            ends.append(at)
    return ends[::-1]


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers that mod 97 confirms. A registered country gives the length; for others the
    longest confirmed end counts. A start that fails uses up no text behind it."""
    free = 0
    for m in IBAN.finditer(text):
        if m.start() < free:
            continue
        length = IBAN_LENGTHS.get(m[0][:2])
        for end in _iban_ends(text, m.end()):
            plain = text[m.start():end].replace(" ", "")
            if (len(plain) == length if length else 15 <= len(plain) <= 34) and mod_97(plain):
                yield m.start(), end
                free = end
                break


def _further(text: str) -> Iterator[tuple[str, int, int]]:
    for a, b in _ibans(text):
        yield "iban", a, b
    for m in SSN.finditer(text):
        if issued_ssn(m[0]):
            yield "ssn", *m.span()
    for m in ROUTING.finditer(text):
        if aba(m[0]):
            yield "routing", *m.span()


def find_spans(text: str) -> list[Span]:
    """All spans of a text by start, then kind in the order of ``KINDS``; offsets are code points."""
    out = []
    for kind, a, b in (*_base(text), *_further(text)):
        near = text[max(0, a - NEAR):a] + "\n" + text[b:b + AFTER]
        score = FIRST_SCORE[kind] + (0.3 if _TERMS[kind].search(near) else 0) - (0.3 if _AGAINST.search(near) else 0)
        score = min(1.0, max(0.0, score))
        if kind in BASE or score >= THRESHOLD:
            out.append(Span(kind, a, b, round(score, 2)))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def detect(docs: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """The documents with a column of spans ``array<struct<kind, start, end, score>>``.

    Whole texts are searched in the task that reads them, without a shuffle; null and empty
    texts have no spans. Other columns pass; one named ``spans_col`` is replaced. Spans of
    different kinds may overlap.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, column=-1):
            found = [[s._asdict() for s in find_spans(t)] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, arrow)], names=[*batch.schema.names[:-1], spans_col])

    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    rest = [c for c in docs.columns if c != spans_col]
    schema = StructType([docs.schema[c] for c in rest]).add(spans_col, ArrayType(SPAN))
    (text,) = free_names(docs.columns, "_text")
    return docs.select(*[f"`{c}`" for c in rest], text_of(text_col).alias(text)).mapInArrow(run, schema)


def masked(docs: DataFrame, text_col: str = "text", mask: str = "[{kind}]") -> DataFrame:
    """The documents with every span in the text replaced; overlapping spans become one mask of the first kind."""
    docs_columns = docs.columns
    (at,) = free_names(docs.columns, "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i = docs_columns.index(text_col)
        for batch in portions(batches, column=i):
            texts = []
            for text, spans in zip(batch.column(i).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                parts, done = [], 0
                for s in spans or ():
                    if s["start"] >= done:
                        parts += [text[done:s["start"]], mask.format(kind=s["kind"].upper())]
                    done = max(done, s["end"])
                texts.append(text if not parts else "".join(parts) + text[done:])
            cols = [pa.array(texts, batch.schema.field(j).type) if j == i else batch.column(j) for j in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names[:-1])

    return detect(docs, text_col, at).mapInArrow(run, docs.schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the counts of the base kinds, ``base_sha256`` and ``spans`` as text, from ``detect``."""
    found = detect(docs.select(F.col(id_col), F.col(text_col)), text_col)
    item = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[number(k) for k in BASE], F.sha2(F.array_join(F.transform(base, item), ","), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", item), ",").alias("spans"))
