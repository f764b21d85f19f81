"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm.common import map_batches

# The kinds in their order, the patterns, and the words that speak for a kind.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
CONTEXT = {
    "email": {"email", "e-mail", "mail", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "client"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell"},
    "iban": {"iban", "account", "bank", "transfer", "konto", "bic", "swift"},
    "ssn": {"ssn", "social", "security", "taxpayer"},
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3}

#: Characters before and after a span in which its context words are sought.
REACH = 48
#: A kind outside the base set is kept from this score on.
KEEP = 0.5
DIGIT = re.compile(r"[0-9]")
NON_DIGIT = re.compile(r"[^0-9]+")
WORD = re.compile(r"[\w-]+")


class Span(NamedTuple):
    start: int
    order: int
    end: int
    score: float

    @property
    def kind(self) -> str:
        return KINDS[self.order]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str):
    """The matches of EMAIL, found from each @: a run without one is never scanned twice."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        done = m.end() if m else at + 1
        if m:
            yield start, done
        at = text.find("@", done)


def _confirmed(text: str):
    """(order, start, end) of each proposed span that its validator confirms."""
    if "@" in text:
        yield from ((0, *x) for x in _emails(text))
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            yield 1, *m.span()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NON_DIGIT.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield 2, *m.span()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NON_DIGIT.sub("", m.group())) <= 15:
                yield 3, *m.span()
    for m in IBAN.finditer(text):
        code = m.group().replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield 4, *m.span()
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield 5, *m.span()


def find_spans(text: str | None) -> list[Span]:
    """The spans of ``text`` by start, then kind. Offsets count code points, the end is exclusive.

    Spans of the base kinds that pass their checksum always stay; their score only ranks them. A span
    of another kind stays if its score with the words around it reaches KEEP. A null text has none.
    """
    found = []
    for order, start, end in _confirmed(text or ""):
        kind = KINDS[order]
        around = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
        near = not CONTEXT[kind].isdisjoint(WORD.findall(around.lower()))
        score = min(1.0, PRIOR[kind] + 0.3 * near)
        if order < len(BASE_KINDS) or score >= KEEP:
            found.append(Span(start, order, end, score))
    found.sort()
    return found


def redact_text(text: str | None) -> str | None:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become one."""
    spans = find_spans(text)
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"<{s.kind}>"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


SPAN_TYPE = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, spans): every span of every whole text, as structs of kind, start, end and score.

    One row per input row, null ids and repeated rows included; a null or empty text has no spans, an empty table gives an
    empty one. A text of any length is read whole. Other columns, whatever their names, play no part.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [
            [{"kind": s.kind, "start": s.start, "end": s.end, "score": s.score} for s in find_spans(x.as_py())]
            for x in batch.column(1)
        ]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPAN_TYPE)], names=[id_col, "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(
        docs.select(id_col, docs[text].cast("string")),
        run,
        f"`{id_col}` {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>",
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the personal data of its text replaced. All rows and columns stay as they are else, whatever their names.

    A null text stays null, an empty one empty; repeated rows stay repeated; an empty table stays empty. Texts are read whole.
    """
    at = docs.columns.index(text)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = pa.array([redact_text(x.as_py()) for x in batch.column(at)], pa.string())
        return pa.RecordBatch.from_arrays(
            [clean if i == at else batch.column(i) for i in range(batch.num_columns)], names=batch.schema.names
        )

    return map_batches(docs, run, docs.schema)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, digests, joined = [[] for _ in BASE_KINDS], [], []
        for x in batch.column(1):
            spans = find_spans(x.as_py())
            base = [s for s in spans if s.order < len(BASE_KINDS)]
            for order, held in enumerate(counts):
                held.append(sum(s.order == order for s in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            joined.append(_joined(spans))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(joined)],
            names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
        )

    longs = ", ".join(f"n_{k} bigint" for k in BASE_KINDS)
    return map_batches(docs, run, f"doc_id bigint, {longs}, base_sha256 string, spans string")
