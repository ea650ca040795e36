"""Personal data (7): patterns propose spans, checksums confirm them, nearby words adjust the score.

Four base kinds (email, ip, card, phone) are kept whenever their pattern and their own check hold. The
method adds account numbers (``iban``, mod 97) and numbers without a country code that
words such as "phone" announce (``local_phone``); these are kept from a score of 0.5 on. Every span has a score: a
start value of its kind, raised by a passed checksum and by a context word shortly before it, lowered
by a word that speaks against it.

All scans are linear in the text. Offsets are code points, the end is exclusive.

Cases: null and empty texts have no span. Spans of different kinds may overlap; ``redact`` merges them.
Repeated rows give the same spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewagon.llm.common import objects, strings

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "local_phone")
KEEP = 0.5
CONTEXT = 32  # code points before a span that are searched for context words

# The patterns of the base kinds.
_LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# Kinds that the method adds.
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w+.-])0[0-9]{1,4}[\x20/-][0-9]{3,4}(?:[\x20-]?[0-9]{2,4}){1,2}(?![\w-])")

_START = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.6, "iban": 0.4, "local_phone": 0.3}
_CHECKSUM = 0.3
_NEAR = 0.3
_FOR = {
    "email": re.compile(r"mail|contact|write", re.I), "ip": re.compile(r"\bip\b|host|server|address", re.I),
    "card": re.compile(r"card|visa|credit|pay", re.I), "phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
    "iban": re.compile(r"iban|account|bank|konto|cuenta|compte", re.I),
    "local_phone": re.compile(r"phone|tel|call|mobile|fax", re.I),
}
_AGAINST = {
    "ip": re.compile(r"version|release|section", re.I), "card": re.compile(r"isbn|order|serial", re.I),
    "local_phone": re.compile(r"isbn|order|serial|version", re.I),
}
_DIGIT = re.compile(r"[0-9]")
_DOUBLED = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    moved = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each at sign: a local part holds none, so it is the run before it."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and text[start - 1] in _LOCAL_PART:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            used = domain.end()
            yield start, used
        else:
            used = at  # nothing to the left of this sign can be part of a later match
        at = text.find("@", max(used, at + 1))


def _part_fits(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _base(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in _emails(text):
        yield "email", start, end
    if not _DIGIT.search(text):
        return
    if "." in text:
        for m in _IP.finditer(text):
            if all(map(_part_fits, m[0].split("."))):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(str.isdigit, m[0])) <= 15:
                yield "phone", m.start(), m.end()


def _added(text: str) -> Iterator[tuple[str, int, int, bool]]:
    if not _DIGIT.search(text):
        return
    for m in _IBAN.finditer(text):
        account = m[0].replace(" ", "")
        if 15 <= len(account) <= 34:
            yield "iban", m.start(), m.end(), mod97(account)
    for m in _LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end(), False


def _score(text: str, kind: str, start: int, checked: bool) -> float:
    before = text[max(0, start - CONTEXT):start]
    score = _START[kind] + _CHECKSUM * checked + _NEAR * bool(_FOR[kind].search(before))
    if kind in _AGAINST and _AGAINST[kind].search(before):
        score -= _NEAR
    return round(min(1.0, max(0.0, score)), 3)


def find(text: str | None) -> list[Span]:
    """All spans by start, then by kind in the order of ``KINDS``."""
    if not text:
        return []
    spans = [Span(kind, a, b, _score(text, kind, a, kind == "card")) for kind, a, b in _base(text)]
    taken = sorted((s.start, s.end) for s in spans)
    for kind, a, b, checked in _added(text):
        score = _score(text, kind, a, checked)
        if (checked or kind != "iban") and score >= KEEP and (
                kind == "iban" or not any(x < b and a < y for x, y in taken)):
            spans.append(Span(kind, a, b, score))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str | None, spans: list[Span] | None = None) -> str | None:
    """The text with every span, or group of overlapping spans, replaced by the kind of its first."""
    if not text:
        return text
    pieces, done, open_kind = [], 0, None
    for span in find(text) if spans is None else spans:
        if open_kind is not None and span.start < done:
            done = max(done, span.end)
            continue
        if open_kind is not None:
            pieces.append(f"[{open_kind.upper()}]")
        pieces.append(text[done:span.start])
        open_kind, done = span.kind, span.end
    if open_kind is not None:
        pieces.append(f"[{open_kind.upper()}]")
    pieces.append(text[done:])
    return "".join(pieces)


def listing(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def found(text: Column) -> Column:
    """Array of spans of a text column."""

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[asdict(s) for s in find(t)] for t in strings(texts)], dtype=object)

    return spans(text)


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and list of the spans of every document."""

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>")
    def summed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in strings(texts):
            spans = find(text)
            base = [s for s in spans if s.kind in BASE_KINDS]
            rows.append((*[sum(s.kind == k for s in base) for k in BASE_KINDS],
                         hashlib.sha256(listing(base).encode()).hexdigest(), listing(spans), [s.score for s in spans]))
        names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"]
        return pd.DataFrame({name: objects(r[i] for r in rows) for i, name in enumerate(names)})

    return docs.select("doc_id", summed("text").alias("r")).select("doc_id", "r.*")


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their personal data replaced, and ``n_chars`` of the new text where it is a column."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t) for t in strings(texts)], dtype=object)

    out = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
