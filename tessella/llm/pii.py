"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Four base kinds (email, ip, card, phone) follow fixed rules: leftmost non-overlapping matches of
their pattern, dropped if they fail the kind's test (parts up to 255, Luhn, number of digits). More
kinds come from the method: ``iban`` (mod-97) and ``ssn`` (a number of the form 3-2-4 with a telling
word nearby). Each span has a score: a prior per kind, more if a checksum holds, more or less for
words within ``CONTEXT`` characters. Base spans stay whatever their score; others need ``threshold``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import documents

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
CONTEXT = 48
THRESHOLD = 0.6
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.4, "ssn": 0.3}
CHECKSUM = 0.4
CONTEXT_STEP = 0.35
WORDS_FOR = {
    "email": ("mail", "contact"),
    "ip": ("ip", "address", "server", "host"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
WORDS_AGAINST = ("version", "example", "isbn", "order", "invoice", "test")

# Possessive repeats and look-behinds keep each pattern linear on long runs of its characters.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    compact = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left as far as the local part goes, to the right as the domain goes."""
    free, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1) if at >= free else None
        if domain:
            start = at
            while start > free and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """kind, start, end, whether a checksum holds; spans that fail their kind's test are left out."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, False
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                yield "ip", *m.span(), False
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span(), True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span(), False
    for m in _IBAN.finditer(text):
        if 15 <= len(m[0].replace(" ", "")) <= 34 and mod97(m[0]):
            yield "iban", *m.span(), True
    for m in _SSN.finditer(text):
        yield "ssn", *m.span(), False


def score(kind: str, start: int, end: int, checksum: bool, text: str) -> float:
    near = set(_WORD.findall(text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT].lower()))
    value = PRIOR[kind] + CHECKSUM * checksum
    value += CONTEXT_STEP * bool(near.intersection(WORDS_FOR[kind])) - CONTEXT_STEP * bool(near.intersection(WORDS_AGAINST))
    return min(1.0, max(0.0, value))


def find(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """Spans by kind, then start; offsets in code points, end exclusive."""
    out = []
    for kind, a, b, checksum in proposals(text):
        s = score(kind, a, b, checksum, text)
        if kind in BASE or s >= threshold:
            out.append((kind, a, b, s))
    return out


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and ``spans`` (array of kind, start, end, score) for every row of ``docs(doc_id, text, ...)``.

    A null text counts as empty and has no span. Repeated rows get a row each; doc_id may be null.
    An empty table gives an empty result; other columns are ignored, whatever their names. Texts of any
    length are searched whole.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t or "", threshold)] for t in texts])

    found = F.pandas_udf(run, "array<struct<kind: string, start: int, end: int, score: double>>")
    return docs.select("doc_id", found("text").alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    counts = [count(kind) for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def base_digest(spans: list[tuple[str, int, int, float]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans if k in BASE).encode()).hexdigest()
