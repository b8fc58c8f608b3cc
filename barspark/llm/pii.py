"""Personal data: expressions propose spans, checksums confirm them, nearby words adjust the score.

The proposals of the base kinds (email, ip, card, phone) are exactly their regular expressions,
leftmost and non-overlapping per kind; a proposal that fails its check is dropped without a second
try. Two more kinds are added: ``iban`` (mod 97) and ``ssn`` (kept only near a context word).
Spans are (kind, start, end, score) in code points, end exclusive, ordered by kind, then start.

Every search is linear in the text, whatever it holds: digit patterns run only inside maximal
stretches of digits and separators, and the local part of an email is read backwards from its @.

Defined cases: null or empty text has no spans; repeated rows are all returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspark.llm.common import packed, unpacked

# Kinds in listed order (base kinds first) and the expressions of the contract.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,score:double>>"
LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9][0-9 .\-]{6,}")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
# Base score of a confirmed span, and words nearby that raise or lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.85, "ssn": 0.3}
HELPS = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "address"),
         "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile", "fax"),
         "iban": ("iban", "bank", "account"), "ssn": ("ssn", "social security")}
HINDERS = {"ip": ("version", "release"), "card": ("order", "tracking", "invoice"), "phone": ("version",)}
CONTEXT, STEP, LEAST_ADDED = 40, 0.3, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def small_number(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans (kind, start, end) of a text."""
    free = 0  # where the previous email, or the previous @, ends
    for m in DOMAIN.finditer(text):
        at = m.start()
        before = text[max(free, text.rfind("@", free, at) + 1):at]
        local = len(before) - len(before.rstrip(LOCAL_CHARS))
        free = m.end() if local else at + 1
        if local:
            yield "email", at - local, m.end()
    for run in NUMBERS.finditer(text):
        for m in IP.finditer(text, run.start(), run.end()):
            if all(map(small_number, m.group().split("."))):
                yield "ip", m.start(), m.end()
        for m in CARD.finditer(text, run.start(), run.end()):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod97(m.group().replace(" ", "")):
            yield "iban", m.start(), m.end()
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    found = []
    for kind, start, end in proposals(text or ""):
        near = (text[max(0, start - CONTEXT):start] + " " + text[end:end + CONTEXT]).lower()
        score = SCORES[kind] + STEP * any(w in near for w in HELPS[kind])
        score = min(1.0, max(0.0, score - STEP * any(w in near for w in HINDERS.get(kind, ()))))
        if kind in BASE_KINDS or score >= LEAST_ADDED:
            found.append((kind, start, end, round(score, 3)))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Input rows with ``pii``: their spans, ordered by kind as listed, then start."""
    @F.pandas_udf(SPAN_TYPE)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t)] for t in texts], dtype=object)

    return unpacked(packed(df).withColumn("pii", spans(F.col("row").getField(text))), "pii")


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def of_kinds(spans: Column, kinds) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))
