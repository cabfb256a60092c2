"""Personal data: patterns propose spans, checksums confirm them, words nearby move their score."""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame

from .common import beside_text, laid_flat, map_texts


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


#: Kinds of the base, then those that the method adds; spans are listed in this order.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

#: Score of a proposal, what a passed checksum adds, and what a word nearby adds; added kinds are kept from KEEP on.
PRIOR = {"email": 0.7, "ip": 0.4, "card": 0.2, "phone": 0.4, "iban": 0.2, "ssn": 0.3, "account": 0.1}
CHECKED, NEARBY, AGAINST, KEEP = 0.5, 0.3, -0.4, 0.6
#: Characters before and after a span in which its words count.
REACH = 48
WORDS = {
    "email": re.compile(r"mail|contact|kontakt|correo", re.I),
    "ip": re.compile(r"\bip\b|server|host|address|adresse", re.I),
    "card": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.I),
    "phone": re.compile(r"phone|tel\b|telefon|mobile|call|fax", re.I),
    "iban": re.compile(r"iban|konto|compte|cuenta|account|bank", re.I),
    "ssn": re.compile(r"ssn|social security", re.I),
    "account": re.compile(r"card|visa|credit|karte|carte|tarjeta", re.I),
}
DOUBT = re.compile(r"example|sample|version|isbn|order no|part no", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Checks an account number: its first four characters go last, letters count from 10."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def emails(text: str):
    """Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @ in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
            at = last - 1
        at = text.find("@", at + 1)


def score(text: str, kind: str, start: int, end: int, checked: bool) -> float:
    near = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    value = PRIOR[kind] + CHECKED * checked + NEARBY * bool(WORDS[kind].search(near)) + AGAINST * bool(DOUBT.search(near))
    return min(1.0, max(0.0, value))


def find(text: str | None) -> list[Span]:
    """All spans of a text, by kind in the order of KINDS, then by start; code points, end exclusive. Null: none.

    All are scored. Spans of the base stay whatever their score.
    """
    if not text:
        return []

    def base(kind: str, span: tuple[int, int], checked: bool = False) -> Span:
        return Span(kind, *span, score(text, kind, *span, checked))

    spans = [base("email", x) for x in emails(text)]
    if not any(c in text for c in "0123456789"):
        return spans
    digits = []
    for m in IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts):
            spans.append(base("ip", m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        number = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(number) <= 19 and luhn(number):
            spans.append(base("card", m.span(), True))
        elif 13 <= len(number) <= 15:
            digits.append((*m.span(), number))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                spans.append(base("phone", m.span()))
    proposed = []
    for m in IBAN.finditer(text):
        code = m.group().replace(" ", "")
        if 15 <= len(code) <= 34:
            proposed.append(("iban", *m.span(), mod97(code)))
    proposed += [("ssn", *m.span(), False) for m in SSN.finditer(text)]
    proposed += [("account", s, e, True) for s, e, number in digits if luhn(number)]
    for kind, s, e, checked in proposed:
        if kind != "iban" or checked:
            if (value := score(text, kind, s, e, checked)) >= KEEP:
                spans.append(Span(kind, s, e, value))
    return spans


def listed(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the union gets the first's."""
    spans = sorted(find(text), key=lambda x: (x.start, -x.end))
    if not spans:
        return text
    out, at = [], 0
    for x in spans:
        if x.start >= at:
            out += [text[at : x.start], f"<{x.kind}>"]
        at = max(at, x.end)
    return "".join([*out, text[at:]])


def _row(text):
    spans = find(text)
    counts = [sum(x.kind == k for x in spans) for k in BASE_KINDS]
    base = listed([x for x in spans if x.kind in BASE_KINDS])
    scores = ",".join(f"{x.score:.1f}" for x in spans)
    return *counts, hashlib.sha256(base.encode()).hexdigest(), listed(spans), scores, min((x.score for x in spans), default=None)


def personal_data(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: ``keep``, counts of the base kinds, base_sha256, all spans as text, their scores and the lowest.

    Null and empty texts have no spans, an empty table gives no rows. Rows that repeat give repeated results, and no
    column beside ``keep`` and text is read. One pass, nothing is shuffled.
    """
    fields = [(f"n_{k}", "long") for k in BASE_KINDS]
    fields += [("base_sha256", "string"), ("spans", "string"), ("scores", "string"), ("least_score", "double")]
    empty = [[] for _ in fields]
    return map_texts(
        docs, list(keep), fields, lambda texts: [list(v) for v in zip(*map(_row, texts), strict=True)] or empty
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced in column text; null texts stay null, other columns as they are."""
    names = docs.columns
    done = map_texts(beside_text(docs), ["_doc"], [("_text", "string")], lambda texts: [list(map(redact, texts))])
    return laid_flat(done, names, "_text")
