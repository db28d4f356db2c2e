"""Personal data: patterns propose spans, checksums confirm them, context sets the score.

Base kinds (e-mail, address, card, phone) are always reported when their pattern and checks
hold. Two kinds are added by score alone: account numbers (IBAN, confirmed by mod 97) and
national phone numbers, which need a context word nearby. A number next to a word that
names something else (an order, an invoice) loses score.
"""

from __future__ import annotations

import re
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, require, text_bytes
from ._spans import Covered, Span, code_points, digest, joined, ordered

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "local_phone")
#: Characters on either side that count as nearby, and the score from which a span is added.
NEARBY, ENOUGH = 48, 0.5
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "local_phone": 0.3}
# Words that speak for a kind.
FOR = {
    "email": (b"mail", b"contact", b"write", b"@"),
    "ip": (b"ip", b"address", b"host", b"server", b"login"),
    "card": (b"card", b"visa", b"credit", b"karte", b"carte", b"tarjeta"),
    "phone": (b"phone", b"tel", b"call", b"mobile", b"fax"),
    "iban": (b"iban", b"account", b"bank", b"konto", b"compte", b"cuenta"),
    "local_phone": (b"phone", b"tel", b"call", b"mobile", b"fax"),
}
# Words that speak against any kind of number.
AGAINST = (b"order", b"invoice", b"isbn", b"version", b"article", b"item no")
# Lengths of account numbers by country, the whole registry.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28,
    "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18,
    "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28,
    "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BYTES = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can begin only where a run of digits does: runs are taken whole.
_IP = re.compile(rb"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(rb"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?= ?[A-Z0-9])")
_IBAN_REST = {k.encode(): re.compile(rb"(?: ?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for k, n in IBAN_LENGTH.items()}
_LOCAL_PHONE = re.compile(rb"(?<![A-Za-z0-9+])\(?0[0-9]{1,4}\)?[ /-]?[0-9](?:[ -]?[0-9]){5,9}(?![A-Za-z0-9])")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(account: str) -> bool:
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(raw: bytes) -> bytes:
    return bytes(c for c in raw if 48 <= c <= 57)


def emails(raw: bytes) -> list[Span]:
    """Around each ``@``: the run of name characters before it that no earlier match holds."""
    found, free, at = [], 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > free and raw[start - 1] in _LOCAL_BYTES:
            start -= 1
        if start < at and (m := _DOMAIN.match(raw, at + 1)):
            found.append(("email", start, m.end()))
            free = m.end()
            at = raw.find(b"@", free)
        else:
            at = raw.find(b"@", at + 1)
    return found


def base_spans(raw: bytes) -> list[Span]:
    found = emails(raw)
    for m in _IP.finditer(raw):
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in (q.lstrip(b"0") for q in m[0].split(b"."))):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(raw):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if b"+" in raw:
        for m in _PHONE.finditer(raw):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def proposed(raw: bytes) -> list[Span]:
    found = []
    free = 0  # the end of the last account number: no other begins inside it
    for m in _IBAN.finditer(raw):
        pattern = _IBAN_REST.get(m[0][:2]) if m.start() >= free else None
        rest = pattern.match(raw, m.end()) if pattern else None
        if rest and mod97((m[0] + rest[0]).replace(b" ", b"").decode()):
            free = rest.end()
            found.append(("iban", m.start(), free))
    found += [("local_phone", m.start(), m.end()) for m in _LOCAL_PHONE.finditer(raw)]
    return found


def score(raw: bytes, span: Span) -> float:
    kind, a, b = span
    near = (raw[max(0, a - NEARBY) : a] + b" " + raw[b : b + NEARBY]).lower()
    value = PRIOR[kind] + 0.3 * any(w in near for w in FOR[kind]) - 0.3 * any(w in near for w in AGAINST)
    return min(1.0, max(0.0, value))


def find(raw: bytes | None) -> tuple[list[Span], list[Span], list[float]]:
    """Base spans, all spans, and the scores of the latter; in code points, ordered."""
    raw = raw or b""
    base = ordered(base_spans(raw), KINDS)
    added: list[Span] = []
    # one kind after the other; spans of one kind do not overlap
    for _, own in groupby(proposed(raw), key=itemgetter(0)):
        taken = Covered(base + added)
        added += [span for span in own if not taken.meets(span[1], span[2]) and score(raw, span) >= ENOUGH]
    every = ordered(base + added, KINDS)
    return code_points(raw, base), code_points(raw, every), [score(raw, s) for s in every]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def _run(batch: pa.RecordBatch) -> pa.RecordBatch:
    counts, digests, texts, spans = [[] for _ in BASE], [], [], []
    for raw in batch.column(1).to_pylist():
        base, every, scores = find(raw)
        for column, kind in zip(counts, BASE, strict=True):
            column.append(sum(s[0] == kind for s in base))
        digests.append(digest(base))
        texts.append(joined(every))
        spans.append([{"kind": k, "start": a, "end": b, "score": v} for (k, a, b), v in zip(every, scores, strict=True)])
    columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(texts, pa.string()), pa.array(spans, _SPAN)]
    return pa.RecordBatch.from_arrays(columns, names=["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "found"])


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, found)``, one row per
    input row: base counts, the digest of base spans, all spans as text and with scores.

    One pass without a shuffle over whole texts. Null texts count as empty; ids may be null or
    repeat; other columns are not read, whatever their names; an empty table gives an empty table.
    """
    require(docs, id_col, text_col)
    source = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw"))
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in BASE)
    out = map_arrow(source, _run, f"id {kind}, {counts}, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,score:double>>")
    return out.withColumnRenamed("id", id_col)
