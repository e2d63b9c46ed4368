"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors: at-signs, plus signs, digits, ``://`` and identifier cues in
several languages.  Each anchor starts a small deterministic parser that expands to the left and right
only as far as its own character class reaches, then validates: mail domains, address parts up to 255,
Luhn digits, digit counts, IBAN remainders, house numbers.  Text between anchors is never looked at
again, and every parser takes time in proportion to what it spans.

Spans are code points, end exclusive.  Kinds, in this order: email, ip, card, phone (complete), then what
anchors add: login (user and password of a URL), iban, account, address.
"""
from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .arrays import add_columns

KINDS = ("email", "ip", "card", "phone", "login", "iban", "account", "address")
SCHEMA = "spans array<struct<kind: string, start: long, end: long>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CARD_RUN, _CARD = re.compile(r"[0-9 -]+"), re.compile(r"[0-9](?:[ -]?[0-9])+")
_DOTTED_RUN, _DIGIT_RUN = re.compile(r"[0-9.]+"), re.compile(r"[0-9]+")
_PHONE_RUN = re.compile(r"[ ().0-9-]+")
_LOGIN = re.compile(r"[^\s/@:]++(?::[^\s/@]*+)?@(?=[A-Za-z0-9\[])")
_IBAN = re.compile(r"[\s:.#-]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
#: Characters of an IBAN by country.
_IBAN_SIZE = {c: int(x[:2]) for x in (
    "15 NO", "16 BE", "18 DK FI FK FO GL NL SD", "19 MK SI", "20 AT BA EE KZ LT LU MN XK", "21 CH HR LI LV", "22 BG BH CR DE GB GE IE ME RS VA",
    "23 AE GI IL IQ OM SO TL", "24 AD CZ ES MD PK RO SA SE SK TN VG", "25 LY PT ST", "26 IS TR", "27 BI DJ FR GR IT MC MR SM",
    "28 AL AZ BY CY DO GT HU LB NI PL SV", "29 BR EG PS QA UA", "30 JO KW MU YE", "31 MT SC", "32 LC", "33 RU") for c in x[3:].split()}
_ACCOUNT = re.compile(r"(?:[ ]?(?:number|no|nr|num|numéro|nummer|número|id))?[\s.:#=-]{1,4}([0-9](?:[ -]?[0-9]){5,16})(?![0-9A-Za-z])", re.I)
_HOUSE_BEFORE = re.compile(r"(?<![0-9A-Za-z.,])([0-9]{1,5}[A-Za-z]?,? (?:\w[\w.'-]* ){0,4})$")
_HOUSE_AFTER = re.compile(r"(?: (?:de|del|la|las|los|du|des|le|les))*(?: [A-ZÀ-Þ][\w.'-]*){0,4},? [0-9]{1,5}[A-Za-z]?(?![0-9A-Za-z.,-])")

#: Cues, in lower case; they count in lower, upper and capital form.
ACCOUNT_CUES = ("account", "acct", "konto", "compte", "cuenta")
STREET_CUES = ("street", "avenue", "boulevard", "road", "lane", "straße", "strasse", "platz", "rue", "calle", "avenida", "plaza")


def _forms(cue: str) -> set[str]:
    return {cue, cue.upper(), cue.capitalize()}


@cache
def _automaton():
    import ahocorasick
    found = ahocorasick.Automaton()
    for sign, kind in [("@", "at"), ("+", "plus"), ("://", "scheme"), *((d, "digit") for d in "0123456789")]:
        found.add_word(sign, (kind, len(sign)))
    for kind, cues in (("iban", ("iban",)), ("account", ACCOUNT_CUES), ("street", STREET_CUES)):
        for cue in cues:
            for form in _forms(cue):
                found.add_word(form, (kind, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _email(text: str, at: int, done: int) -> tuple[int, int] | None:
    start = at
    while start > done and text[start - 1] in _LOCAL:
        start -= 1
    domain = _DOMAIN.match(text, at + 1) if start < at else None
    return (start, domain.end()) if domain else None


def _cards(text: str, start: int, end: int):
    for m in _CARD.finditer(text, start, end):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _ips(text: str, start: int, end: int):
    numbers = [m.span() for m in _DIGIT_RUN.finditer(text, start, end)]
    i = 0
    while i + 3 < len(numbers):
        four = numbers[i:i + 4]
        if all(b[0] == a[1] + 1 for a, b in zip(four, four[1:])):
            parts = [text[a:b].lstrip("0") for a, b in four]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield four[0][0], four[3][1]
            i += 4
        else:
            i += 1


def _phone(text: str, plus: int) -> tuple[int, int] | None:
    if plus + 1 >= len(text) or text[plus + 1] not in _DIGITS:
        return None
    run = _PHONE_RUN.match(text, plus + 2)
    if not run:
        return None
    end = run.end()
    while end > plus + 3 and text[end - 1] not in _DIGITS:
        end -= 1
    if end <= plus + 3:
        return None
    return (plus, end) if 9 <= sum(c in _DIGITS for c in text[plus:end]) <= 15 else None


def _iban(text: str, cue_end: int) -> tuple[int, int] | None:
    m = _IBAN.match(text, cue_end)
    if not m:
        return None
    places = [k for k in range(m.start(1), m.end(1)) if text[k] != " "]
    size = _IBAN_SIZE.get(m[1][:2])
    # a country that is not known: every end, from long to short
    for n in [size] if size else range(len(places), 14, -1):
        end = places[n - 1] + 1 if n <= len(places) else len(text) + 1
        if end > len(text) or (end < len(text) and re.match("[A-Za-z0-9]", text[end])):
            continue
        raw = "".join(text[k] for k in places[:n])
        if int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1:
            return m.start(1), end
    return None


def _address(text: str, start: int, end: int) -> tuple[int, int] | None:
    whole = start == 0 or not text[start - 1].isalnum()
    if end < len(text) and text[end].isalpha():
        return None
    before = _HOUSE_BEFORE.search(text[max(0, start - 80):start]) if whole else None
    if before:
        return start - len(before[1]), end
    after = _HOUSE_AFTER.match(text, end)
    if after and (whole or text[start].islower()):
        while start > 0 and text[start - 1].isalpha():
            start -= 1
        return start, after.end()
    return None


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by kind as in KINDS and then by start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    mail_end = card_end = dotted_end = phone_end = 0
    for last, (kind, n) in _automaton().iter(text):
        start = last - n + 1
        if kind == "digit":
            if start >= card_end:
                card_end = _CARD_RUN.match(text, start).end()
                out["card"] += _cards(text, start, card_end)
            if start >= dotted_end:
                dotted_end = _DOTTED_RUN.match(text, start).end()
                if dotted_end - start >= 7:
                    out["ip"] += _ips(text, start, dotted_end)
            continue
        if kind == "at":
            span = _email(text, start, mail_end) if start >= mail_end else None
            # whatever failed, the next mail starts behind this sign
            mail_end = span[1] if span else max(mail_end, start + 1)
            kind = "email"
        elif kind == "plus":
            span, kind = _phone(text, start) if start >= phone_end else None, "phone"
            phone_end = span[1] if span else phone_end
        elif kind == "scheme":
            m = _LOGIN.match(text, last + 1)
            span, kind = (m.start(), m.end() - 1) if m else None, "login"
        elif kind == "iban":
            span = _iban(text, last + 1)
        elif kind == "account":
            m = _ACCOUNT.match(text, last + 1) if start == 0 or not text[start - 1].isalnum() else None
            span = m.span(1) if m else None
        else:
            span, kind = _address(text, start, last + 1), "address"
        if span:
            out[kind].append(span)
    return [(k, a, b) for k in KINDS for a, b in sorted(set(out[k]))]


def personal_data(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Documents with ``spans``; null is the empty text and has none.  A column named spans gives way."""
    def make():
        kinds = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

        def work(column: pa.Array) -> list:
            return [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] if t else [] for t in column.to_pylist()], pa.list_(kinds))]
        return work
    return add_columns(docs, SCHEMA, make, text, keep)


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op4_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


QUERIES = {"op4_pii_anchors": op4_pii_anchors}
ORACLES: dict[str, str] = {}
