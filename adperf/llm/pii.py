"""Personal data: regular expressions propose, checksums confirm, context scores.

Base kinds (always reported once confirmed): email, ip, card (Luhn), phone.
Added kinds: ``iban`` (mod-97) and ``ssn`` (number ranges).  A proposed span
starts from its kind's score; context words of the kind within ``CONTEXT``
characters raise it, words of placeholders lower it.  An added span is
reported from ``THRESHOLD`` up; a base span is always reported, with its score.

Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adperf.llm.common import fresh, named, slices

#: Order in which spans that start together are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
CONTEXT = 40
THRESHOLD = 0.6
START = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "ssn": 0.4}
RAISE, LOWER = 0.3, 0.3
#: Context words of each kind (fixed values of this library).
HINTS = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
}
#: Characters of an account number by country (fixed values of the public registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22,
    "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30,
    "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20,
    "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22,
    "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26,
    "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
DOUBTS = ("example", "sample", "dummy", "test")

# Runs are matched possessively: nothing that follows a run could match inside it,
# so the matches are those of the plain patterns, in linear time.  An account number's
# run may go on into the next words; ``ibans`` cuts it back.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+))")
_IN_WORD = re.compile(r"[A-Za-z0-9]")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_WORD = re.compile(r"[a-z-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an account number: letters as 10 to 35, first four characters last."""
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str):
    """Leftmost non-overlapping matches of the email pattern.

    Every match has one ``@`` after its name, so the search goes from ``@`` to ``@``.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        m = begin < at and _DOMAIN.match(text, at + 1)
        if m:
            end = m.end()
            yield begin, end
        at = text.find("@", max(end, at + 1))


def ibans(text: str):
    """Non-overlapping account numbers that check, from left to right.

    A number has the length of its country, blanks aside, ends with a word and passes the check;
    where one does not, the search goes on behind the first four characters.
    """
    end = 0
    for m in _IBAN.finditer(text):
        length = IBAN_LENGTHS.get(m[0][:2])
        if m.start() < end or length is None:
            continue
        span = m[0] + m[1]
        # the place behind the last character of the number
        stop = next((k for k in range(length, len(span) + 1) if k - span.count(" ", 0, k) == length), 0)
        if stop and not _IN_WORD.match(text, m.start() + stop) and mod97(span[:stop]):
            end = m.start() + stop
            yield m.start(), end


def proposed(text: str):
    """(kind, start, end) of every confirmed span, base kinds and added ones."""
    if "@" in text:
        for a, b in emails(text):
            yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    for a, b in ibans(text):
        yield "iban", a, b
    for m in _SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span()


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind as listed in ``KINDS``."""
    out = []
    for kind, a, b in proposed(text):
        near = set(_WORD.findall((text[max(0, a - CONTEXT) : a] + " " + text[b : b + CONTEXT]).lower()))
        score = START[kind] + RAISE * (not near.isdisjoint(HINTS[kind])) - LOWER * (not near.isdisjoint(DOUBTS))
        score = round(min(1.0, max(0.0, score)), 2)
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, a, b, score))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, *_ in spans)


def masked(text: str, spans) -> str:
    """``text`` with each span replaced by its kind; overlapping spans are replaced together."""
    out, end = [], 0
    for kind, a, b, _ in spans:
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,start,end,score>>) of every row.

    Null counts as empty and has no span; repeated rows give repeated results;
    an empty table gives none; other columns are not read.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in slices(batches, "text"):
            found = [find(t or "") for t in b.column("text").to_pylist()]
            rows = [[{"kind": k, "start": s, "end": e, "score": c} for k, s, e, c in x] for x in found]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(rows, kind)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, spans array<struct<kind:string,start:int,end:int,score:double>>")


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and all spans as text, from :func:`detect_pii`."""

    def text(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.kind.isin(*BASE))
    return spans.select("id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def mask_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every found span of ``text_col`` replaced by its kind in brackets.

    ``length_col``, where it exists, becomes the new length of a changed text.
    A null text stays null.
    """

    @F.pandas_udf("string")
    def cover(texts):
        return texts.map(lambda t: masked(t, find(t)), na_action="ignore")

    names, new_text = docs.columns, fresh(docs, "__masked")
    out = docs.withColumn(new_text, cover(F.col(text_col)))
    new = {text_col: F.col(new_text)}
    if length_col in names:
        kind = docs.schema[length_col].dataType
        changed = ~F.col(new_text).eqNullSafe(F.col(text_col))
        new[length_col] = F.when(changed, F.length(new_text).cast(kind)).otherwise(F.col(length_col))
    return out.select(*[new.get(c, named(c)).alias(c) for c in names])
