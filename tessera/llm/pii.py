"""Operator 1, PII: regular expressions propose spans, checksums confirm, context adjusts the score.

Results: one row for each confirmed span, (doc_id, kind, start, end, score), offsets in
characters of the whole text, end exclusive.  `redact` replaces the same spans in place.

* Null and empty texts have no span; `redact` returns them as they are.
* Every row is looked at by itself: repeated rows give repeated results, a null doc_id is kept.
* Where spans overlap, the one with the higher score stays, then the longer, then the earlier.
* The work on a text is n log n in its spans, and what is looked at around each is bounded.
* An empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from ipaddress import IPv6Address

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_text, position, slices

#: Spans with a lower score are dropped.
THRESHOLD = 0.6
#: Characters looked at on each side for context words.
CONTEXT = 48

EMAIL_LOCAL = re.compile(r"[\w.%+'-]{1,64}\Z")
EMAIL_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
#: Digits in groups, as cards are written; one card may stand between other numbers.
GROUPED = re.compile(r"(?<![0-9])[0-9]+(?:[ -][0-9]+)*")
GROUP = re.compile(r"[0-9]+")
#: Shorter groups are tried only as a whole run, so that tables of small numbers aren't cards.
CARD_GROUP = 3
IPV4 = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*:(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4})(?![\w:])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
#: North American numbers have a fixed length; others end where one of their groups does.
PHONE_AMERICAN = re.compile(r"\+ ?1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])")
PHONE_CODE = re.compile(r"\+ ?[0-9]{1,15}(?![0-9])")
PHONE_AREA = re.compile(r"[ .-]?\([0-9]{1,4}\)")
PHONE_GROUP = re.compile(r"[ .-]?[0-9]{1,8}(?![0-9])")
PHONE_LOCAL = re.compile(r"(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{2}[0-9]{2}")
ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")

NEAR = {
    "email": (("email", "e-mail", "mail", "contact", "write"), ()),
    "card": (("card", "visa", "mastercard", "amex", "credit", "debit", "payment", "carte", "karte", "tarjeta"), ("order", "isbn", "serial", "tracking", "invoice")),
    "ipv6": (("ip", "host", "server", "address", "login", "from"), ("version", "release", "section", "chapter")),
    "ipv4": (("ip", "host", "server", "address", "login", "from"), ("version", "release", "section", "chapter")),
    "ssn": (("ssn", "social security", "taxpayer"), ("part", "serial", "order")),
    "phone": (("phone", "call", "tel", "mobile", "fax", "contact"), ("isbn", "serial", "order", "version")),
    "iban": (("iban", "account", "bank", "konto", "compte", "cuenta"), ()),
}
WORDS = {k: tuple(re.compile(r"\b(?:" + "|".join(map(re.escape, w)) + r")\b", re.I) if w else None for w in pair) for k, pair in NEAR.items()}
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24,
    "SM": 27, "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
    "YE": 30,
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616: first four characters to the end, letters as 10 to 35, remainder 1."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def issuer(digits: str) -> bool:
    """A prefix and a length that the large card networks use."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    return (
        (digits[0] == "4" and n in (13, 16, 19))
        or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720 or four == 6011 or two == 65 or 3528 <= four <= 3589))
        or (n == 15 and two in (34, 37))
        or (n == 14 and (two in (36, 38) or 300 <= int(digits[:3]) <= 305))
    )


def context(text: str, kind: str, start: int, end: int) -> float:
    good, bad = WORDS[kind]
    around = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    return (0.2 if good.search(around) else 0.0) - (0.3 if bad and bad.search(around) else 0.0)


def cards(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, digits) of 13 to 19 digits from group to group that pass Luhn, wherever in a run they stand."""
    for run in GROUPED.finditer(text):
        if run.end() - run.start() < 13:
            continue
        groups = [m.span() for m in GROUP.finditer(text, *run.span())]
        whole = "".join(text[a:b] for a, b in groups) if len(groups) < 20 else ""
        if text[run.start() - 1 : run.start()] != "+" and 13 <= len(whole) <= 19 and luhn(whole) and len(set(whole)) > 1:
            yield run.start(), run.end(), whole
        for k, (a, _) in enumerate(groups):
            if text[a - 1 : a] == "+":
                continue
            digits = ""
            for c, d in groups[k:]:
                if d - c < CARD_GROUP or len(digits) + d - c > 19:
                    break
                digits += text[c:d]
                if len(digits) >= 13 and luhn(digits) and len(set(digits)) > 1:
                    yield a, d, digits


def phones(text: str) -> Iterator[tuple[int, int]]:
    """International numbers of 8 to 15 digits: the most groups that stay within them."""
    at = text.find("+")
    while at >= 0:
        if american := PHONE_AMERICAN.match(text, at):
            yield at, american.end()
        elif m := PHONE_CODE.match(text, at):
            ends = [m.end()]
            if area := PHONE_AREA.match(text, m.end()):
                ends.append(area.end())
            least = 1  # digits of the next group
            while (g := PHONE_GROUP.match(text, ends[-1])) and len(ends) < 8:
                if g.end() - g.start() - (text[g.start()] in " .-") < least:
                    break
                ends.append(g.end())
                least = 2
            for end in reversed(ends):
                if 8 <= sum(c in "0123456789" for c in text[at:end]) <= 15:
                    yield at, end
                    break
        at = text.find("+", at + 1)


def ibans(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, upper case) of as many letters and digits as the country has, a space before any four of them."""
    for m in IBAN.finditer(text):
        left = IBAN_LENGTH.get(m[0][:2].upper(), 0)
        n, end = left, m.start()
        while left and end < len(text):
            if text[end] == " " and n - left and not (n - left) % 4 and text[end + 1 : end + 2] != " ":
                end += 1
            elif text[end] in ALNUM:
                end += 1
                left -= 1
            else:
                break
        found = text[m.start() : end]
        if n and not left and text[end : end + 1] not in ALNUM and (found.isupper() or found.islower()) and mod97(found):
            yield m.start(), end, found.isupper()


def ipv6(text: str) -> bool:
    """An address with three groups or more, one of them with a digit."""
    if len(text) > 45 or sum(map(bool, text.split(":"))) < 3 or not any(c.isdigit() for c in text):
        return False
    try:
        return bool(IPv6Address(text))
    except ValueError:
        return False


def proposals(text: str) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score before context) of what the expressions find and the checksums confirm."""
    at = text.find("@")
    while at >= 0:
        local = EMAIL_LOCAL.search(text, max(0, at - 64), at)
        domain = EMAIL_DOMAIN.match(text, at + 1)
        if local and domain:
            # a sentence's dots or quotes before the address aren't part of it
            start = at - len(local[0].lstrip(".'"))
            if start < at:
                yield "email", start, domain.end(), 0.9
        at = text.find("@", at + 1)
    for a, b, digits in cards(text):
        yield "card", a, b, 0.8 if issuer(digits) else 0.45
    for m in IPV4.finditer(text):
        if all(int(x) < 256 for x in m[0].split(".")):
            yield "ipv4", m.start(), m.end(), 0.7
    for m in IPV6.finditer(text):
        if ipv6(m[0]):
            yield "ipv6", m.start(), m.end(), 0.7
    for m in SSN.finditer(text):
        area = int(m[1])
        if area not in (0, 666) and area < 900 and int(m[2]) and int(m[3]):
            yield "ssn", m.start(), m.end(), 0.65
    for a, b in phones(text):
        yield "phone", a, b, 0.75
    for m in PHONE_LOCAL.finditer(text):
        yield "phone", m.start(), m.end(), 0.65
    for a, b, upper in ibans(text):
        yield "iban", a, b, 0.9 if upper else 0.65


def spans(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, float]]:
    """The confirmed spans of a text, in order, none overlapping another."""
    if not text:
        return []
    found = [(min(1.0, round(s + context(text, k, a, b), 2)), a, b, k) for k, a, b, s in proposals(text)]
    taken: list[tuple[int, int, str, float]] = []  # in order of their places
    for score, a, b, k in sorted({x for x in found if x[0] >= threshold}, key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        at = bisect_left(taken, (a,))
        if (at == len(taken) or b <= taken[at][0]) and (at == 0 or taken[at - 1][1] <= a):
            taken.insert(at, (a, b, k, score))
    return [(k, a, b, score) for a, b, k, score in taken]


def redacted(text: str, threshold: float = THRESHOLD) -> str:
    parts, last = [], 0
    for kind, a, b, _ in spans(text, threshold):
        parts += [text[last:a], f"[{kind.upper()}]"]
        last = b
    return "".join([*parts, text[last:]]) if last else text


#: A text with none of these has no span, so the arrays can be sieved before any string is made.
SIEVE = r"@|[0-9][0-9 ().\-]{5,}[0-9]|[A-Za-z]{2}[0-9]{2}|:[0-9A-Fa-f]*:"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each span of personal data in any document."""

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        piece = piece.filter(pc.match_substring_regex(piece.column("text"), SIEVE).fill_null(False))
        ids, texts = piece.column("id"), piece.column("text").to_pylist()
        rows, out = [], []
        for i, text in enumerate(texts):
            for s in spans(text, threshold):
                rows.append(i)
                out.append(s)
        cols = list(zip(*out)) if out else [(), (), (), ()]
        return pa.record_batch(
            [ids.take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.float64())],
            names=["doc_id", "kind", "start", "end", "score"],
        )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_text(source, run, "doc_id long, kind string, start int, end int, score double")


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """docs with each span replaced by its kind in brackets, and the length column, if there is one, set anew."""
    where, length = position(docs, text_col), position(docs, length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, where):
                column = piece.column(where)
                hit = pc.match_substring_regex(column, SIEVE).fill_null(False)
                if pc.any(hit).as_py():
                    new = pa.array([redacted(t, threshold) for t in column.filter(hit).to_pylist()], column.type)
                    text = pc.replace_with_mask(column, hit, new)
                    columns = [*piece.columns]
                    columns[where] = text
                    if length is not None:
                        sizes = pc.utf8_length(text).cast(piece.column(length).type)
                        columns[length] = pc.if_else(hit, sizes, piece.column(length))
                    piece = pa.record_batch(columns, schema=piece.schema)
                yield piece

    return docs.mapInArrow(run, docs.schema)
