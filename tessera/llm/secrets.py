"""Operator 5, secret scans through a trigram inverted index.

`trigram_query` derives from a regex a Boolean query that every matching text satisfies: AND and
OR over three-byte strings.  Each slice of documents becomes an index segment: for every
trigram that some query names, the sorted list of the slice's documents that hold it.  Postings
are intersected and united as the query says, and only the candidates are searched with the
regex.  A rule whose query is empty (no mandatory trigram) searches every document: with Arrow's
regex engine first, where that has the same language, so that only texts with a match become
Python strings.  A match counts if it has the entropy that its rule asks for, and one of the rule's
context words before it, so that a commit's digest is no key.

Index and queries use bytes with A-Z folded to a-z, so a rule's case doesn't matter to them;
the regex itself decides.  Segments are local to a task: no shuffle, one scan, any size.

Results: (doc_id, rule, start, end), offsets in characters of the whole text.

* Null and empty texts match nothing (rules never match the empty string).
* Rows are scanned one by one, so repeated rows and null ids give their own results.
* Matches of one rule don't overlap; those of different rules may, and all are returned.
* An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import cache
from itertools import product
from re import _constants as C
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_text, utf8_buffer



class Rule(NamedTuple):
    pattern: str
    #: What must stand within REACH characters before the match.
    near: str | None = None
    #: Bits for each character of the match, at least.
    entropy: float = 0.0


REACH = 40
KEY_WORDS = r"(?i)(?:key|secret|token|passw|credential|auth|private)"
RULES: dict[str, Rule] = {
    name: Rule(pattern)
    for name, pattern in {
        "assigned_secret": r"(?i)\b(?:token|secret|api[_-]?key|passwd|password|access[_-]?key)\s*[:=]\s*[\"'][0-9a-z_\-+/=.]{16,}[\"']",
        "age_key": r"\bAGE-SECRET-KEY-1[0-9A-Z]{58}\b",
        "aws_key_id": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
        "azure_account_key": r"\bAccountKey=[0-9A-Za-z+/]{86}==",
        "basic_auth": r"(?i)\bauthorization:\s*basic\s+[0-9a-z+/]{8,}={0,2}",
        "bearer": r"(?i)\bauthorization:\s*bearer\s+[0-9a-z_\-.=]{16,}",
        "braintree_token": r"\baccess_token\$production\$[0-9a-z]{16}\$[0-9a-f]{32}\b",
        "cloud_account_key": r"\"private_key_id\"\s*:\s*\"[0-9a-f]{40}\"",
        "container_registry_token": r"\bdckr_pat_[0-9A-Za-z_-]{27}",
        "databricks_token": r"\bdapi[0-9a-f]{32}\b",
        "digitalocean_token": r"\bdo[opr]_v1_[0-9a-f]{64}\b",
        "github_fine_token": r"\bgithub_pat_[0-9A-Za-z_]{36,}",
        "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
        "gitlab_token": r"\bglpat-[0-9A-Za-z_-]{20}",
        "google_key": r"\bAIza[0-9A-Za-z_-]{35}",
        "google_oauth": r"\bya29\.[0-9A-Za-z_-]{20,}",
        "grafana_token": r"\bglsa_[0-9A-Za-z]{32}_[0-9a-f]{8}\b",
        "hub_token": r"\bhf_[A-Za-z]{34}\b",
        "jwt": r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
        "linear_key": r"\blin_api_[0-9A-Za-z]{40}\b",
        "mailchimp_key": r"\b[0-9a-f]{32}-us[0-9]{1,2}\b",
        "mailgun_key": r"\bkey-[0-9a-f]{32}\b",
        "netrc_password": r"\bmachine\s+\S+\s+login\s+\S+\s+password\s+\S+",
        "newrelic_key": r"\bNRAK-[0-9A-Z]{27}\b",
        "npm_token": r"\bnpm_[0-9A-Za-z]{36}\b",
        "postman_key": r"\bPMAK-[0-9a-f]{24}-[0-9a-f]{34}\b",
        "private_key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY(?: BLOCK)?-----",
        "pypi_token": r"\bpypi-AgE[0-9A-Za-z_-]{50,}",
        "sendgrid_key": r"\bSG\.[0-9A-Za-z_-]{22}\.[0-9A-Za-z_-]{43}",
        "shopify_token": r"\bshp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}\b",
        "slack_token": r"\bxox[abeprs]-[0-9A-Za-z-]{10,}",
        "slack_webhook": r"\bhooks\.slack\.com/services/T[0-9A-Z]{8,}/B[0-9A-Z]{8,}/[0-9A-Za-z]{24}",
        "square_token": r"\bsq0(?:atp|csp|idp)-[0-9A-Za-z_-]{22,43}",
        "stripe_key": r"\b[rs]k_live_[0-9A-Za-z]{16,}",
        "stripe_webhook": r"\bwhsec_[0-9A-Za-z]{32,}",
        "telegram_token": r"\b[0-9]{8,10}:AA[0-9A-Za-z_-]{33}",
        "twilio_key": r"\b(?:SK|AC)[0-9a-f]{32}\b",
        "url_password": r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/:@]+@[^\s/]+",
    }.items()
} | {
    # no mandatory trigram: searched in full
    "hex_key": Rule(r"\b[0-9a-f]{32}(?:[0-9a-f]{8})?(?:[0-9a-f]{24})?\b", KEY_WORDS, 3.0),
    "base64_key": Rule(r"\b[0-9A-Za-z+/]{40,88}={0,2}", KEY_WORDS, 4.5),
}
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Most strings that a part of a regex is enumerated to, and most characters of a class.
MOST = 48

# A query is True (no constraint) or ("and"|"or", parts) or a trigram (bytes).


def _join(op: str, parts: list) -> object:
    """Simplified conjunction or disjunction; True absorbs an "or" and drops out of an "and"."""
    flat: list = []
    for p in parts:
        if p is True:
            if op == "or":
                return True
            continue
        flat += p[1] if isinstance(p, tuple) and p[0] == op else [p]
    flat = list(dict.fromkeys(flat))
    if not flat:
        return True
    return flat[0] if len(flat) == 1 else (op, tuple(flat))


def _strings(words: set[bytes]) -> object:
    """Some string of the set occurs: an "or" over the "and" of each one's trigrams."""
    if any(len(w) < 3 for w in words):
        return True
    return _join("or", [_join("and", [w[i : i + 3] for i in range(len(w) - 2)]) for w in sorted(words)])


def _chars(node: list) -> set[bytes] | None:
    """The folded UTF-8 strings of a character class, or None if it is wide."""
    out: set[int] = set()
    for op, arg in node:
        if op is C.LITERAL:
            out.add(arg)
        elif op is C.RANGE:
            if arg[1] - arg[0] > MOST:
                return None
            out |= set(range(arg[0], arg[1] + 1))
        else:
            return None
    words = {chr(c).encode().translate(FOLD) for c in out}
    return words if len(words) <= MOST else None


class _Info:
    """exact: all strings the part can match, or None.  Otherwise its match has one of `head` as
    prefix and one of `tail` as suffix, and satisfies `query`."""

    def __init__(self, exact=None, head=frozenset({b""}), tail=frozenset({b""}), query=True):
        self.exact, self.query = exact, query
        self.head, self.tail = (exact, exact) if exact is not None else (head, tail)

    def then(self, other: "_Info") -> "_Info":
        if self.exact is not None and other.exact is not None and len(self.exact) * len(other.exact) <= MOST:
            return _Info({a + b for a, b in product(self.exact, other.exact)})
        query = [self.query, other.query]
        if self.exact is not None:
            query.append(_strings(self.exact))
        if other.exact is not None:
            query.append(_strings(other.exact))
        if len(self.tail) * len(other.head) <= MOST:
            query.append(_strings({a + b for a, b in product(self.tail, other.head)}))
        head, tail = self.head, other.tail
        if self.exact is not None and len(self.exact) * len(other.head) <= MOST:
            head = {a + b for a, b in product(self.exact, other.head)}
        if other.exact is not None and len(self.tail) * len(other.exact) <= MOST:
            tail = {a + b for a, b in product(self.tail, other.exact)}
        return _Info(None, head, tail, _join("and", query))

    def final(self) -> object:
        return _strings(self.exact) if self.exact is not None else _join("and", [self.query, _strings(self.head), _strings(self.tail)])

    def either(self, other: "_Info") -> "_Info":
        if self.exact is not None and other.exact is not None and len(self.exact | other.exact) <= MOST:
            return _Info(self.exact | other.exact)
        head, tail = self.head | other.head, self.tail | other.tail
        blank = frozenset({b""})
        return _Info(None, head if len(head) <= MOST else blank, tail if len(tail) <= MOST else blank, _join("or", [self.final(), other.final()]))


def _walk(nodes, ignore: bool) -> _Info:
    out = _Info({b""})
    for op, arg in nodes:
        if op is C.LITERAL:
            # other letters than A to Z aren't folded, so under IGNORECASE nothing is known of them
            part = _Info() if ignore and arg > 127 else _Info({chr(arg).encode().translate(FOLD)})
        elif op is C.IN:
            words = _chars(arg)
            part = _Info(words) if words else _Info()
        elif op is C.SUBPATTERN:
            part = _walk(arg[3], ignore or bool(arg[1] & re.I))
        elif op is C.BRANCH:
            part = _walk(arg[1][0], ignore)
            for branch in arg[1][1:]:
                part = part.either(_walk(branch, ignore))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, sub = arg
            inner = _walk(sub, ignore)
            if low == 0:
                part = inner.either(_Info({b""})) if high == 1 else _Info()
            elif low == high and low <= 8:
                part = inner
                for _ in range(low - 1):
                    part = part.then(inner)
            else:
                part = inner.then(_Info())
        elif op is C.ATOMIC_GROUP:
            part = _walk(arg, ignore)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            part = _Info({b""})
        else:  # any character, a back reference, a negated character: nothing is known
            part = _Info()
        out = out.then(part)
    return out


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query of a regex; True where it has no mandatory trigram.

    Letters whose case folding leaves ASCII (k and s under IGNORECASE match U+212A and U+017F)
    are matched as ASCII only: rules are compiled with re.ASCII.
    """
    tree = _parser.parse(pattern, re.ASCII)
    return _walk(tree, bool(tree.state.flags & re.I)).final()


def trigrams_of(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


def entropy(text: str) -> float:
    """Bits for each character."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


#: Where Arrow's engine and Python's differ, or the former has nothing.
DIFFERENT = re.compile(r"\\[sSZAB1-9]|\$|\^|\(\?[=!<P>(]|[*+?}]\+")


def arrow_pattern(pattern: str) -> str | None:
    """The pattern, if every text that Python finds it in is one that Arrow finds it in."""
    if DIFFERENT.search(pattern):
        return None
    try:
        pc.match_substring_regex(pa.array([""]), pattern)
    except pa.ArrowInvalid:
        return None
    return pattern


class Verifier:
    """A rule's regex, and what else its matches must have."""

    def __init__(self, name: str, rule: Rule):
        self.regex = re.compile(rule.pattern, re.ASCII)
        self.near = re.compile(rule.near) if rule.near else None
        self.entropy = rule.entropy
        if self.regex.search(""):
            raise ValueError(f"rule {name} matches the empty string")

    def matches(self, text: str) -> list[tuple[int, int]]:
        return [
            m.span()
            for m in self.regex.finditer(text)
            if (self.near is None or self.near.search(text[max(0, m.start() - REACH) : m.start()])) and (not self.entropy or entropy(m[0]) >= self.entropy)
        ]


@cache
def _compiled(rules: tuple[tuple[str, Rule], ...]):
    verifiers = {name: Verifier(name, rule) for name, rule in rules}
    asked = {name: trigram_query(rule.pattern) for name, rule in rules}
    names = sorted(set().union(*map(trigrams_of, asked.values())))
    table = np.zeros(1 << 24, np.uint16)
    for k, t in enumerate(names):
        table[t[0] << 16 | t[1] << 8 | t[2]] = k + 1
    sieve = {name: arrow_pattern(rule.pattern) for name, rule in rules if asked[name] is True}
    return verifiers, asked, {t: k + 1 for k, t in enumerate(names)}, table, sieve


def postings(column: pa.Array, table: np.ndarray) -> dict[int, np.ndarray]:
    """The segment's index: for each trigram number of the table, the sorted documents that hold it."""
    raw, offsets = utf8_buffer(column)
    if len(raw) < 3:
        return {}
    low = np.frombuffer(FOLD, np.uint8)[raw].astype(np.int32)
    found = table[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
    at = np.flatnonzero(found)
    doc = np.searchsorted(offsets, at, "right") - 1
    inside = at + 3 <= offsets[doc + 1]
    key = np.unique(found[at[inside]].astype(np.int64) << 32 | doc[inside])
    trigram, doc = key >> 32, key & 0xFFFFFFFF
    cuts = np.flatnonzero(np.diff(trigram)) + 1
    return {int(trigram[s[0]]): doc[s] for s in np.split(np.arange(len(key)), cuts) if len(s)}


def candidates(query: object, index: dict[int, np.ndarray], number: dict[bytes, int], n: int) -> np.ndarray:
    """Documents of the segment that satisfy the query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return index.get(number[query], np.zeros(0, np.int64))
    parts = [candidates(q, index, number, n) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    parts.sort(key=len)
    out = parts[0]
    for p in parts[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, p, assume_unique=True)
    return out


def scan(docs: DataFrame, rules: dict[str, str | Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each match of any rule in any document."""
    chosen = tuple((name, r if isinstance(r, Rule) else Rule(r)) for name, r in (rules or RULES).items())
    _compiled(chosen)  # a faulty rule fails here, not in a task

    def run(piece: pa.RecordBatch) -> pa.RecordBatch:
        verifiers, asked, number, table, sieve = _compiled(chosen)
        column = piece.column("text")
        index = postings(column, table)
        texts: dict[int, str] = {}
        rows, rule, start, end = [], [], [], []
        for name, verifier in verifiers.items():
            found = candidates(asked[name], index, number, len(column))
            if sieve.get(name):
                found = np.flatnonzero(pc.match_substring_regex(column, sieve[name]).fill_null(False).to_numpy(zero_copy_only=False))
            for d in found.tolist():
                if d not in texts:
                    texts[d] = column[d].as_py() or ""
                for s, e in verifier.matches(texts[d]):
                    rows.append(d)
                    rule.append(name)
                    start.append(s)
                    end.append(e)
        return pa.record_batch(
            [piece.column("id").take(pa.array(rows, pa.int64())), pa.array(rule, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
            names=["doc_id", "rule", "start", "end"],
        )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_text(source, run, "doc_id long, rule string, start int, end int")
