import random
import time
from ipaddress import IPv6Address
from itertools import groupby

from tessera.llm import pii

from .conftest import AWKWARD, LONG


def kinds(text):
    return [(k, text[a:b]) for k, a, b, _ in pii.spans(text)]


def test_spans():
    assert kinds("write to ann.lee+x@mail.example.com, or call +1 (415) 555-0199 now") == [("email", "ann.lee+x@mail.example.com"), ("phone", "+1 (415) 555-0199")]
    assert kinds("card 4111 1111 1111 1111 and 4111111111111112") == [("card", "4111 1111 1111 1111")]
    assert kinds("from 10.20.30.40 to 300.1.1.1 or 1.2.3.4.5") == [("ipv4", "10.20.30.40")]
    assert kinds("SSN 123-45-6789, not 000-12-3456 or 912-11-1111") == [("ssn", "123-45-6789")]
    assert kinds("account DE89 3704 0044 0532 0130 00 please; DE89 3704 0044 0532 0130 01") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("GB82WEST12345698765432") == [("iban", "GB82WEST12345698765432")]
    assert kinds("von.55@mail4.example.com") == [("email", "von.55@mail4.example.com")]
    assert kinds("a @ b, @home, me@, x@y") == [] and kinds("1234567890123456 pages, year 2024") == []
    assert kinds("release version 1.2.3.4 of it") == []  # context takes it below the threshold


def test_cards_beside_other_numbers():
    card = "4111 1111 1111 1111"
    for text in (f"{card} 12/27", f"{card} 123", f"{card} 1234", f"no. 8812 {card} 123", f"2024-01-15 {card}", "4111111111111111 123"):
        assert [s for k, s in kinds(text) if k == "card"] == [card if " 1111" in text else "4111111111111111"], text
    assert kinds("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 3 9 7 5") == []


def test_phones_with_long_groups():
    for number in ("+44 7911 123456", "+49 30 12345678", "+49 170 1234567", "+49 30 1234 567890", "+33 1 23 45 67 89"):
        assert kinds(f"so {number} then") == [("phone", number)], number
    assert kinds("so +44 20 7946 0958 1234567 then") == [("phone", "+44 20 7946 0958")]
    assert kinds("so +1 415 555 0199 1234 then") == [("phone", "+1 415 555 0199")]


def test_ibans_of_the_registry():
    ibans = "UA213223130000026007233566001 RS35260005601001611379 BA391290079401028494 GE29NB0000000101904917 BR1800360305000010009795493C1 QA58DOHB00001234567890ABCDEFG KW81CBKU0000000000001234560101 PK36SCBL0000001123456702"
    for iban in ibans.split():
        spaced = " ".join(iban[k : k + 4] for k in range(0, len(iban), 4))
        assert kinds(f"to {iban}.") == [("iban", iban)] and kinds(f"to {spaced}.") == [("iban", spaced)], iban
        assert kinds(f"to {iban[:-1]}{(int(iban[-1], 36) + 1) % 10}.") == [] or not iban[-1].isdigit(), iban


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")


def test_context_changes_the_score():
    assert pii.spans("the ip 10.20.30.40")[0][3] > pii.spans("so 10.20.30.40")[0][3]


def test_overlaps_and_long():
    text = LONG + " me@example.org " + LONG + " me@example.org"
    got = pii.spans(text)
    assert [text[a:b] for _, a, b, _ in got] == ["me@example.org"] * 2
    assert all(b <= c for (_, _, b, _), (_, c, _, _) in zip(got, got[1:]))


D = frozenset("0123456789")
L = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")


def near(text, k):
    return text[k] if 0 <= k < len(text) else ""


def parts(span):
    """Digit groups of a span of digits and single separators, or None."""
    out = ["".join(g) for _, g in groupby(span, lambda c: c in D)]
    return out if out and span[0] in D and span[-1] in D else None


def card(text, a, b):
    x = text[a:b]
    if near(text, a - 1) in D | {"+"} and near(text, a - 1) or near(text, b) in D and near(text, b):
        return False
    p = parts(x)
    if p is None or any(s not in (" ", "-") for s in p[1::2]):
        return False
    digits = "".join(p[::2])
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1:
        return False
    whole = not (near(text, a - 1) in (" ", "-") and near(text, a - 2) in D and near(text, a - 2)) and not (near(text, b) in (" ", "-") and near(text, b + 1) in D and near(text, b + 1))
    doubled = [int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))]
    return (whole or all(len(g) >= 3 for g in p[::2])) and sum(doubled) % 10 == 0


def ipv4(text, a, b):
    p = text[a:b].split(".")
    before, after = near(text, a - 1), near(text, b)
    return len(p) == 4 and all(1 <= len(x) <= 3 and set(x) <= D and int(x) < 256 for x in p) and not (before and before in D | {"."}) and not (after and after in D) and not (after == "." and near(text, b + 1) in D and near(text, b + 1))


def ipv6(text, a, b):
    x = text[a:b]
    edge = [near(text, a - 1), near(text, b)]
    if any(c and (c.isalnum() or c in "_:") for c in edge) or edge[0] == "." or not any(c in D for c in x) or len([g for g in x.split(":") if g]) < 3:
        return False
    try:
        return bool(IPv6Address(x))
    except ValueError:
        return False


def ssn(text, a, b):
    p = text[a:b].split("-")
    edge = near(text, a - 1), near(text, b)
    return [len(x) for x in p] == [3, 2, 4] and set("".join(p)) <= D and not any(c and c in D | {"-"} for c in edge) and p[0] not in ("000", "666") and p[0][0] != "9" and p[1] != "00" and p[2] != "0000"


def iban(text, a, b):
    x = text[a:b]
    s = x.replace(" ", "")
    if near(text, a - 1) and near(text, a - 1) in D | L or near(text, b) and near(text, b) in D | L or not set(s) <= D | L or len(s) < 5:
        return False
    spaces = [k for k, c in enumerate(x) if c == " "]
    plain = [k - n for n, k in enumerate(spaces)]
    if len(set(plain)) < len(plain) or any(k % 4 or not k for k in plain) or x[-1] == " " or not set(s[:2]) <= L or not set(s[2:4]) <= D:
        return False
    number = 0
    for c in s[4:] + s[:4]:
        v = int(c, 36)
        number = (number * (100 if v > 9 else 10) + v) % 97
    return len(s) == pii.IBAN_LENGTH.get(s[:2].upper()) and (s == s.upper() or s == s.lower()) and number == 1


def email(text, a, b):
    x = text[a:b]
    if x.count("@") != 1:
        return False
    local, domain = x.split("@")
    ok = lambda c: c.isalnum() or c in "_.%+'-"
    labels = domain.split(".")
    return (
        1 <= len(local) <= 64 and all(map(ok, local)) and len(labels) > 1
        and all(1 <= len(g) <= 63 and set(g) <= D | L | {"-"} and g[0] != "-" and g[-1] != "-" for g in labels)
        and 2 <= len(labels[-1]) <= 24 and set(labels[-1]) <= L and not (near(text, b) and near(text, b) in D | L) and local[0] not in ".'"
    )


def local_phone(text, a, b):
    x = text[a:b]
    digits = "".join(c for c in x if c in D)
    shape = "".join("d" if c in D else "?" if c == "d" else c for c in x)
    forms = {f"{area}ddd{s}dddd" for area in ("(ddd) ", "(ddd)", "ddd.", "ddd-") for s in ".-"}
    return shape in forms and len(digits) == 10 and not any(c and c in D for c in (near(text, a - 1), near(text, b)))


def american(text, a, b):
    x = text[a:b]
    shape = "".join("d" if c in D else "?" if c == "d" else c for c in x)
    digits = "".join(c for c in x if c in D)
    seps = ("", " ", ".", "-")
    forms = {f"+{o}d{p}{area}{q}ddd{r}dddd" for o in ("", " ") for p in seps for area in ("ddd", "(ddd)") for q in seps for r in seps}
    return len(digits) == 11 and digits[0] == "1" and shape in forms and not (near(text, b) and near(text, b) in D)


def world_phone(text, a, b):
    """Code, perhaps an area in brackets, then groups."""
    x = text[a:b]
    if x[:1] != "+" or near(text, b) in D and near(text, b):
        return False
    x = x[2:] if x[1:2] == " " else x[1:]
    shape = ["".join(g) for _, g in groupby(x, lambda c: "0" if c in D else c)]
    if not shape or shape[0][0] not in D or not 8 <= sum(c in D for c in x) <= 15:
        return False
    rest = shape[1:]
    brackets = rest[1:] if rest and rest[0] in (" ", ".", "-") else rest
    area = len(brackets) >= 3 and brackets[0] == "(" and brackets[2] == ")" and brackets[1][0] in D and len(brackets[1]) <= 4
    if area:
        rest = brackets[3:]
    groups = []
    while rest:
        if rest[0] in (" ", ".", "-"):
            rest = rest[1:]
        elif groups or not area:
            return False
        if not rest or rest[0][0] not in D:
            return False
        groups.append(rest[0])
        rest = rest[1:]
    return len(groups) + area < 8 and all((2 if k else 1) <= len(g) <= 8 for k, g in enumerate(groups))


def brute(text):
    """Every start and end of the text, looked at as a span of each kind."""
    found = set()

    def add(kind, a, b, score):
        around = text[max(0, a - pii.CONTEXT) : a] + " " + text[b : b + pii.CONTEXT]
        good, bad = pii.WORDS[kind]
        found.add((min(1.0, round(score + (0.2 if good.search(around) else 0) - (0.3 if bad and bad.search(around) else 0), 2)), a, b, kind))

    every = [(a, b) for a in range(len(text)) for b in range(a + 7, min(len(text), a + 60) + 1)]
    last = {}
    for a, b in every:
        if card(text, a, b):
            add("card", a, b, 0.8 if pii.issuer("".join(c for c in text[a:b] if c in D)) else 0.45)
        for kind, test, score in (("ipv4", ipv4, 0.7), ("ipv6", ipv6, 0.7), ("ssn", ssn, 0.65), ("phone", local_phone, 0.65)):
            if test(text, a, b):
                add(kind, a, b, score)
        if iban(text, a, b):
            add("iban", a, b, 0.9 if text[a].isupper() else 0.65)
        if world_phone(text, a, b) and not last.get(a, (0, False))[1]:
            last[a] = (b, False)
        if american(text, a, b):
            last[a] = (b, True)
    for a, (b, _) in last.items():
        add("phone", a, b, 0.75)
    for at in range(len(text)):
        spans = [(a, b) for a in range(max(0, at - 64), at) for b in range(at + 2, len(text) + 1) if text[at] == "@" and email(text, a, b)]
        # the longest domain, and of the run of 64 before the sign what no dot or quote begins
        if spans:
            add("email", *max(((a, b) for a, b in spans), key=lambda s: (s[1], -s[0])), 0.9)
    taken = []
    for score, a, b, k in sorted((x for x in found if x[0] >= pii.THRESHOLD), key=lambda x: (-x[0], x[1] - x[2], x[1], x[3])):
        if all(b <= c or d <= a for _, c, d, _ in taken):
            taken.append((k, a, b, score))
    return sorted(taken, key=lambda x: x[1])


PIECES = (
    "4111 1111 1111 1111", "4111111111111111", "378282246310005", "12/27", "123", "+44 20 7946 0958", "+1 (415) 555-0199", "+49", "(30)", "12345678", "2024", "10.20.30.40", "1.2.3.4.5", "fe80::1:2ab", "2001:db8::8a2e:370:7334",
    "::ffff:10.0.0.1", "12:30:45", "123-45-6789", "000-12-3456", "(555) 123-4567", "555.123.4567", "DE89 3704 0044 0532 0130 00", "de89370400440532013000", "GB82WEST12345698765432", "ann.lee@mail.example.com", "@", "'x@y.org", "phone", "card", "version", "ip", "word", "+", "é",
)


def test_against_brute_force():
    rng = random.Random(3)
    kinds_found = set()
    for n in range(120):
        text = "".join(rng.choice(PIECES) + rng.choice((" ", " ", ", ", "-", ".", "", "\n")) for _ in range(rng.randint(1, 5)))
        if n % 2:  # and broken ones
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(text))
                text = text[:k] + rng.choice("0123456789 .-:+@aF") + text[k + rng.randint(0, 1) :]
        want = brute(text)
        kinds_found |= {k for k, *_ in want}
        assert pii.spans(text) == want, text
    assert kinds_found == set(pii.NEAR)


def test_the_query_against_brute_force(make):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(PIECES) for _ in range(4)) for _ in range(60)] + [None, "", "nothing"]
    got = sorted(tuple(r) for r in pii.scan(make(texts)).collect())
    assert got == sorted((i, *s) for i, t in enumerate(texts) if t for s in brute(t))


def test_lower_case_ibans_and_ipv6():
    assert kinds("to de89 3704 0044 0532 0130 00 with it") == [("iban", "de89 3704 0044 0532 0130 00")]
    assert kinds("De89 3704 0044 0532 0130 00") == []
    assert kinds("host 2001:db8::8a2e:370:7334, at 12:30:45; std::vector a::b dead::beef") == [("ipv6", "2001:db8::8a2e:370:7334")]
    assert kinds("AB12 CDEF GHIJ DE89 3704 0044 0532 0130 00") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("call +44 20 7946 0958 2024") == [("phone", "+44 20 7946 0958")]


def test_many_spans_in_one_text():
    text = " ".join(f"user{i}@example.org 4111 1111 1111 1111 12/26" for i in range(50_000))
    start = time.process_time()
    assert len(pii.spans(text)) == 100_000
    assert time.process_time() - start < 30  # it was quadratic; seconds, even on a busy machine


def test_columns_by_any_case(make):
    df = make(["mail a@b.org"]).withColumnRenamed("text", "Text").withColumnRenamed("n_chars", "N_Chars")
    assert pii.redact(df).select("Text", "N_Chars").first() == ("mail [EMAIL]", 12)


def test_tables(spark, awkward, none, make):
    assert pii.scan(awkward).count() == 0
    assert pii.scan(none).count() == 0 and pii.redact(none).count() == 0
    same = pii.redact(awkward)
    assert sorted(map(str, same.collect())) == sorted(map(str, awkward.collect()))
    df = make(["mail a@b.org", None, "", "mail a@b.org", "clean"])
    assert [r["doc_id"] for r in pii.scan(df).orderBy("doc_id").collect()] == [0, 3]
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.redact(df).collect()}
    assert out == {0: ("mail [EMAIL]", 12), 1: (None, None), 2: ("", 0), 3: ("mail [EMAIL]", 12), 4: ("clean", 5)}
    assert len(AWKWARD) == awkward.count()
