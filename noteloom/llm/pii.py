"""Personal data and credentials by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, schemes, digit pairs, dotted
digits, colons, plus signs and the cues of identifiers and credentials. At each
anchor a deterministic local parser expands left and right to the boundaries of a
candidate and validates it. No parser looks further than its kind can be long; URLs and secrets
may be of any length and each of their runs is parsed once.

Kinds: EMAIL, URL (with user information), IP (v4, v6), PHONE (international, or
ten digits written in groups), CARD (13 to 19 digits that pass the Luhn test), SSN,
IBAN (mod 97), KEY (well-known key prefixes) and SECRET (the value after a cue
such as ``token =``). Overlaps go to the earlier kind in PRIORITY, then to the longer,
then to the earlier span.

Cases: a null or empty text has no findings; every row is searched, whatever its
doc_id, and a finding of a row without doc_id carries null; rows that repeat each
report their own findings, equal ones once. Long texts are searched whole. An
empty table gives an empty result. Other columns, whatever their names, are kept by redact() and not read otherwise (n_chars follows the text).
"""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared as S
from ._text import tidy

PRIORITY = ("SECRET", "KEY", "URL", "EMAIL", "IBAN", "IP", "CARD", "PHONE", "SSN")
CUES = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "access key", "auth", "bearer")
PREFIXES = {"AKIA": (20, 20), "ASIA": (20, 20), "ghp_": (40, 40), "gho_": (40, 40), "xoxb-": (20, 80), "xoxp-": (20, 80), "sk_live_": (24, 64), "AIza": (39, 39)}
_LOCAL = frozenset("._%+-'")
_DIGITS = frozenset("0123456789")
_HEX = frozenset("0123456789abcdefABCDEF")
_SECRET_END = re.compile(r"[^A-Za-z0-9_\-./+=~]")
_URL_END = re.compile(r"[\s<>\"']")
_DIGIT = re.compile(r"[0-9]")
_LABEL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def _run(text: str, at: int, ok, limit: int) -> int:
    """The end of the run of accepted characters from ``at``; limit + 1 of them at most."""
    end, stop = at, min(len(text), at + limit + 1)
    while end < stop and ok(text[end]):
        end += 1
    return end


def _back(text: str, at: int, ok, limit: int) -> int:
    """The start of the run of accepted characters before ``at``."""
    start, stop = at, max(0, at - limit - 1)
    while start > stop and ok(text[start - 1]):
        start -= 1
    return start


def email(text: str, at: int):
    """A mailbox around the at-sign at ``at``."""
    a = _back(text, at, lambda c: c.isalnum() or c in _LOCAL, 64)
    while a < at and not text[a].isalnum():
        a += 1
    local = text[a:at]
    if not 1 <= len(local) <= 64 or ".." in local or local[-1] in ".'":
        return None
    b = _run(text, at + 1, lambda c: c in _LABEL or c == ".", 253)
    labels = text[at + 1 : b].split(".")
    while labels and not (labels[-1].isalpha() and len(labels[-1]) >= 2):  # trailing full stops and the like
        labels.pop()
    if len(labels) < 2 or any(not x or len(x) > 63 or x[0] == "-" or x[-1] == "-" for x in labels):
        return None
    return a, at + 1 + len(".".join(labels)), "EMAIL"


def url(text: str, at: int, b: int):
    """scheme://user:password@host around the scheme's colon at ``at``; its run ends at ``b``."""
    a = _back(text, at, lambda c: c.isascii() and (c.isalnum() or c in "+-."), 20)
    while a < at and not text[a].isalpha():
        a += 1
    if at - a < 2:
        return None
    slash = text.find("/", at + 3, b)
    host = text[at + 3 : b if slash < 0 else slash]
    user, sign, rest = host.rpartition("@")
    if not sign or not user or not rest:
        return None
    while text[b - 1] in ".,;:!?)]":
        b -= 1
    return (a, b, "URL") if b > at + 3 else None


def ip(text: str, at: int):
    """An IPv4 address over the digit and dot at ``at``."""
    a, b = _back(text, at, lambda c: c in _DIGITS or c == ".", 16), _run(text, at, lambda c: c in _DIGITS or c == ".", 16)
    if b < len(text) and _word(text[b]) or a and _word(text[a - 1]):
        return None
    body = text[a:b].rstrip(".")
    octets = body.split(".")
    if len(octets) == 4 and all(x and len(x) <= 3 and int(x) < 256 and (x == "0" or x[0] != "0") for x in octets):
        return a, a + len(body), "IP"
    return None


def ip6(text: str, at: int):
    """An IPv6 address over the colon at ``at``."""
    a, b = _back(text, at, lambda c: c in _HEX or c == ":", 40), _run(text, at, lambda c: c in _HEX or c == ":", 40)
    body = text[a:b]
    if body.count(":") < 2 or not any(c in _HEX for c in body) or b < len(text) and _word(text[b]) or a and _word(text[a - 1]):
        return None
    if body.endswith(":") and not body.endswith("::"):
        body = body[:-1]
    if body.count(":") < (2 if "::" in body else 7) or len(body) < 6:
        return None
    try:
        ipaddress.IPv6Address(body)
    except ValueError:
        return None
    return a, a + len(body), "IP"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c)
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def _grouped(text: str, at: int, signs: str, most: int) -> tuple[int, int]:
    """The span around ``at`` of digits with single separators between them."""
    a = b = at
    while a and at - a <= most and (text[a - 1] in _DIGITS or text[a - 1] in signs and a > 1 and text[a - 2] in _DIGITS and text[a] in _DIGITS):
        a -= 1
    while b < len(text) and b - at <= most and (text[b] in _DIGITS or text[b] in signs and b + 1 < len(text) and text[b + 1] in _DIGITS and text[b - 1] in _DIGITS):
        b += 1
    return a, b


def card(text: str, at: int):
    a, b = _grouped(text, at, " -", 40)
    digits = [c for c in text[a:b] if c in _DIGITS]
    if not 13 <= len(digits) <= 19:  # a number beside other digits: the run without separators
        a, b = _grouped(text, at, "", 24)
        digits = [*text[a:b]]
    whole = "".join(digits)
    if not 13 <= len(whole) <= 19 or len(set(whole)) == 1 or not luhn(whole) or _touched(text, a, b):
        return None
    parts = text[a:b].replace("-", " ").split(" ")
    if len(parts) > 1 and any(not 2 <= len(p) <= 7 for p in parts):
        return None
    return a, b, "CARD"


def _touched(text: str, a: int, b: int) -> bool:
    return bool(a and (_word(text[a - 1]) or text[a - 1] in ".+")) or b < len(text) and (_word(text[b]) or text[b] == "." and b + 1 < len(text) and text[b + 1] in _DIGITS)


def phone(text: str, at: int):
    """+CC and 7 to 14 more digits from the plus sign at ``at``."""
    if at and _word(text[at - 1]):
        return None
    return _phone(text, at, at + 1, 8, 15)


def _phone(text: str, start: int, at: int, least: int, most: int):
    digits, b, opened, end, gap = 0, at, False, at, 0
    while b < len(text) and digits <= most:
        c = text[b]
        if c in _DIGITS:
            digits, gap, end = digits + 1, 0, b + 1
        elif c == "(" and not opened and digits <= 3:
            opened, gap = True, gap + 1
        elif c == ")" and opened and gap == 0:
            gap = 0
        elif c in " -./" and gap < 2:
            gap += 1
        else:
            break
        b += 1
    if not least <= digits <= most or end < len(text) and _word(text[end]):
        return None
    return start, end, "PHONE"


def local_phone(text: str, at: int):
    """(ddd) ddd-dddd or ddd-ddd-dddd around the digits at ``at``."""
    a = _back(text, at, lambda c: c in _DIGITS, 3)
    if a and text[a - 1] == "(":
        a -= 1
    if a and (_word(text[a - 1]) or text[a - 1] in "+-.)" or text[a - 1] == " " and a > 1 and text[a - 2] in _DIGITS):
        return None
    shape, b = "", a
    while b < len(text) and b - a < 15 and (text[b] in _DIGITS or text[b] in "() -."):
        shape += "9" if text[b] in _DIGITS else text[b]
        b += 1
    for form in ("(999) 999-9999", "(999)999-9999", "999-999-9999", "999.999.9999"):
        if shape.startswith(form):
            end = a + len(form)
            if end < len(text) and (_word(text[end]) or text[end] == "-" and text[end + 1 : end + 2].isdigit()):
                return None
            return a, end, "PHONE"
    return None


def ssn(text: str, at: int):
    a = _back(text, at, lambda c: c in _DIGITS, 9)
    body = text[a : a + 11]
    if len(body) < 11 or body[3] != "-" or body[6] != "-" or not (body[:3] + body[4:6] + body[7:]).isdigit() or not body.isascii():
        return None
    if body[:3] in ("000", "666") or body[0] == "9" or body[4:6] == "00" or body[7:] == "0000":
        return None
    before, after = text[a - 1 : a], text[a + 11 : a + 12]
    if before and (_word(before) or before == "-") or after and (_word(after) or after == "-"):
        return None
    return a, a + 11, "SSN"


def iban(text: str, at: int):
    """Two capitals, two digits at ``at`` and 11 to 30 more characters, spaced by four or not."""
    a = at - 2
    if a < 0 or not text[a:at].isascii() or not text[a:at].isalpha() or not text[a:at].isupper() or a and _word(text[a - 1]):
        return None
    body, b = "", a
    while b < len(text) and len(body) < 35 and text[b].isascii():
        c = text[b]
        if c.isdigit() or c.isupper():
            body += c
        elif not (c == " " and len(body) % 4 == 0):
            break
        b += 1
    best, size, b = None, 0, a
    value = ""
    while b < len(text) and size < len(body):
        c = text[b]
        b += 1
        if c == " ":
            continue
        size += 1
        value += c
        ends = b == len(text) or not _word(text[b])
        if 15 <= size <= 34 and ends and int("".join(str(int(x, 36)) for x in value[4:] + value[:4])) % 97 == 1:
            best = b
    return (a, best, "IBAN") if best else None


def key(text: str, at: int, prefix: str):
    """A key that begins with a well-known prefix at ``at``."""
    low, high = PREFIXES[prefix]
    if at and _word(text[at - 1]):
        return None
    b = _run(text, at, lambda c: c.isascii() and (c.isalnum() or c in "_-"), high)
    if not low <= b - at <= high or prefix in ("AKIA", "ASIA") and text[at:b] != text[at:b].upper():
        return None
    return at, b, "KEY"


def secret(text: str, b: int, end: int):
    """The value after a cue, whose run is from ``b`` to ``end``: 8 or more characters with a digit."""
    while end > b and text[end - 1] in ".=" and not (text[end - 1] == "=" and end - b > 16):
        end -= 1
    if end - b < 8 or not _DIGIT.search(text, b, end):
        return None
    return b, end, "SECRET"


def _value(text: str, at: int, bearer: bool):
    """Where the value after a cue that ends at ``at`` begins: behind a separator (after "bearer" a space will do) and an optional quote."""
    b = _run(text, at, lambda c: c == " ", 3)
    space = bearer and b > at and not (at > 6 and _word(text[at - 7]))
    if b < len(text) and text[b] in "\"'" and not space:
        b += 1
    if b < len(text) and text[b] in ":=":
        b = _run(text, b + 1, lambda c: c in " =>", 4)
    elif not space:
        return None
    if b < len(text) and text[b] in "\"'`":
        b += 1
    return b


def _end(stop: re.Pattern, text: str, at: int) -> int:
    """Where the run of characters from ``at`` that aren't in ``stop`` ends."""
    found = stop.search(text, at)
    return found.start() if found else len(text)


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found: dict[str, list] = {}

    def add(word: str, kind: str, extra=None) -> None:
        found.setdefault(word, []).append((kind, extra))

    add("@", "email")
    add("://", "url")
    add(":", "ip6")
    add("+", "phone")
    for c in "0123456789":
        add(f"{c}.", "ip")
        add(f"({c}", "paren")
        for d in "0123456789":
            add(c + d, "digits")
    for p in PREFIXES:
        add(p, "key", p)
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            add(form, "cue", cue == "bearer")
    a = ahocorasick.Automaton()
    for word, acts in found.items():
        a.add_word(word, (len(word), tuple(acts)))
    a.make_automaton()
    return a


def candidates(text: str) -> list[tuple[int, int, str]]:
    """All valid spans, overlaps included."""
    out = set()
    digits_end = ip_end = colon_end = url_end = secret_end = 0  # runs that have been parsed
    for last, (size, acts) in automaton().iter(text):
        at = last - size + 1
        for kind, extra in acts:
            if kind == "email":
                out.add(email(text, at))
            elif kind == "url":
                if at + 3 > url_end:
                    url_end = _end(_URL_END, text, at + 3)
                out.add(url(text, at, url_end))
            elif kind == "ip6":
                if at >= colon_end:
                    out.add(ip6(text, at))
                    colon_end = _run(text, at, lambda c: c in _HEX or c == ":", 1 << 30)
            elif kind == "phone":
                out.add(phone(text, at))
            elif kind == "ip":
                if at >= ip_end:
                    out.add(ip(text, at))
                    ip_end = _run(text, at, lambda c: c in _DIGITS or c == ".", 1 << 30)
            elif kind == "paren":
                out.add(local_phone(text, at + 1))
            elif kind == "digits":
                if at >= digits_end:  # once for each run of digits
                    digits_end = _run(text, at, lambda c: c in _DIGITS, 1 << 30)
                    out.update((card(text, at), ssn(text, at), local_phone(text, at), iban(text, at)))
            elif kind == "key":
                out.add(key(text, at, extra))
            else:
                b = _value(text, last + 1, extra)
                if b is not None and b >= secret_end:  # a value that begins within another is part of it
                    secret_end = _end(_SECRET_END, text, b)
                    out.add(secret(text, b, secret_end))
    out.discard(None)
    return list(out)


def settle(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans without overlap, by kind, then length, then place."""
    if len(spans) < 2:
        return spans
    import bisect

    taken: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda s: (PRIORITY.index(s[2]), s[0] - s[1], s[0])):
        i = bisect.bisect_left(taken, (s[0],))
        if (i == 0 or taken[i - 1][1] <= s[0]) and (i == len(taken) or taken[i][0] >= s[1]):
            taken.insert(i, s)
    return taken


def find(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the personal data in a text, in order; end is exclusive, both in characters."""
    return settle(candidates(text)) if text else []


def redacted(text: str | None) -> str | None:
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in spans:
        out += text[at:a], f"[{kind}]"
        at = b
    return "".join(out) + text[at:]


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, kind) of every finding."""

    def run(batches):
        for batch in batches:
            out = [(doc, *f) for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")) for f in dict.fromkeys(find(text.as_py()))]
            if out:
                ids, a, b, kind = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(kind)], ["doc_id", "start", "end", "kind"])

    schema = "doc_id long, start int, end int, kind string"
    return S.texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema).distinct()


def redact(docs: DataFrame) -> DataFrame:
    """docs with ``[KIND]`` in place of every finding; all columns and rows stay, and n_chars, if there, follows the text."""
    schema = docs.schema
    names = docs.columns

    def run(batches):
        for batch in batches:
            i = names.index("text")
            texts = pa.array([redacted(t.as_py()) for t in batch.column(i)], pa.string())
            columns = [*batch.columns]
            columns[i] = texts.cast(columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            tidy()

    out = S.texts(docs).mapInArrow(run, schema)
    if "n_chars" in names:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull() & F.col("n_chars").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out
