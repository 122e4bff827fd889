"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass: at-signs, plus signs, digits, schemes and
identifier cues.  A deterministic parser for each kind expands an anchor to both sides and
validates what it finds.  ``email``, ``ip``, ``card`` and ``phone`` are the leftmost
non-overlapping matches of the patterns named below, checked, without retries; ``url``,
``iban``, ``ssn`` and ``account`` are added.

Defined results: NULL and empty text has no spans; repeated rows give the same spans.
Positions are code points, end exclusive.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import per_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "account")
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

# Cues in front of identifiers.
CUES = {
    "iban": ("iban",),
    "ssn": ("ssn", "social security"),
    "account": ("account", "acct", "konto", "compte", "cuenta"),
}
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_SCHEME = frozenset(string.ascii_letters + string.digits + "+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)  # keeps positions
_REST_OF_URL = re.compile(r"[^\s<>\"'`{}|\\^]+")
_IBAN = re.compile(r"(?:[^A-Za-z0-9]{1,12}[A-Za-z]{1,8}){0,3}?[^A-Za-z0-9]{0,12}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_SSN = re.compile(r"[^0-9]{0,16}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])")
_ACCOUNT = re.compile(r"[^0-9\n]{0,24}([0-9]{6,17})(?![0-9])")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in string.digits:
        found.add_word(d, "digit")
    found.add_word("@", "email")
    found.add_word("+", "phone")
    found.add_word("://", "url")
    for kind, cues in CUES.items():
        for cue in cues:
            found.add_word(cue, kind)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _is_byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and int(part) <= 255)


def _is_iban(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans, by start and then by kind as listed."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    upto = dict.fromkeys((*KINDS, "digits"), 0)
    for last, kind in _anchors().iter(text.translate(_LOWER)):
        if kind == "digit":
            if last >= upto["digits"]:
                _numbers(text, last, upto, found)
        elif kind == "email":
            start = last
            while start > upto["email"] and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, last + 1)
            if domain and start < last:
                found.append(("email", start, domain.end()))
                upto["email"] = domain.end()
        elif kind == "phone":
            m = _PHONE.match(text, last)
            if m and 9 <= len(_DIGIT.findall(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
        elif last >= upto[kind]:
            _more(text, last, kind, upto, found)
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def _numbers(text: str, at: int, upto: dict[str, int], found: list[tuple[str, int, int]]) -> None:
    """Addresses and cards that begin at a digit which neither has passed."""
    if at >= upto["ip"]:
        m = _DOTTED.match(text, at)
        parts, start = m[0].split("."), at
        for k in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[k : k + 4])) + 3
            if all(map(_is_byte, parts[k : k + 4])):
                found.append(("ip", start, end))
            start = end + 1
        upto["ip"] = m.end()
    if at >= upto["card"]:
        m = _CARD.match(text, at)
        if m:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        upto["card"] = m.end() if m else at + 1
    upto["digits"] = min(upto["ip"], upto["card"])


def _more(text: str, last: int, kind: str, upto: dict[str, int], found: list[tuple[str, int, int]]) -> None:
    """Kinds beyond the base ones, from a scheme or a cue."""
    if kind == "url":
        start = last - 2
        while start > upto["url"] and text[start - 1] in _SCHEME:
            start -= 1
        while start < last - 2 and not ("a" <= text[start].lower() <= "z"):
            start += 1
        rest = _REST_OF_URL.match(text, last + 1)
        end = last + 1 + len(rest[0].rstrip(".,;:!?)]*")) if rest else last + 1
        if start < last - 2 and end > last + 1:
            found.append(("url", start, end))
            upto["url"] = end
        return
    m = {"iban": _IBAN, "ssn": _SSN, "account": _ACCOUNT}[kind].match(text, last + 1)
    if m and (kind != "iban" or _is_iban(m[1])):
        found.append((kind, m.start(1), m.end(1)))
        upto[kind] = m.end(1)


def spans(text: str = "text") -> Column:
    """Array of kind, start and end of a text column."""
    def each(t: str | None) -> list[dict]:
        return [{"kind": k, "start": a, "end": b} for k, a, b in find(t)]

    return per_text(lambda: each, SPANS, F.col(text))


def _joined(of: Column) -> Column:
    return F.concat_ws(",", F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(documents: DataFrame) -> DataFrame:
    """doc_id and the spans of every document."""
    return documents.select("doc_id", "text").select("doc_id", spans().alias("spans"))


def digests(documents: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, and all spans as text."""
    of = F.col("spans")
    counts = [F.size(F.expr(f"filter(spans, s -> s.kind = '{kind}')")).cast("long").alias(f"n_{kind}") for kind in BASE]
    base = F.sha2(_joined(F.filter(of, lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256")
    return personal_data(documents).select("doc_id", *counts, base, _joined(of).alias("spans"))
