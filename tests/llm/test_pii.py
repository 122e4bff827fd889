import hashlib
import re

from hypothesis import given as any_of
from hypothesis import settings
from hypothesis import strategies as st

from shelfmark.llm import pii


def brute(text):
    """The base kinds by their patterns."""
    digits = lambda s: "".join(re.findall("[0-9]", s))
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    found = [(kind, m.start(), m.end()) for kind, pattern, ok in rules for m in re.finditer(pattern, text) if ok(m[0])]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


PIECES = [*"0123456789..@@++-- ()%_ab\n", "é", "😀", "://", "4111111111111111", "255", "a@b.c", "+49 30 1234567", "iban ", "account "]


@settings(max_examples=500, deadline=None)
@any_of(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.find(text) if s[0] in pii.BASE] == brute(text)


def test_given_documents(given):
    for (text,) in given("sf0.01", "documents", "text"):
        assert [s for s in pii.find(text) if s[0] in pii.BASE] == brute(text)


def test_added_kinds():
    text = "See https://a.example.com/x?y=1, IBAN: DE89 3704 0044 0532 0130 00; SSN 123-45-6789, account no. 12345678."
    assert [(k, text[a:b]) for k, a, b in pii.find(text)] == [
        ("url", "https://a.example.com/x?y=1"),
        ("iban", "DE89 3704 0044 0532 0130 00"),
        ("ssn", "123-45-6789"),
        ("account", "12345678"),
    ]
    assert pii.find("IBAN: DE88 3704 0044 0532 0130 00") == []


def test_cues_in_any_case_and_with_words_before_the_value():
    for text, want in (
        ("Social Security number: 123-45-6789", ("ssn", "123-45-6789")),
        ("sOCIAL sECURITY 123-45-6789", ("ssn", "123-45-6789")),
        ("IBAN is DE89370400440532013000", ("iban", "DE89370400440532013000")),
        ("my iBan number is: DE89 3704 0044 0532 0130 00.", ("iban", "DE89 3704 0044 0532 0130 00")),
        ("İİ AcCount 12345678", ("account", "12345678")),
    ):
        assert [(k, text[a:b]) for k, a, b in pii.find(text) if k not in pii.BASE] == [want]


def test_over_documents(documents):
    long = "x" * 300_000 + " me@example.org " + "1" * 100_000
    docs = documents((1, "a@b.co 1.2.3.4"), (1, "a@b.co 1.2.3.4"), (2, None), (3, ""), (4, long), (None, "+1 212 555 0100"))
    rows = pii.digests(docs).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 6
    assert (by[1].n_email, by[1].n_ip, by[1].spans) == (1, 1, "email:0:6,ip:7:14")
    assert by[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert by[2].spans == by[3].spans == "" and by[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[4].spans == "email:300001:300015"
    assert by[None].n_phone == 1
    assert pii.digests(docs.limit(0)).count() == 0
