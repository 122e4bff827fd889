import hashlib
import random
import unicodedata

import public_tokenizers
import pytest
from hypothesis import given as any_of
from hypothesis import settings
from hypothesis import strategies as st
from tokenizers import Tokenizer as Library

from shelfmark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Library.from_file(PATH)
OURS = bpe.Tokenizer(bpe.read_tokenizer(PATH))
PIECES = ["the", "ing", " ", "\n", "'re", "'LL", "İ", "Σ", "ας", "é", "é", "漢字", "😀", "👍🏽", "\x1c", "\x85", "　", "½", "٣", "<|endoftext|>", "<|", "photography", "A", "z", "12", "--", "\x00", "ก็"]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@any_of(st.one_of(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), st.lists(st.sampled_from(PIECES), max_size=40).map("".join)))
def test_ids_and_decoded_text_are_the_library_s(text):
    ids = library(text)
    assert OURS.encode(text) == ids
    machine = OURS.decoder()
    assert machine.push(ids) + machine.finish() == LIBRARY.decode(ids, skip_special_tokens=False)


CONTEXTS = ["a{0}\u0323\u0301b {0}", "-{0}1{0}{0} a\u0301{0}\u0323"]


def test_every_code_point_is_read_as_by_the_library():
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for context in CONTEXTS:
        for at in range(0, len(points), 50_000):
            texts = [context.format(c) for c in points[at : at + 50_000]]
            for text, known in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False)):
                assert OURS.encode(text) == known.ids, ascii(text)


def test_compositions_are_the_library_s():
    for c in (chr(c) for c in range(0x110000) if unicodedata.decomposition(chr(c))):
        for text in (c, unicodedata.normalize("NFD", c), unicodedata.normalize("NFD", c) + "\u0323"):
            assert OURS.encode(text) == library(text), ascii(text)


def test_a_word_streams_in_any_cut_with_bounded_memory():
    r = random.Random(4)
    for k in range(20):
        word = "".join(r.choice(["a", "ha", "photo", "graph", "international", "womens", "day", "é", "lol", "e"]) for _ in range(900))
        data, whole = word.encode(), library(word)
        stream, got = bpe.WordTransducer(OURS, room=OURS.lookahead + 50), []
        at = 0
        while at < len(data):
            n = r.randrange(1, 400)
            got += stream.push(data[at : at + n])
            at += n
            assert len(stream.held) <= 2 * stream.room
        assert [*got, *stream.finish()] == whole


def test_lookahead_follows_chains_of_merges():
    # ab, then (bc needs b free), cd: what follows "a" can change two tokens back
    assert bpe.sufficient_lookahead([("a", "b")]) == 1
    assert bpe.sufficient_lookahead([("b", "c"), ("a", "b")]) == 2
    assert bpe.sufficient_lookahead([("a", "b"), ("b", "c")]) == 1


def test_the_text_machine_waits_for_split_characters():
    machine = bpe.TextMachine({0: b"\xc3", 1: b"\xa9", 2: b"x", 3: b"\xff"}, b"")
    assert machine.push([2, 0]) == "x"
    assert machine.push([1]) == "é"
    assert machine.push([3, 0]) == "�"
    assert machine.finish() == "�"


def test_readable_decoding_is_a_round_trip_for_plain_text():
    text = "the quick brown fox, 12 émigrés and 漢字 walk"
    machine = OURS.text_decoder()
    words = machine.push(OURS.encode(text)) + machine.finish()
    assert words.replace(" ", "") == text.replace(" ", "")


def test_digests_over_documents(spark, documents):
    long = "ha" * 60_000 + " " + "word " * 30_000
    texts = {1: "Hello, World's end", 2: "", 3: None, 4: long, 5: "<|endoftext|>x", 6: "Hello, World's end"}
    docs = documents(*texts.items(), (1, "Hello, World's end"))
    got = bpe.digests(docs, PATH).collect()
    assert len(got) == 7
    for row in got:
        ids = library(texts[row.doc_id] or "")
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs.limit(0), PATH).count() == 0


def test_encode_and_decode_over_documents(documents):
    docs = documents((1, "it's"), (2, None), (None, "x y"))
    encoded = bpe.encode(docs, PATH)
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == {1: library("it's"), 2: [], None: library("x y")}
    assert {r.doc_id: r.text for r in bpe.decode(encoded, PATH).collect()} == {1: "it</w> 's</w>", 2: "", None: "x</w> y</w>"}
    assert {r.doc_id: r.text for r in bpe.decode(encoded, PATH, readable=True).collect()}[None] == "x y "


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.Tokenizer('{"model": {"type": "Unigram"}}')
