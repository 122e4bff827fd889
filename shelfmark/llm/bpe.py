"""BPE encoding and decoding by streaming transducers.

The encoder reads the symbols of a word one stretch after another.  Whatever follows, the
tokens that end more than ``lookahead`` symbols before the last symbol read can no longer
change, so they leave at once and the memory stays constant, also for a word without end.
The lookahead is computed from the merge list.  The decoder turns token bytes into text with
an incremental state machine, which holds back at most an unfinished character.

The tokenizer is read from a file of the ``tokenizers`` library: byte-level BPE with an
optional end-of-word suffix, as named by its path; nothing is trained.

Defined results: NULL and empty text give no tokens and decode to empty text; repeated rows
are encoded alike; the strings of special tokens in a text become those tokens, as the
library does it.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import per_text

DIGEST = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
# Chunks and words that a process remembers: the first ones, among which are the frequent ones.
REMEMBERED_CHUNKS, REMEMBERED_WORDS = 150_000, 300_000
LONGEST_REMEMBERED = 64
_NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in symbols:
            symbols[b] = chr(spare)
            spare += 1
    return [symbols[b] for b in range(256)]


def sufficient_lookahead(merges: Iterable[tuple[str, str]]) -> int:
    """How many symbols at the end of what was read can still be tokenised otherwise.

    Two continuations first differ behind the last symbol read.  A merge (u, v) moves the
    difference left by one token u, if v begins where the difference lies.  The next merge
    (u', v') moves it again only if it ranks behind the first and v' begins with u.  So the
    longest chain of such merges, measured by the lengths of their u, bounds the reach.
    """
    reach: dict[str, int] = {}
    most = 0
    for u, v in merges:
        chained = len(u) + max((reach.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
        reach[u] = max(reach.get(u, 0), chained)
        most = max(most, chained)
    return most


class Tokenizer:
    """Encoder and decoder tables from the text of a tokenizer file."""

    def __init__(self, spec_text: str):
        spec = json.loads(spec_text)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE is known")
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + self.suffix] for s in symbols]
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for k, (u, v) in enumerate(merges):
            self.rank.setdefault(vocab[u] << 20 | vocab[v], k)
            self.merged.append(vocab[u + v])
        self.lookahead = sufficient_lookahead(merges)
        self.pieces: dict[int, str] = {i: s for s, i in vocab.items()}
        self.width = {i: len(s.removesuffix(self.suffix) if self.suffix else s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces.update({i: s for s, i in self.special.items()})
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.numerals = [str(i) for i in range(max(self.pieces) + 1)]
        self.split, self.steps = _reader(spec)
        self.words: dict[str, tuple[int, ...]] = {}
        self.chunks = _Chunks(self)

    # -- encoding

    def merge(self, ids: list[int]) -> list[int]:
        """The tokens of one run of symbols: lowest rank first, the leftmost of equals."""
        return self._merge_short(ids) if len(ids) <= 40 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        rank, merged = self.rank.get, self.merged
        ranks = [rank(a << 20 | b, _NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _NEVER:
                break
            at = ranks.index(least)
            new = ids[at] = merged[least]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(ids[at - 1] << 20 | new, _NEVER)
            if at < len(ranks):
                ranks[at] = rank(new << 20 | ids[at + 1], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank, n = self.rank.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k) for k in range(n - 1) if (r := rank(ids[k] << 20 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n or rank(ids[k] << 20 | ids[j]) != r:
                continue
            ids[k], ids[j] = self.merged[r], -1
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
                if (x := rank(ids[k] << 20 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (x, k))
            if before[k] >= 0 and (x := rank(ids[before[k]] << 20 | ids[k])) is not None:
                heapq.heappush(heap, (x, before[k]))
        return [i for i in ids if i >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        """The tokens of a word, remembered if it is short."""
        known = self.words.get(word)
        if known is None:
            data = word.encode("utf-8", "surrogatepass")
            if len(data) > LONGEST_REMEMBERED:
                stream = WordTransducer(self)
                return tuple(chain(stream.push(data), stream.finish()))
            known = tuple(self.merge([self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]))
            if len(self.words) < REMEMBERED_WORDS:
                self.words[word] = known
        return known

    def stretch(self, text: str) -> tuple[int, ...]:
        """The tokens of text without special tokens."""
        for step in self.steps:
            text = step(text)
        words = self.split(text)
        return self.word(words[0]) if len(words) == 1 else tuple(chain.from_iterable(map(self.word, words)))

    def parts(self, text: str) -> Iterator[tuple[int, ...]]:
        """The tokens of a text, one chunk between white space after another."""
        pieces = self.special_pattern.split(text) if self.special_pattern and any(s in text for s in self.special) else [text]
        for k, piece in enumerate(pieces):
            if k % 2:
                yield (self.special[piece],)
            elif _SEPARATORS.isdisjoint(piece):
                yield from map(self.chunks.__getitem__, piece.split())
            else:  # str.split() would part these, which the library takes for signs
                yield self.stretch(piece)

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.parts(text))) if text else []

    # -- decoding

    def decoder(self, separator: str = " ") -> TextMachine:
        """Decodes as the library does without a decoder of its own: token strings, separated."""
        return TextMachine({i: s.encode() for i, s in self.pieces.items()}, separator.encode())

    def text_decoder(self) -> TextMachine:
        """Decodes to what was written: bytes for symbols, a space for the end of a word."""
        back = {s: bytes([b]) for b, s in enumerate(byte_symbols())}
        special = set(self.special.values())

        def plain(i: int, s: str) -> bytes:
            if i in special:
                return s.encode()
            end = bool(self.suffix) and s.endswith(self.suffix)
            return b"".join(back[c] for c in (s.removesuffix(self.suffix) if end else s)) + b" " * end

        return TextMachine({i: plain(i, s) for i, s in self.pieces.items()}, b"")


_SEPARATORS = frozenset("\x1c\x1d\x1e\x1f")

# The library's parts follow different versions of Unicode.  Its word pattern
# follows version 16, its NFC version 9 and its lower case version 17, whereas the `regex`
# module is newer and Python's tables are those of 15.1.  First and last code points.
# letters and numbers that came after version 16; the library takes them for signs
_LATER_LETTERS = [
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
    (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D),
    (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA),
    (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
]
_LATER_NUMBERS = [(0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16FF4, 0x16FF6)]
# marks that came after version 9, and the second half of U+11938; the library neither orders nor composes them
_LATER_MARKS = [
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715),
    (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50),
    (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930),
    (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99),
    (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF),
]
# capitals that came after version 15.1, and the small letter of the first
_LATER_CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]


def _class(ranges: Iterable[tuple[int, int]]) -> str:
    return "[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges) + "]"


def _characters(ranges: Iterable[tuple[int, int]]) -> frozenset[str]:
    return frozenset(chr(c) for a, b in ranges for c in range(a, b + 1))


_SIGNS, _MARKS = _characters(_LATER_LETTERS + _LATER_NUMBERS), _characters(_LATER_MARKS)
_MARK = regex.compile("(" + _class(_LATER_MARKS) + ")")
_CAPITALS = _characters((a, b) for a, b, _ in _LATER_CAPITALS)
_SMALL = {c: small + c - a for a, b, small in _LATER_CAPITALS for c in range(a, b + 1)}


class _Chunks(dict):
    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = self.tokenizer.stretch(chunk)
        if len(self) < REMEMBERED_CHUNKS and len(chunk) <= LONGEST_REMEMBERED:
            self[chunk] = ids
        return ids


def _lower(text: str) -> str:
    """Lower case, a character at a time: no final sigma."""
    low = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
    return low if low.isascii() or _CAPITALS.isdisjoint(low) else low.translate(_SMALL)


def _nfc(text: str) -> str:
    if text.isascii():
        return text
    if _MARKS.isdisjoint(text):
        return unicodedata.normalize("NFC", text)
    # what lies between two characters that neither move nor compose is normalised by itself
    return "".join(p if k % 2 else unicodedata.normalize("NFC", p) for k, p in enumerate(_MARK.split(text)))


def _word_finder(pattern: str):
    """Finds the words of a text as the library's version of Unicode does."""
    plain = regex.compile(pattern)
    for name, later in (("L", _LATER_LETTERS), ("N", _LATER_NUMBERS)):
        pattern = pattern.replace(rf"\p{{{name}}}", rf"[\p{{{name}}}--{_class(later)}]")
    exact = regex.compile(pattern, regex.V1)
    return lambda text: (plain if text.isascii() or _SIGNS.isdisjoint(text) else exact).findall(text)


def _reader(spec: dict):
    """The word pattern and the steps of normalisation that a tokenizer file names."""
    steps = []
    for n in (spec.get("normalizer") or {}).get("normalizers", []):
        if n["type"] == "NFC":
            steps.append(_nfc)
        elif n["type"] == "Lowercase":
            steps.append(_lower)
        elif n["type"] != "Replace" or n["pattern"] != {"Regex": "\\s+"}:
            raise ValueError(f"unknown normalizer {n['type']}")
    before = {p["type"]: p for p in spec["pre_tokenizer"].get("pretokenizers", [])}
    split = before.get("Split")
    if split is None or split["behavior"] != "Removed" or not split["invert"] or before.get("ByteLevel", {}).get("add_prefix_space"):
        raise ValueError("unknown pre-tokenizer")
    return _word_finder(split["pattern"]["Regex"]), steps


class WordTransducer:
    """Encodes one word of any length in constant memory."""

    def __init__(self, tokenizer: Tokenizer, room: int | None = None):
        self.tokenizer = tokenizer
        self.room = room or 3 * tokenizer.lookahead + 64
        self.held = bytearray()

    def push(self, data: bytes) -> Iterator[int]:
        """Take more bytes of the word; give the tokens that have become stable."""
        for at in range(0, len(data), self.room):
            self.held += data[at : at + self.room]
            if len(self.held) > self.room:
                yield from self._stable()

    def _stable(self) -> Iterator[int]:
        known = len(self.held) - 1  # the last symbol may turn out to end the word
        tokens = self.tokenizer.merge([self.tokenizer.inner[b] for b in self.held[:known]])
        end = 0
        for t in tokens:
            if end + self.tokenizer.width[t] > known - self.tokenizer.lookahead:
                break
            end += self.tokenizer.width[t]
            yield t
        del self.held[:end]

    def finish(self) -> Iterator[int]:
        if self.held:
            inner, final = self.tokenizer.inner, self.tokenizer.final
            yield from self.tokenizer.merge([inner[b] for b in self.held[:-1]] + [final[self.held[-1]]])
            self.held.clear()


class TextMachine:
    """Turns token ids into text as they come; an unfinished character waits for its other bytes."""

    def __init__(self, pieces: dict[int, bytes], separator: bytes):
        self.pieces, self.separator = pieces, separator
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = False

    def push(self, ids: Iterable[int]) -> str:
        data = self.separator.join(map(self.pieces.__getitem__, ids))
        if data and self.separator and self.begun:
            data = self.separator + data
        self.begun = self.begun or bool(data)
        return self.machine.decode(data)

    def finish(self) -> str:
        self.begun = False
        return self.machine.decode(b"", final=True)


def digest(tokenizer: Tokenizer, machine: TextMachine, text: str | None, block: int = 1 << 15) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the ids and of the decoded text; a block of tokens at a time."""
    ids_hash, text_hash, n = hashlib.sha256(), hashlib.sha256(), 0

    def take(ids: list[int]) -> None:
        nonlocal n
        ids_hash.update(((" " if n else "") + " ".join(map(tokenizer.numerals.__getitem__, ids))).encode())
        text_hash.update(machine.push(ids).encode("utf-8", "surrogatepass"))
        n += len(ids)

    held: list[int] = []
    for ids in tokenizer.parts(text) if text else ():
        held += ids
        if len(held) >= block:
            take(held)
            held = []
    if held:
        take(held)
    text_hash.update(machine.finish().encode("utf-8", "surrogatepass"))
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


_loaded: dict[str, Tokenizer] = {}


def _tokenizer(spec_text: str) -> Tokenizer:
    """One tokenizer a process, with what it remembers."""
    key = hashlib.sha256(spec_text.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer(spec_text)
    return _loaded[key]


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(documents: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (``doc_id``), ``ids`` and ``n_tokens`` of every whole text; ``path`` is the driver's."""
    shared = documents.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    keep = keep or ["doc_id"]
    ids = per_text(lambda: _tokenizer(shared.value).encode, pa.list_(pa.int32()), F.col("text"))
    return documents.select(*keep, "text").select(*keep, ids.alias("ids")).select(*keep, F.size("ids").cast("long").alias("n_tokens"), "ids")


def decode(encoded: DataFrame, path: str, keep: list[str] | None = None, readable: bool = False) -> DataFrame:
    """``keep`` columns and the ``text`` of ``ids``: as the library gives it, or ``readable``."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(path))
    keep = keep or ["doc_id"]

    def make():
        known = _tokenizer(shared.value)
        machine = known.text_decoder() if readable else known.decoder()
        return lambda ids: machine.push(ids or []) + machine.finish()

    return encoded.select(*keep, per_text(make, pa.string(), F.col("ids")).alias("text"))


def digests(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text, there and back."""
    shared = documents.sparkSession.sparkContext.broadcast(read_tokenizer(path))

    def make():
        known = _tokenizer(shared.value)
        machine = known.decoder()
        return lambda text: digest(known, machine, text)

    rows = documents.select("doc_id", "text")
    return rows.select("doc_id", per_text(make, DIGEST, F.col("text")).alias("_digest")).select("doc_id", "_digest.*")
