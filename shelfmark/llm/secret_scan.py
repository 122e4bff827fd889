"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a value assigned to a name, the password of an address, a token of a known form,
or a long run that mixes letters and digits.  Private keys and known forms win over what they
overlap; the rest of that stays a candidate.  The forest looks at its length, its character transitions, how far
dictionary words cover it, the path it stands in and the words next to it.  It is trained in
numpy on labelled findings: either given ones or, as in the query, findings planted in a
bounded sample of the corpus, where the label is known because the value was made.  Words and
letter transitions are counted over all documents; the words that occur twice, every one of them,
are kept in a bitmap of at most 32 MB (see ``bitmaps``).  A candidate longer than ``_WINDOW`` is read
in overlapping windows and has the score of its best one.

Defined results: NULL or empty text has no candidate; repeated rows are scored alike; over an
empty table the forest is trained without context; ``path`` may be NULL.  Positions are code
points, end exclusive.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import math
import random
import re
import string
import urllib.parse
import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.bitmaps import MOST_WORD_BITS, WordSet, word_set
from shelfmark.llm.common import free_name, per_text, texts_of
from shelfmark.session import stage, staging

SECRET = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())])
FOUND = pa.struct([("n_candidates", pa.int64()), ("secrets", pa.list_(SECRET))])
PLACEHOLDER = "[secret]"

# Words next to secrets, words next to look-alikes, forms of known tokens.
STRONG_CUES = ("token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key", "private_key", "credential", "bearer")
WEAK_CUES = ("key", "auth", "pass", "login", "signature")
BENIGN_CUES = ("commit", "sha", "md5", "checksum", "digest", "hash", "uuid", "guid", "etag", "build", "version", "revision", "request", "trace", "image", "integrity", "page", "order", "file", "color", "isbn", "serial")
PLACEHOLDER_CUES = ("example", "sample", "placeholder", "dummy", "your", "changeme", "xxxx", "fake", "test", "todo", "insert", "redacted", "environ", "getenv", "<", "${", "****", "....")
BENIGN_PATHS = ("test", "example", "sample", "fixture", "mock", "doc", "spec", "lock", "vendor")
SECRET_PATHS = (".env", ".pem", ".key", ".ini", ".cfg", ".conf", ".yml", ".yaml", ".tfvars", "config", "secret", "credential")
KNOWN_FORM = re.compile(
    r"(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|sk_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|glpat-[A-Za-z0-9_-]{20,})",
    re.IGNORECASE,
)

RUN = frozenset(string.ascii_letters + string.digits + "+/_.~-")
_DIGITS = re.compile(r"[0-9]+")
_ASSIGN = re.compile(r"[:=]")
_VALUE = re.compile(r"[:=]{0,2}>?(?:[^\S\n]*+\n){0,3}+[^\S\n]*+(?:Bearer\s+|Basic\s+)?([\"'`]?)([^\s\"'`<>,;(){}|\[\]]{6,})?", re.IGNORECASE)
_QUOTED = {q: re.compile(rf"((?:[^{q}\\\n]|\\.)*+){q}") for q in "\"'`"}
_ADDRESS = re.compile(r"://[^\s/?#:@\"'`<>]*+:([^\s/?#\"'`<>]+)@")
_FORM_START = re.compile(r"[AaGgXxSsEe](?<![A-Za-z0-9].)(?:[KkSs][Ii][Aa]|[Hh][A-Za-z]_|[Oo][Xx]|[Kk][-_]|[Ii][Zz][Aa]|[Yy][Jj]|[Ll][Pp][Aa][Tt]-)", re.DOTALL)
_NAME_CUES = STRONG_CUES + WEAK_CUES + BENIGN_CUES + ("authorization",)
_LONGEST_CUE = max(map(len, _NAME_CUES))
_CUE = re.compile("|".join(sorted(map(re.escape, _NAME_CUES), key=len, reverse=True)), re.IGNORECASE)
# a name before a sign, read backwards
_NAME = re.compile(r"\s{0,3}[\"'`\]]{0,2}([A-Za-z0-9_.-]{0,60}[A-Za-z_])")
# a private key with its headers, whole or cut off after some of its lines; line ends may be escaped
_PEM = re.compile(
    r"-----BEGIN [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----(?:(?:\s|\\[nr])*+[A-Za-z][A-Za-z-]{0,30}: [^\n\\]*+)*+"
    r"(?:[A-Za-z0-9+/=\s\\]*+-----END [A-Z0-9 ]{0,30}PRIVATE KEY(?: BLOCK)?-----|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})++)"
)
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_WORDS = re.compile(r"(?<![a-z0-9_])[a-z]{3,}+(?![a-z0-9_])")
_LETTERS = re.compile(r"[a-z]{3,}")
_SHORTEST = 6  # characters of a candidate: shorter values, quoted ones as well, are none
_AROUND = 48
_WINDOW = 512  # characters of a candidate that per-character features read at a time; its length counts in full
_STRETCH = 1 << 20  # characters of a text whose letter pairs are counted at a time
_COUNTED = 100_000  # words that a task holds before it hands its counts on
_PLANTED = 20_000  # words that look-alikes are made of, chosen by hash


@dataclass(frozen=True)
class Settings:
    contexts: int = 2000  # bound of the corpus sample for planted findings
    findings: int = 6000
    trees: int = 40
    depth: int = 10
    least_leaf: int = 3
    bins: int = 32
    threshold: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: str
    name: str


def _fixed(text: str) -> list[Candidate]:
    """Private keys and tokens of known forms, none overlapping another."""
    found, out = [], []
    if "-----BEGIN" in text:
        found += [Candidate(m.start(), m.end(), "private key", "") for m in _PEM.finditer(text)]
    for m in _FORM_START.finditer(text):
        known = KNOWN_FORM.match(text, m.start())
        # without a digit and in small letters the first form is an ordinary word
        if known and (known[0][1:4].lower() not in ("kia", "sia") or known[0].isupper() or _DIGITS.search(known[0])):
            found.append(Candidate(known.start(), known.end(), "known form", ""))
    for c in sorted(found, key=lambda c: (c.start, -c.end)):
        if not out or c.start >= out[-1].end:
            out.append(c)
    return out


def _assigned(text: str, fixed: list[int]) -> list[Candidate]:
    """Values assigned to a name that tells something, and passwords of addresses; ``fixed`` is where known forms begin."""
    found, inner, upto, known, last = [], [], 0, set(fixed), None
    cues, near, cue = _CUE.finditer(text), -1, None
    for m in _ASSIGN.finditer(text):
        # a sign within a value begins none of its own, unless a known form follows: each value is read once
        within = m.start() < upto
        if within and (last is None or m.end() not in known):
            continue
        while cue is None or cue.start() < m.start():
            near = cue.start() if cue else near
            cue = next(cues, None)
            if cue is None:
                break
        end, lines = m.start(), 0
        while end and text[end - 1].isspace() and lines <= 3:
            end -= 1
            lines += text[end] == "\n"
        if near < 0 or near < end - 70 - _LONGEST_CUE or lines > 3:
            continue
        before = _NAME.match(text[max(0, end - 70) : end][::-1])
        name = before[1][::-1] if before else ""
        if not any(c in name.lower() for c in _NAME_CUES):
            continue
        if within:
            after = bisect.bisect_right(fixed, m.end())
            inner.append(Candidate(m.end(), min([last.end, *fixed[after : after + 1]]), "assigned", name))
            continue
        value = _VALUE.match(text, m.start())
        quoted = _QUOTED[value[1]].match(text, value.end(1)) if value[1] else None
        if quoted:
            if "://" not in quoted[1]:
                found.append(Candidate(quoted.start(1), quoted.end(1), "assigned", name))
        elif value[2] and "://" in value[0]:
            last, upto = None, m.start() + value[0].rindex("://") + 1  # signs before it have values that hold it as well
        elif value[2]:
            found.append(Candidate(value.start(2), value.start(2) + len(value[2].rstrip(".!?:#*&$%")), "assigned", name))
        if found and found[-1].end - found[-1].start >= _SHORTEST:
            last = found[-1]  # signs at its very end may have a value behind it
            upto = max(upto, last.start + len(text[last.start : last.end].rstrip(":=")))
    return found + inner + [Candidate(m.start(1), m.end(1), "assigned", "password") for m in _ADDRESS.finditer(text)]


def _runs(text: str) -> list[Candidate]:
    found, upto = [], 0
    for m in _DIGITS.finditer(text):
        if m.start() < upto:
            continue
        a, b = m.start(), m.end()
        while a > upto and text[a - 1] in RUN:
            a -= 1
        while b < len(text) and text[b] in RUN:
            b += 1
        padded = b + len(text[b : b + 2]) - len(text[b : b + 2].lstrip("="))
        if text[padded : padded + 1] not in RUN:  # of base64, not of an assignment
            b = padded
        upto = b
        found.append(Candidate(a, b, "run", ""))
    return found


def _without(c: Candidate, fixed: list[Candidate], starts: list[int]) -> list[tuple[int, int]]:
    """What ``fixed`` leaves of a candidate; a value that begins with a known form stays whole."""
    k, at, left = max(0, bisect.bisect_right(starts, c.start) - 1), c.start, []
    while k < len(fixed) and fixed[k].start < c.end:
        f = fixed[k]
        if f.end > at and not (c.kind == "assigned" and f.start == c.start and f.end <= c.end):
            left.append((at, f.start))
            at = f.end
        k += 1
    return [(a, b) for a, b in [*left, (at, c.end)] if a < b]


def candidates(text: str) -> list[Candidate]:
    """Candidates in order; of overlapping ones the first, and of those the longest."""
    fixed = _fixed(text)
    starts = [c.start for c in fixed]
    found = list(fixed)
    for c in _assigned(text, starts):
        found += [Candidate(a, b, c.kind, c.name) for a, b in _without(c, fixed, starts)]
    for c in _runs(text):
        for a, b in _without(c, fixed, starts):
            run = text[a:b]
            stripped = run.strip(".-=/~")
            if len(stripped) >= 16 and any(x.isalpha() for x in stripped) and _DIGITS.search(stripped):
                a += run.index(stripped)
                found.append(Candidate(a, a + len(stripped), "run", ""))
    out, upto = [], 0
    for c in sorted((c for c in found if c.end - c.start >= _SHORTEST), key=lambda c: (c.start, c.kind == "run", -c.end)):
        if c.start >= upto:
            out.append(c)
            upto = c.end
    return out


@dataclass(frozen=True)
class Lexicon:
    """What ordinary text looks like: letter transitions and words that occur twice."""

    transitions: np.ndarray  # 27 x 27 log probabilities
    words: WordSet
    some: tuple[str, ...] = ()  # words that look-alikes are made of

    @classmethod
    def of(cls, texts: list[str]) -> Lexicon:
        pairs, words = np.zeros(27 * 27, dtype=np.int64), Counter()
        for text in texts:
            pairs += _letter_pairs(text)
            words.update(_WORDS.findall(text.lower()))
        return cls(_log_shares(pairs), WordSet.of(w for w, n in words.items() if n >= 2))

    @classmethod
    def over(cls, documents: DataFrame, most_bits: int = MOST_WORD_BITS) -> Lexicon:
        """From all documents: counts of each task, added by Spark.

        The letter pairs, a bitmap of at most ``most_bits`` bits and ``_PLANTED`` words come to the driver.
        """

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs, words = np.zeros(27 * 27, dtype=np.int64), Counter()
            table = lambda names, counts: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])
            for batch in batches:
                for texts in texts_of(batch.column(0)):
                    for text in texts:
                        pairs += _letter_pairs(text)
                        words.update(m[0] for m in _WORDS.finditer(text.lower()))
                        if len(words) > _COUNTED:
                            yield table(list(words), list(words.values()))
                            words.clear()
            yield table(list(words), list(words.values()))
            yield table([str(k) for k in range(len(pairs))], pairs)  # numbers are no words

        rows = documents.filter("text IS NOT NULL").select("text").mapInArrow(count, "word string, n long")
        total = rows.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= 2) | F.col("word").rlike("^[0-9]"))
        pairs = np.zeros(27 * 27, dtype=np.int64)
        with staging(documents.sparkSession):
            total = stage(total, "words")
            words = total.filter(~F.col("word").rlike("^[0-9]"))
            for r in total.filter(F.col("word").rlike("^[0-9]")).collect():
                pairs[int(r["word"])] = r["n"]
            some = words.select("word").orderBy(F.crc32("word"), "word").limit(_PLANTED).collect()
            return cls(_log_shares(pairs), word_set(words, F.col("word"), words.count(), most_bits), tuple(r["word"] for r in some))

    def coverage(self, value: str) -> float:
        """The share of characters that dictionary words cover, longest first."""
        low, covered = value.lower(), 0
        for letters in _LETTERS.finditer(low):
            at, end = letters.span()
            while end - at > 2:
                for n in range(min(14, end - at), 2, -1):
                    if low[at : at + n] in self.words:
                        covered += n
                        at += n
                        break
                else:
                    at += 1
        return covered / max(1, len(low))


def _log_shares(pairs: np.ndarray) -> np.ndarray:
    pairs = pairs.reshape(27, 27) + 1.0
    return np.log(pairs / pairs.sum(axis=1, keepdims=True))


def _letter_codes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.int64) - 97
    return np.where((codes < 0) | (codes > 25), 26, codes)


def _letter_pairs(text: str) -> np.ndarray:
    """How often each letter follows each, 27 x 27 in a row."""
    pairs = np.zeros(27 * 27, dtype=np.int64)
    for at in range(0, len(text), _STRETCH):
        codes = _letter_codes(text[at : at + _STRETCH + 1].lower())
        pairs += np.bincount(codes[:-1] * 27 + codes[1:], minlength=27 * 27)
    return pairs


def windows(c: Candidate) -> range:
    """Where the windows of a candidate begin; they overlap by half and reach its end."""
    return range(0, max(1, c.end - c.start - _WINDOW // 2), _WINDOW // 2)


def features(text: str, c: Candidate, path: str | None, lexicon: Lexicon, at: int = 0) -> list[float]:
    """The features of a candidate's window that begins ``at`` so many characters."""
    v = text[c.start + at : min(c.end, c.start + at + _WINDOW)]
    n = len(v)
    kinds = ["d" if ch.isdigit() else "u" if ch.isupper() else "l" if ch.isalpha() else "s" for ch in v]
    share = Counter(kinds)
    seen = Counter(v)
    codes = _letter_codes(v.lower())
    steps = lexicon.transitions[codes[:-1], codes[1:]] if n > 1 else np.zeros(1)
    letter_steps = steps[(codes[:-1] < 26) & (codes[1:] < 26)] if n > 1 else steps
    before = text[max(0, c.start - _AROUND) : c.start].lower()
    after = text[c.end : c.end + _AROUND].lower()
    name, low, where = c.name.lower(), v.lower(), (path or "").lower()
    has = lambda words, s: float(sum(w in s for w in words))
    ords = [ord(ch) for ch in v]
    return [
        math.log(c.end - c.start),
        len(seen) / n,
        -sum(k / n * math.log2(k / n) for k in seen.values()),
        share["d"] / n,
        share["u"] / n,
        share["l"] / n,
        share["s"] / n,
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n,
        sum(a == "l" and b == "u" for a, b in zip(kinds, kinds[1:])) / n,
        float(steps.mean()),
        float(letter_steps.mean()) if len(letter_steps) else -9.0,
        float((letter_steps < -6).mean()) if len(letter_steps) else 1.0,
        lexicon.coverage(v),
        float(_HEX.fullmatch(v) is not None),
        max((len(x) for x in re.findall(r"\d+", v)), default=0),
        max((len(x) for x in re.findall(r"[A-Za-z]+", v)), default=0),
        sum(a == b for a, b in zip(ords, ords[1:])) / n,
        sum(b - a == 1 for a, b in zip(ords, ords[1:])) / n,
        float(KNOWN_FORM.match(v) is not None),
        float(c.kind == "assigned"),
        float(c.kind == "private key"),
        float(before[-1:] in "\"'`" and before != ""),
        has(STRONG_CUES, name),
        has(WEAK_CUES, name),
        has(BENIGN_CUES, name),
        has(STRONG_CUES, before[-30:]),
        has(BENIGN_CUES, before[-30:]),
        has(PLACEHOLDER_CUES, low),
        has(PLACEHOLDER_CUES, before[-24:]),
        has(STRONG_CUES + WEAK_CUES, after),
        float("://" in before or "www." in before or "http" in low),
        float(before[-1:] in "/\\." and before != ""),
        v.count("/") / n,
        v.count(".") / n,
        float(_UUID.search(v) is not None),
        float("@" in after[:1] or "@" in v),
        float("base64," in before),
        has(BENIGN_PATHS, where),
        has(SECRET_PATHS, where),
    ]


# -- random forest ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: a node's feature (-1 at a leaf), threshold, children and share of secrets."""

    trees: tuple[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= threshold[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += value[node]
        return total / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, settings: Settings, rng: np.random.Generator) -> tuple:
    feature, threshold, left, right, value = [], [], [], [], []

    def node(rows: np.ndarray, depth: int) -> int:
        k = len(feature)
        share = y[rows].mean()
        for column, v in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (value, share)):
            column.append(v)
        if depth == settings.depth or len(rows) < 2 * settings.least_leaf or share in (0.0, 1.0):
            return k
        best = (0.0, -1, 0.0)
        for f in rng.choice(x.shape[1], size=int(math.sqrt(x.shape[1])) + 2, replace=False):
            values = x[rows, f]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, settings.bins + 1)[1:-1]))
            below = values[:, None] <= cuts[None, :]
            n_left = below.sum(axis=0)
            pos_left = (below * y[rows][:, None]).sum(axis=0)
            n_right, pos_right = len(rows) - n_left, y[rows].sum() - pos_left
            ok = (n_left >= settings.least_leaf) & (n_right >= settings.least_leaf)
            with np.errstate(divide="ignore", invalid="ignore"):
                impurity = 2 * (pos_left * (1 - pos_left / n_left) + pos_right * (1 - pos_right / n_right)) / len(rows)
            gain = np.where(ok, 2 * share * (1 - share) - impurity, 0.0)
            if len(gain) and gain.max() > best[0] + 1e-12:
                best = (gain.max(), f, cuts[gain.argmax()])
        if best[1] >= 0:
            go = x[rows, best[1]] <= best[2]
            feature[k], threshold[k] = int(best[1]), float(best[2])
            left[k] = node(rows[go], depth + 1)
            right[k] = node(rows[~go], depth + 1)
        return k

    node(rng.integers(0, len(x), len(x)), 0)
    return tuple(np.array(c) for c in (feature, threshold, left, right, value))


def grow_forest(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Forest:
    rng = np.random.default_rng(settings.seed)
    return Forest(tuple(_grow(x, y, settings, rng) for _ in range(settings.trees)))


# -- labelled findings -----------------------------------------------------------------------

_POSITIVE_NAMES = ("token", "secret", "api_key", "apiKey", "access_key", "password", "passwd", "client_secret", "auth_token", "secret_key", "accessToken", "db_password", "API_TOKEN", "private_key", "bearer_token")
_NEGATIVE_NAMES = ("commit", "sha1", "sha256", "md5", "checksum", "digest", "etag", "build_id", "uuid", "request_id", "hash", "version", "image", "file_hash", "page_id", "trace_id", "revision", "integrity")
_FORMS = ('{n} = "{v}"', "{n} = '{v}'", "{n}: {v}", '"{n}": "{v}"', "{n}={v}", '{n} := "{v}"', "export {n}={v}", "Authorization: Bearer {v}", '{n} => "{v}"')
_ADDRESSES = ("postgres://app:{v}@db.example.com/main", "https://user:{v}@example.com/", "amqp://{n}:{v}@queue")
_IN_PATH = ("", "", "", "conf/", "//host/path/", "x.")
_ALNUM = string.ascii_letters + string.digits


def _random_value(r: random.Random) -> str:
    kind = r.randrange(8)
    pick = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    if kind <= 2:
        return pick("0123456789abcdef", r.choice((32, 40, 40, 48, 64)))
    if kind == 3:
        return base64.b64encode(r.randbytes(r.randrange(15, 48))).decode()
    if kind == 4:
        return pick(_ALNUM, r.randrange(18, 45))
    if kind == 5:
        return pick(_ALNUM + "_-", r.randrange(20, 60))
    if kind == 6:
        return pick(_ALNUM, 1) + pick(_ALNUM + "!@#%^&*+?", r.randrange(9, 18)) + pick(string.digits, 2)
    return r.choice(
        (
            "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
            "ghp_" + pick(_ALNUM, 36),
            "xoxb-" + pick(string.digits, 11) + "-" + pick(_ALNUM, 24),
            "sk_live_" + pick(_ALNUM, 24),
            "sk-" + pick(_ALNUM, 40),
            "AIza" + pick(_ALNUM + "_-", 35),
            "glpat-" + pick(_ALNUM, 20),
        )
    )


def _pem(r: random.Random, label: str, body: Callable[[int], str]) -> str:
    """A block of lines between BEGIN and END, at times with headers, escaped line ends, or cut off."""
    text = body(r.choice((64, 120, 400, 900, 1600)))
    lines = [text[k : k + 64] for k in range(0, len(text), 64)]
    if r.random() < 0.25:
        lines = [*r.choice((["Proc-Type: 4,ENCRYPTED", f"DEK-Info: AES-256-CBC,{r.getrandbits(128):032X}", ""], ["Version: GnuPG v2", ""])), *lines]
    whole = [f"-----BEGIN {label}-----", *lines, f"-----END {label}-----"]
    if r.random() < 0.2 and len(lines) > 1:
        whole = whole[: r.randrange(2, len(whole))]
    return r.choice(("\n", "\n", "\n", "\\n")).join(whole)


def _private_key(r: random.Random) -> str:
    label = r.choice(("RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "PGP PRIVATE KEY BLOCK"))
    return _pem(r, label, lambda n: base64.b64encode(r.randbytes(n)).decode())


def _no_private_key(r: random.Random, words: list[str]) -> str:
    """A public key, a certificate, or a private key that is only shown as an example."""
    if r.random() < 0.3:
        filler = r.choice(("x", "A", "yourprivatekeyhere", "examplekey", "".join(r.choice(words) for _ in range(3))))
        return _pem(r, r.choice(("RSA PRIVATE KEY", "PRIVATE KEY")), lambda n: (filler * n)[:n])
    return _pem(r, r.choice(("CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "PGP PUBLIC KEY BLOCK")), lambda n: base64.b64encode(r.randbytes(min(n, 200))).decode())


def _harmless_value(r: random.Random, words: list[str]) -> str:
    some = lambda n: [r.choice(words) for _ in range(n)]
    return r.choice(
        (
            lambda: "your-" + r.choice(("token", "key", "secret")) + "-here",
            lambda: "x" * r.randrange(8, 40),
            lambda: "changeme" + str(r.randrange(100)),
            lambda: "example-" + "-".join(some(2)) + str(r.randrange(1000)),
            lambda: "get" + "".join(w.capitalize() for w in some(3)),
            lambda: ".".join(some(3)),
            lambda: "_".join(some(3)),
            lambda: "".join(some(3)),
            lambda: "${" + "_".join(some(2)).upper() + "}",
            lambda: "os.environ.get." + r.choice(words).upper(),
            lambda: "*" * r.randrange(8, 24),
            lambda: "1234567890" * r.randrange(1, 4),
            lambda: "abcdefghijklmnop" + "0123456789"[: r.randrange(10)],
        )
    )()


def _harmless_run(r: random.Random, words: list[str]) -> str:
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    return r.choice(
        (
            lambda: str(uuid.UUID(int=r.getrandbits(128))),
            lambda: hexes(r.choice((32, 40, 64))),
            lambda: "https://" + r.choice(words) + ".example.com/" + "/".join(r.choice(words) for _ in range(3)) + f"/{r.randrange(10**6)}.html",
            lambda: "/usr/lib/" + r.choice(words) + f"-{r.randrange(9)}.{r.randrange(99)}.{r.randrange(99)}/" + r.choice(words) + ".so.1",
            lambda: r.choice(words) + f".{r.randrange(100)}@mail{r.randrange(9)}.example.com",
            lambda: "".join(r.choice(words) for _ in range(3)) + str(r.randrange(1000)),
            lambda: "-".join(r.choice(words) for _ in range(4)) + f"-{r.randrange(2030)}",
            lambda: f"2024-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}T{r.randrange(24):02}.{r.randrange(60):02}.{r.randrange(60):02}Z",
            lambda: "data:image/png;base64," + base64.b64encode(r.randbytes(r.randrange(30, 90))).decode(),
            lambda: "_".join(r.choice(words) for _ in range(3)) + f"_v{r.randrange(20)}.tar.gz",
        )
    )()


def planted_findings(texts: list[str], settings: Settings = Settings(), words: Iterable[str] | None = None) -> list[tuple[str, Candidate, str | None, int]]:
    """Labelled findings: made secrets and made look-alikes in pieces of the given texts.

    Look-alikes are made of ``words``, by default those of the texts; 20,000 are chosen by hash.
    """
    r = random.Random(settings.seed)
    words = {w for t in texts for w in _WORDS.findall(t.lower())} if words is None else words
    words = heapq.nsmallest(_PLANTED, words, key=lambda w: (zlib.crc32(w.encode()), w)) or ["alpha", "record", "value", "entry"]
    paths = (None, None, "src/app/config.yml", "deploy/.env", "tests/test_login.py", "docs/example.md", "src3", "lib/client.js", "vendor/lock.json")
    out = []
    while len(out) < settings.findings:
        text = r.choice(texts) if texts else ""
        at = r.randrange(len(text) + 1)
        before, after = text[max(0, at - 120) : at], text[at : at + 120]
        secret = r.random() < 0.5
        if r.random() < 0.06:
            piece = value = _private_key(r) if secret else _no_private_key(r, words)
            if r.random() < 0.3:
                piece = r.choice(_FORMS[:5]).format(n=r.choice(("private_key", "key", "tls_key", "cert")), v=value)
        elif secret:
            value = _random_value(r)
            known = KNOWN_FORM.match(value)
            if known and r.random() < 0.4:
                piece = r.choice(_IN_PATH) + value
            elif r.random() < 0.1:
                value = urllib.parse.quote(value, safe="")
                piece = r.choice(_ADDRESSES).format(n=r.choice(_POSITIVE_NAMES), v=value)
            else:
                piece = r.choice(_FORMS).format(n=r.choice(_POSITIVE_NAMES), v=value)
        elif r.random() < 0.35:
            value = _harmless_value(r, words)
            piece = r.choice(_ADDRESSES if r.random() < 0.1 else _FORMS).format(n=r.choice(_POSITIVE_NAMES), v=value)
        elif r.random() < 0.5:
            value = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64)))) if r.random() < 0.7 else _harmless_run(r, words)
            piece = r.choice(_FORMS[:7]).format(n=r.choice(_NEGATIVE_NAMES), v=value)
        else:
            value = _harmless_run(r, words)
            piece = value
        piece += r.choice(("", "", "", "!!", "###", ".", ",", ";"))
        line = before + r.choice((" ", "\n", " ")) + piece + r.choice((" ", "\n", "")) + after
        if r.random() < 0.2:
            line, value = line.upper(), value.upper()
        path = r.choice(paths)
        for c in candidates(line):
            if value[:40] in line[c.start : c.end] or line[c.start : c.end] in value:
                out.append((line, c, path, int(secret)))
    return out[: settings.findings]


# -- over documents --------------------------------------------------------------------------


@dataclass(frozen=True)
class Scanner:
    forest: Forest
    lexicon: Lexicon
    threshold: float

    def secrets(self, text: str | None, path: str | None = None) -> tuple[int, list[tuple[Candidate, float]]]:
        """The number of candidates and those that the forest takes for secrets."""
        found = candidates(text) if text else []
        if not found:
            return 0, []
        of = [(k, at) for k, c in enumerate(found) for at in windows(c)]
        each = self.forest.predict(np.array([features(text, found[k], path, self.lexicon, at) for k, at in of]))
        scores = np.zeros(len(found))
        np.maximum.at(scores, [k for k, _ in of], each)
        return len(found), [(c, float(s)) for c, s in zip(found, scores) if s >= self.threshold]

    def report(self, text: str | None, path: str | None = None) -> dict:
        n, kept = self.secrets(text, path)
        return {"n_candidates": n, "secrets": [{"start": c.start, "end": c.end, "kind": c.kind, "score": s} for c, s in kept]}

    def redacted(self, text: str | None, path: str | None = None) -> str | None:
        """The text with its secrets replaced; None if it has none."""
        _, kept = self.secrets(text, path)
        if not kept:
            return None
        parts, at = [], 0
        for c, _ in kept:
            parts += [text[at : c.start], PLACEHOLDER]
            at = c.end
        return "".join([*parts, text[at:]])


def fit(texts: list[str], findings: list[tuple[str, Candidate, str | None, int]] | None = None, settings: Settings = Settings(), lexicon: Lexicon | None = None) -> Scanner:
    """A scanner from labelled findings (text, candidate, path, label); planted ones in ``texts`` if none are given."""
    words, lexicon = lexicon and lexicon.some, replace(lexicon or Lexicon.of(texts), some=())
    findings = findings or planted_findings(texts, settings, words)
    x = np.array([features(t, c, p, lexicon) for t, c, p, _ in findings])
    return Scanner(grow_forest(x, np.array([y for *_, y in findings], dtype=float), settings), lexicon, settings.threshold)


def fit_on(documents: DataFrame, settings: Settings = Settings()) -> Scanner:
    """A scanner whose planted findings stand in at most ``settings.contexts`` texts of the corpus, chosen by hash; its lexicon counts all."""
    rows = documents.filter("text IS NOT NULL").select("text")
    share = min(1.0, 2.0 * settings.contexts / max(1, documents.count()))
    place = F.xxhash64("text")
    near = rows.filter(F.pmod(place, F.lit(1 << 24)) < share * (1 << 24)).distinct()
    texts = [r["text"] for r in near.orderBy(place, "text").limit(settings.contexts).collect()]
    return fit(texts, settings=settings, lexicon=Lexicon.over(documents))


def _with(documents: DataFrame, scanner: Scanner, kind: pa.DataType, use: str, path: str | None) -> Column:
    shared = documents.sparkSession.sparkContext.broadcast(scanner)
    columns = [F.col("text")] + ([F.col(path)] if path else [])
    return per_text(lambda: getattr(shared.value, use), kind, *columns)


def scan(documents: DataFrame, scanner: Scanner, path: str | None = None) -> DataFrame:
    """Every document with its secrets: doc_id, n_candidates, n_secrets, secrets."""
    rows = documents.select("doc_id", "text", *[path] * bool(path))
    found = rows.select("doc_id", _with(rows, scanner, FOUND, "report", path).alias("_found"))
    return found.select("doc_id", "_found.n_candidates", F.size("_found.secrets").cast("long").alias("n_secrets"), "_found.secrets")


def redact(documents: DataFrame, scanner: Scanner, path: str | None = None) -> DataFrame:
    """The documents with every secret replaced by ``PLACEHOLDER``, and ``n_chars`` as it is then."""
    clean = free_name(documents, "_clean_text")
    text = F.coalesce(F.col(clean), F.col("text"))
    after = documents.withColumn(clean, _with(documents, scanner, pa.string(), "redacted", path))
    changed = F.col(clean).isNotNull()
    columns = [
        text.alias("text") if c == "text" else F.when(changed, F.char_length(clean).cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias(c) if c == "n_chars" else F.col(f"`{c}`")
        for c in documents.columns
    ]
    return after.select(*columns)
