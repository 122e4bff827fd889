"""Words of UTF-8 texts as numpy arrays: where they begin and end, and a 64-bit hash of each."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)
# Bytes of a text that are looked at together: bounds memory for texts of any length.
STRETCH = 1 << 20


def plain(text: str) -> bytes:
    """A-Z lower-cased; other ASCII signs than letters and digits are spaces."""
    return text.encode("utf-8", "surrogatepass").translate(_PLAIN)


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    inside = np.frombuffer(data, dtype=np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    return edges[0::2], edges[1::2]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, back)]), dtype=np.uint64)
    return _powers[:n], _inverse[:n]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, from differences of one running sum."""
    powers, inverse = _powers_to(len(data) + 1)
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(codes * powers[:-1], dtype=np.uint64)])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def hashes_of(words: list[bytes]) -> np.ndarray:
    data = b" ".join(words)
    return word_hashes(data, *word_bounds(data))


def stretches(data: bytes, overlap: int, size: int = STRETCH) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, int]]:
    """Parts of a text cut at spaces: bytes, word starts and ends, and how many words belong to the next part as well."""
    at, carried = 0, b""
    while at < len(data):
        cut = len(data) if len(data) - at <= size else data.find(b" ", at + size)
        cut = len(data) if cut < 0 else cut
        part = carried + data[at:cut]
        at = cut
        starts, ends = word_bounds(part)
        keep = min(overlap, len(starts)) if at < len(data) else 0
        yield part, starts, ends, keep
        carried = part[starts[len(starts) - keep] :] if keep else b""
