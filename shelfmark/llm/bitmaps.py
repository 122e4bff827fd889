"""Sets of 64-bit hashes and of words as bitmaps of a bounded size.

A member is always found; others are found with a probability of at most the filled share (of
words: its fourth power), so a bitmap of hashes only ever spares work.  The bits are set by Spark; at most
``most_bits / 8`` bytes reach the driver, whatever the number of members.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKET_BITS = 32_768
BITS_FOR_EACH = 16
MOST_BITS = 1 << 27
PROBES = 4  # bits of each word
BITS_FOR_WORD = 32
MOST_WORD_BITS = 1 << 28


class HashedSet:
    """Hashes, each as one bit."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.bits = cells, 8 * len(cells)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) & np.uint64(self.bits - 1)
        return (self.cells[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) != 0

    def filled(self) -> float:
        return float(np.bitwise_count(self.cells).sum()) / self.bits


def hashed_set(rows: DataFrame, hashes: Column, n: int, most_bits: int = MOST_BITS) -> HashedSet:
    """The set of a column of hashes (longs) over about ``n`` rows; NULL is no member."""
    bits = min(most_bits, max(_BUCKET_BITS, 1 << int(BITS_FOR_EACH * max(1, n) - 1).bit_length()))
    return HashedSet(_cells(rows.select(hashes.bitwiseAND(F.lit(bits - 1)).alias("_at")).filter("_at IS NOT NULL"), bits))


def _cells(at: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of the positions in the column ``_at``."""
    # the functions count buckets from one, and bit positions from one as well
    parts = at.groupBy(F.expr("bitmap_bucket_number(_at + 1)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_at + 1))").alias("cells"))
    cells = np.zeros(bits // 8, dtype=np.uint8)
    for r in parts.collect():
        start = (r["bucket"] - 1) * (_BUCKET_BITS // 8)
        cells[start : start + _BUCKET_BITS // 8] = np.frombuffer(r["cells"], dtype=np.uint8)
    return cells


class WordSet:
    """Words, each as ``PROBES`` bits that its XXH64 names."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.mask = cells.tobytes(), 8 * len(cells) - 1

    @classmethod
    def of(cls, words: Iterable[str], most_bits: int = MOST_WORD_BITS) -> WordSet:
        words = set(words)
        cells = np.zeros(_word_bits(len(words), most_bits) // 8, dtype=np.uint8)
        for word in words:
            for at in _places(word, 8 * len(cells) - 1):
                cells[at >> 3] |= 1 << (at & 7)
        return cls(cells)

    def __contains__(self, word: str) -> bool:
        cells = self.cells
        for at in _places(word, self.mask):
            if not cells[at >> 3] >> (at & 7) & 1:
                return False
        return True

    def false_share(self) -> float:
        """The probability that a word which is no member is found."""
        filled = float(np.bitwise_count(np.frombuffer(self.cells, dtype=np.uint8)).sum()) / (self.mask + 1)
        return filled**PROBES


def _places(word: str, mask: int) -> Iterator[int]:
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
    at, step = h & mask, (h >> 32) & mask | 1
    for _ in range(PROBES):
        yield at
        at = (at + step) & mask


def _word_bits(n: int, most_bits: int) -> int:
    return min(most_bits, max(_BUCKET_BITS, 1 << int(BITS_FOR_WORD * max(1, n) - 1).bit_length()))


def word_set(rows: DataFrame, word: Column, n: int, most_bits: int = MOST_WORD_BITS) -> WordSet:
    """The set of a column of words over about ``n`` rows."""
    bits = _word_bits(n, most_bits)
    h, mask = F.xxhash64(word), F.lit(bits - 1)
    first, step = h.bitwiseAND(mask), F.shiftrightunsigned(h, 32).bitwiseAND(mask).bitwiseOR(F.lit(1))
    places = F.array(*[(first + step * k).bitwiseAND(mask) for k in range(PROBES)])
    return WordSet(_cells(rows.select(F.explode(places).alias("_at")), bits))
