"""64-bit names for words and word sequences, and bounded filters over them."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose hash a task remembers; then it starts anew.
REMEMBERED = 400_000
_FILTER_BITS = 26
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """XXH64 of a word by look-up; never zero, as zero stands for a gap."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, self.seed) or 1
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * _M1
    values = (values ^ (values >> np.uint64(27))) * _M2
    return values ^ (values >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of a pair of names, in this order; zero where one of them is zero."""
    both = mixed(left * np.uint64(0x9E3779B97F4A7C15) + mixed(right + np.uint64(0x632BE59BD9B4E019)))
    both[both == 0] = 1
    both[(left == 0) | (right == 0)] = 0
    return both


_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes whose words are named in one go.
_SEGMENT = 1 << 20


def _table() -> np.ndarray:
    """A number for each byte; A-Z count as a-z, and ASCII white space as nothing."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    table[0x41:0x5B] = table[0x61:0x7B]
    table[[0x20, *range(0x09, 0x0E)]] = 0
    return table


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordNames:
    """Names of the words of texts, runs without ASCII white space, from sums over their bytes.

    A word is the sum of a number per byte times a power of an odd base, moved back by where the
    word begins; so all words of a stretch of text come from one running sum. Equal words
    have equal names, others have different ones but for chance (64 bits).
    """

    def __init__(self):
        self.table = _table()
        self._grow(_SEGMENT)

    def _grow(self, n: int) -> None:
        self.up = _powers(_BASE, n)
        self.down = _powers(pow(_BASE, -1, 1 << 64), n)

    def of(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where the words of ``data`` begin, and their names."""
        places, names, at = [], [], 0
        while at < len(data):
            stop = at + _SEGMENT
            if stop < len(data):
                while stop < len(data) and data[stop] not in b" \t\n\v\f\r":
                    stop += 1
            starts, found = self._segment(np.frombuffer(data, np.uint8, min(stop, len(data)) - at, at))
            places.append(starts + at)
            names.append(found)
            at = stop
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.concatenate(places), np.concatenate(names)

    def _segment(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(data) > len(self.up):
            self._grow(len(data))
        value = self.table[data]
        word = np.zeros(len(data) + 2, np.int8)
        word[1:-1] = value != 0
        turn = np.diff(word)
        starts, stops = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        value *= self.up[: len(data)]
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        names = mixed((total[stops] - total[starts]) * self.down[starts])
        names[names == 0] = 1
        return starts, names

    def by_text(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and the names of all of them in order."""
        parts = [t.encode() if t else b"" for t in texts]
        ends = np.cumsum([len(p) + 1 for p in parts])
        starts, names = self.of(b" ".join(parts))
        return np.diff(np.searchsorted(starts, ends), prepend=0), names


def spread_filter(names: DataFrame, column: str) -> np.ndarray:
    """A bit table of fixed size (8 MB) in which the bit of every name of ``names`` is set.

    Parts of 4 KB are built by partial aggregation. The table may say yes to other names, so
    whoever asks it has to count exactly afterwards; it never says no to a name that is there.
    """
    place = F.shiftrightunsigned(column, 64 - _FILTER_BITS) + 1
    parts = names.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    )
    out = np.zeros(1 << (_FILTER_BITS - 3), np.uint8)
    for row in parts.collect():
        at = (row["part"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    place = names >> np.uint64(64 - _FILTER_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool) & (names != 0)
