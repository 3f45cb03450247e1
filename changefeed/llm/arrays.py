"""Texts of an Arrow batch as flat numpy arrays: bytes, word spans and hashes, in slices of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 20

# white space of the word rule [^\x20\x09-\x0D]+
BLANK = np.zeros(256, bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2^64


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows, one after the other, and the row limits in them. A null row is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def sliced(batch: pa.RecordBatch, column: str = "text", budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``budget`` bytes of text; a longer row is a part of its own."""
    if not batch.num_rows:
        return
    _, offsets = flat_text(batch.column(column))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + budget, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


PRIME = np.uint64((1 << 61) - 1)
_SPAN_BASES = (0x0E9D5A1C3B7F2468, 0x13C6EF372FE94F82)  # below PRIME
_LOW32, _LOW31, _LOW30, _LOW29 = (np.uint64((1 << n) - 1) for n in (32, 31, 30, 29))


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def _product(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a b modulo PRIME for numbers below it, from halves of 32 bits: 2^61 is 1, so 2^64 is 8."""
    half = np.uint64(32)
    a1, a0, b1, b0 = a >> half, a & _LOW32, b >> half, b & _LOW32
    middle, low = a1 * b0 + a0 * b1, a0 * b0
    high = (a1 * b1 << np.uint64(3)) + (middle >> np.uint64(29)) + ((middle & _LOW29) << half)
    return _reduced(high + (low & PRIME) + (low >> np.uint64(61)))


class Spans:
    """Hashes of any spans of a sequence of numbers, from one prefix sum modulo a prime: equal spans have equal hashes wherever they lie.

    Modulo a power of two, some pairs of sequences of a thousand symbols have equal sums for every odd base; modulo a prime two sequences of n
    symbols agree for at most n bases.
    """

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, values: np.ndarray, lane: int = 0):
        base = _SPAN_BASES[lane]
        self.down = self._table(pow(base, -1, int(PRIME)), len(values) + 1)
        terms = _product(_reduced(values.astype(np.uint64)), self._table(base, len(values) + 1)[: len(values)])
        # sums of halves of 30 and 31 bits do not overflow
        high, low = _reduced(np.cumsum(terms >> np.uint64(31))), _reduced(np.cumsum(terms & _LOW31))
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        self.prefix[1:] = _reduced(((high & _LOW30) << np.uint64(31)) + (high >> np.uint64(30)) + low)

    @classmethod
    def _table(cls, base: int, size: int) -> np.ndarray:
        """Powers of base."""
        powers = cls._powers.get(base, np.ones(1, np.uint64))
        while len(powers) < size:
            powers = np.concatenate([powers, _product(powers, np.uint64(pow(base, len(powers), int(PRIME))))])
        cls._powers[base] = powers
        return powers

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = _product(_reduced(self.prefix[ends] + PRIME - self.prefix[starts]), self.down[starts])
        return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(BASES[1]))


class Rolling:
    """Hashes of any spans of a sequence of bytes, from one prefix sum modulo 2^64: for estimates, as unlike spans made for it can collide (see ``Spans``)."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, lane: int = 0):
        base = BASES[lane]
        self.up, self.down = self._table(base, len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values.astype(np.uint64) * self.up[: len(values)], out=self.prefix[1:])

    @classmethod
    def _table(cls, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in cls._powers or len(cls._powers[base][0]) < size:
            inverse = pow(base, -1, 1 << 64)
            cls._powers[base] = tuple(
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))]) for b in (base, inverse)
            )
        return cls._powers[base]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        return mix((self.prefix[ends] - self.prefix[starts]) * self.down[starts] + length * np.uint64(BASES[1]))


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and for each row the range of its words (limits, one more than rows).

    ``between`` marks the bytes that are not part of a word.
    """
    blank = between[data]
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & (before | border[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (after | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


LONG_WORD = 256  # bytes


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A 64-bit number for each word, equal for equal words: eight bytes at a time are mixed in, in order, so that no sum of bytes can cancel out."""
    lengths = ends - starts
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(9, np.uint8)]).tobytes(), 0, (1,))  # the eight bytes from each place on
    hashes = mix(lengths.astype(np.uint64) * np.uint64(BASES[1 - lane]) + np.uint64(BASES[lane]))
    short = np.flatnonzero(lengths <= LONG_WORD)
    for done in range(0, LONG_WORD, 8):
        short = short[lengths[short] > done] if done else short[lengths[short] > 0]
        if not len(short):
            break
        left = np.minimum(lengths[short] - done, 8).astype(np.uint64)
        chunk = eight[starts[short] + done] << (np.uint64(64) - left * np.uint64(8))  # what follows the word falls out
        hashes[short] = mix((hashes[short] ^ mix(chunk + np.uint64(BASES[lane]))) * np.uint64(BASES[1 - lane]) + np.uint64(done + 1))
    whole = memoryview(data)
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        hashes[i] = xxhash.xxh64_intdigest(whole[starts[i] : ends[i]], seed=lane)
    return hashes


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..n-1 for each n of ``counts``, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
