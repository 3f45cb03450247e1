"""Texts cut into chunks of whole pre-tokens, a cache of the symbols of each chunk, and lookups of symbol pairs."""

from __future__ import annotations

import base64
from collections.abc import Callable
from itertools import chain

import numpy as np
import regex

from changefeed.llm.arrays import ragged

CACHED_CHUNKS = 400_000


# bytes beside a blank at which a text is not cut: white space, and the bytes that white space beyond ASCII begins with
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WHITE_LEADS = np.zeros(256, bool)
_WHITE_LEADS[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where texts may be cut so that no match of the pre-token patterns used here crosses a cut.

    A cut is at the start of a text, and at each single blank between two characters that are not white space; such a blank
    begins a match.
    """
    blanks = np.flatnonzero(data == 0x20)
    blanks = blanks[(blanks > 0) & (blanks < len(data) - 1)]
    after, before = data[blanks + 1], data[blanks - 1]
    cut = ~(_WHITE[after] | _WHITE_LEADS[after] | _WHITE[before])
    for back in (2, 3):  # a lead byte so far before the blank may begin a white character
        cut &= ~((before >= 0x80) & _WHITE_LEADS[data[np.maximum(blanks - back, 0)]])
    start = np.zeros(len(data), bool)
    start[blanks[cut]] = True
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(start)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The chunks of all texts, one after the other, and how many each text has."""
    starts = chunk_starts(data, offsets)
    whole, limits = data.tobytes(), [*starts.tolist(), len(data)]
    return [whole[a:b] for a, b in zip(limits, limits[1:], strict=False)], np.diff(np.searchsorted(starts, offsets))


class PieceCache:
    """Symbols of each chunk of text, from ``encode`` where the chunk is new. A full cache is emptied: it saves time, never a result.

    ``encode`` takes pre-tokens, one after the other, and gives their symbols and how many each has.
    """

    def __init__(self, pattern: str, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], limit: int = CACHED_CHUNKS):
        self.findall, self.encode, self.limit = regex.compile(pattern).findall, encode, limit
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.values, self.starts, self.sizes = (np.zeros(0, np.int64) for _ in range(3))

    def codes(self, found: list[bytes]) -> np.ndarray:
        """The number of each chunk in the cache."""
        if len(self.index) > self.limit:
            self.clear()
        fresh = [c for c in dict.fromkeys(found) if c not in self.index]
        if fresh:
            # chunks are split into pre-tokens, equal ones are encoded once
            split = [*map(self.findall, b"\0".join(fresh).decode().split("\0"))] if b"\0" not in b"".join(fresh) else [
                self.findall(c.decode()) for c in fresh
            ]
            flat = [*chain.from_iterable(split)]
            pieces = dict.fromkeys(flat)
            pieces = dict(zip(pieces, range(len(pieces)), strict=True))
            order = np.fromiter(map(pieces.__getitem__, flat), np.int64, len(flat))
            values, sizes = self.encode([p.encode() for p in pieces])
            starts = np.cumsum(sizes) - sizes
            each = sizes[order]
            values = values[np.repeat(starts[order], each) + ragged(each)]
            sizes = np.bincount(np.repeat(np.arange(len(split)), [*map(len, split)]), each, len(split)).astype(np.int64)
            self.starts = np.concatenate([self.starts, len(self.values) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.values = np.concatenate([self.values, values])
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh)), strict=True))
        return np.fromiter(map(self.index.__getitem__, found), np.int64, len(found))

    def symbols(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the chunks with these numbers, one after the other, and how many each has."""
        sizes = self.sizes[codes]
        return self.values[np.repeat(self.starts[codes], sizes) + ragged(sizes)], sizes


class PairTable:
    """Open-addressing table from a pair of symbols to a number, looked up for whole arrays."""

    NONE = np.int32(np.iinfo(np.int32).max)

    def __init__(self, left: np.ndarray, right: np.ndarray, value: np.ndarray):
        keys = self._keys(left, right)
        bits = max(4, int(len(keys) * 3).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, self.NONE, np.int32)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] < 0]
            self.keys[slots[free]] = keys[free]  # of several keys for a slot the last stays
            done = self.keys[slots[todo]] == keys[todo]
            self.values[slots[todo[done]]] = value[todo[done]]
            todo = todo[~done]
            slots[todo] = (slots[todo] + 1) & self.mask

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The number of each pair, or NONE. Symbols below zero are in no pair."""
        keys = self._keys(left, right)
        out = np.full(len(keys), self.NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        slots = self._slots(keys[todo])
        while len(todo):
            there = self.keys[slots]
            hit = there == keys[todo]
            out[todo[hit]] = self.values[slots[hit]]
            on = ~hit & (there >= 0)
            todo, slots = todo[on], (slots[on] + 1) & self.mask
        return out


def rank_file(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token, rank), by rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks[i] for i in range(len(ranks))]
