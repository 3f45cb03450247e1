"""Recompression of word sequences: rounds that replace runs and pairs by new symbols, alike wherever the words are alike.

Names are 64-bit hashes of what a symbol stands for, so they are the same in every document and task without an exchange. In a run round each
maximal run of one symbol becomes a symbol. In a pair round the symbols of a level are split in two by a bit of their names, and each
first-kind symbol followed by one of the second kind forms a pair with it. Whether a symbol comes about depends on few words around it;
these are tracked for each symbol (its context), so it is known which symbols any other occurrence of a stretch of words must have.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from changefeed.llm.arrays import mix

ROUNDS = "rprpp"  # r: runs, p: pairs
LONGEST = 10  # words of a symbol that takes part in a round
_ODD = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))


@dataclass
class Symbols:
    """Symbols of one level in order: name, words [start, end), context [low, high) in words, and the row they are in."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    row: np.ndarray


def words_level(names: np.ndarray, limits: np.ndarray) -> Symbols:
    at = np.arange(len(names))
    return Symbols(names, at, at + 1, at.copy(), at + 1, np.repeat(np.arange(len(limits) - 1), np.diff(limits)))


def _edges(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """Whether a symbol is the first, the last of its row."""
    change = s.row[1:] != s.row[:-1]
    return np.concatenate([[True], change]), np.concatenate([change, [True]])


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    """The value of the neighbour; at the ends of the array the own."""
    return np.concatenate([x[:1], x[:-1]]) if by < 0 else np.concatenate([x[1:], x[-1:]])


def _joined(s: Symbols, head: np.ndarray, name: np.ndarray, low: np.ndarray, high: np.ndarray) -> Symbols:
    """Symbols from groups that begin at ``head``; names are given for the heads."""
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(head)) - 1
    return Symbols(name[at], s.start[at], s.end[last], np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), s.row[at])


def run_round(s: Symbols, longest: int) -> Symbols:
    """Maximal runs become symbols. A symbol's fate depends on both neighbours, if it is short enough to take part."""
    first, last = _edges(s)
    free = s.end - s.start <= longest
    before, after = s.name == _shift(s.name, -1), s.name == _shift(s.name, 1)
    # beyond the ends of a row nothing is known: no window reaches there
    low = np.where(free, np.where(first, s.low - 1, np.minimum(s.low, _shift(s.low, -1))), s.low)
    high = np.where(free, np.where(last, s.high + 1, np.maximum(s.high, _shift(s.high, 1))), s.high)
    low = np.where(free & ~last, np.minimum(low, _shift(s.low, 1)), low)
    high = np.where(free & ~first, np.maximum(high, _shift(s.high, -1)), high)
    head = ~(before & free & ~first)
    at = np.flatnonzero(head)
    length = np.diff(np.append(at, len(head)))
    name = s.name.copy()
    name[at] = np.where(length > 1, mix(s.name[at] * _ODD[0] + length.astype(np.uint64)), s.name[at])
    return _joined(s, head, name, low, high)


def pair_round(s: Symbols, longest: int, number: int) -> Symbols:
    """First-kind symbols join a second-kind one after them. A symbol's fate depends on one neighbour only."""
    first, last = _edges(s)
    free = s.end - s.start <= longest
    second = (mix(s.name + np.full(1, number, np.uint64) * _ODD[1]) >> np.uint64(63)).astype(bool)
    opens, closes = free & ~second, free & second
    low, high = s.low.copy(), s.high.copy()
    for who, edge, by in ((opens, last, 1), (closes, first, -1)):
        beside_low, beside_high = _shift(s.low, by), _shift(s.high, by)
        low = np.where(who, np.where(edge, s.low - (by < 0), np.minimum(s.low, beside_low)), low)
        high = np.where(who, np.where(edge, s.high + (by > 0), np.maximum(s.high, beside_high)), high)
    joins = opens & ~last & _shift(closes, 1)
    name = np.where(joins, mix(s.name * _ODD[0] + _shift(s.name, 1) * _ODD[1]), s.name)
    return _joined(s, np.concatenate([[True], ~joins[:-1]]), name, low, high)


def recompress(names: np.ndarray, limits: np.ndarray, rounds: str = ROUNDS, longest: int = LONGEST) -> Symbols:
    """Symbols after all rounds over rows of word names; row i has the words limits[i] to limits[i + 1]."""
    s = words_level(names, limits)
    if len(names):
        for number, kind in enumerate(rounds):
            s = run_round(s, longest) if kind == "r" else pair_round(s, longest, number)
    return s
