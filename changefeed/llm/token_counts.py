"""Token counts by rank-synchronous merging of ragged arrays.

The pre-tokens of a batch lie one after the other in one array. In each round every pre-token applies its pair of lowest rank at all
its places at once (from the left, without overlap); pre-tokens without a pair leave with the number of symbols they have.

A null text is empty and has no tokens. Special tokens of the file that occur in a text count as one token, as the library does.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from changefeed.llm.arrays import flat_text, sliced
from changefeed.llm.pieces import PairTable, PieceCache, chunks

SLICE_BYTES = 4 << 20


def byte_letters() -> list[str]:
    """The character that stands for each byte in the file: printable Latin-1 itself, the others from 256 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Merges:
    """Merge rules of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, before = whole["model"], whole["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or whole["normalizer"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        ids = model["vocab"]
        self.bytes = np.array([ids[c] for c in byte_letters()], np.int64)
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([ids[rule[side]] for rule in rules]) for side in (0, 1))
        self.pairs = PairTable(left, right, np.arange(len(rules)))
        self.product = np.array([ids[a + b] for a, b in rules])
        specials = sorted((t["content"] for t in whole["added_tokens"]), key=len, reverse=True)
        self.specials = "|".join(map(re.escape, specials))

    def counts(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """One number for each piece, its symbols after all merges (and a 1 for each: the sizes that a piece cache expects)."""
        left_over = np.zeros(len(pieces), np.int64)
        lengths = np.array([len(p) for p in pieces], np.int64)
        symbols = self.bytes[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        ranks = self._ranks(symbols, owner, np.arange(len(symbols)))
        none = int(PairTable.NONE)
        while len(symbols):
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            sizes = np.diff(np.append(heads, len(owner)))
            lowest = np.minimum.reduceat(ranks, heads)
            ended = lowest == none
            left_over[owner[heads[ended]]] = sizes[ended]
            live = np.repeat(~ended, sizes)
            low = np.repeat(lowest, sizes)[live]
            symbols, owner, ranks = symbols[live], owner[live], ranks[live]
            if not len(symbols):
                break
            first = self._apart(ranks == low)
            symbols[first] = self.product[ranks[first]]
            stays = np.ones(len(symbols), bool)
            stays[np.flatnonzero(first) + 1] = False
            changed = first[stays]
            symbols, owner, ranks = symbols[stays], owner[stays], ranks[stays]
            # pairs that hold a new symbol: its own and the one before
            again = np.flatnonzero(changed | np.append(changed[1:], False))
            ranks[again] = self._ranks(symbols, owner, again)
        return left_over, np.ones(len(pieces), np.int64)

    def _ranks(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Rank of the pair that begins at each place, NONE at the end of a piece."""
        after = np.minimum(at + 1, len(symbols) - 1)
        ranks = self.pairs.find(symbols[at], symbols[after])
        ranks[(after == at) | (owner[after] != owner[at])] = PairTable.NONE
        return ranks

    @staticmethod
    def _apart(marked: np.ndarray) -> np.ndarray:
        """Of marked places side by side (a pair of one symbol with itself), every second one from the left."""
        start = marked & ~np.concatenate([[False], marked[:-1]])
        since = np.arange(len(marked)) - np.maximum.accumulate(np.where(start, np.arange(len(marked)), 0))
        return marked & (since % 2 == 0)


class Counter:
    """Number of tokens of each text; keeps the counts of chunks already seen."""

    def __init__(self, path: str, pattern: str):
        self.merges = Merges(path)
        self.cache = PieceCache(pattern, self.merges.counts)

    def count(self, texts: pa.Array) -> np.ndarray:
        specials = np.zeros(len(texts), np.int64)
        owner = np.arange(len(texts))
        if self.merges.specials and pc.any(pc.match_substring_regex(texts, self.merges.specials)).as_py():
            parts = [re.split(self.merges.specials, t or "") for t in texts.to_pylist()]
            specials = np.array([len(p) - 1 for p in parts])
            owner = np.repeat(owner, specials + 1)
            texts = pa.array([t for p in parts for t in p], pa.string())
        found, counts = chunks(*flat_text(texts))
        codes = self.cache.codes(found)
        in_piece = np.concatenate([[0], np.cumsum(self.cache.values)])
        starts = self.cache.starts[codes]
        tokens = in_piece[starts + self.cache.sizes[codes]] - in_piece[starts]
        return np.bincount(np.repeat(owner, counts), tokens, minlength=len(specials)).astype(np.int64) + specials


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, pattern)
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                texts = part.column("text")
                tokens = counter.count(texts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_bytes": pa.array(np.diff(flat_text(texts)[1]), pa.int64()),
                        "n_tokens": pa.array(tokens, pa.int64()),
                        "over_limit": pa.array(tokens > limit),
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
