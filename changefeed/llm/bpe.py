"""Byte-level BPE encoding and decoding on padded numpy matrices.

Pre-tokens of similar length are the rows of one matrix. In each round every row merges its leftmost pair of minimum rank, found
by hashed lookups of pairs; a merged row loses one column, rows without a pair leave the matrix. A piece that is a token itself
is that token.

A null text is empty; an empty text has no ids. Rows are independent: ties and repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.llm.arrays import flat_text, ragged, sliced
from changefeed.llm.pieces import PairTable, PieceCache, chunks, rank_file

SLICE_BYTES = 4 << 20
CELLS = 2 << 20  # of one matrix


class Vocabulary:
    """Ranks of a tiktoken file: the id of a token is its rank."""

    def __init__(self, path: str):
        self.tokens = rank_file(path)
        self.ids = {token: i for i, token in enumerate(self.tokens)}
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (a, b, rank)
            for token, rank in self.ids.items()
            for cut in range(1, len(token))
            if (a := self.ids.get(token[:cut])) is not None and (b := self.ids.get(token[cut:])) is not None
        ]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.sizes = np.array([len(t) for t in self.tokens])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        sizes = np.array([len(p) for p in pieces])
        whole = np.array([self.ids.get(p, -1) for p in pieces])
        known = np.flatnonzero(whole >= 0)
        rows, ids = [known], [whole[known]]
        todo = np.flatnonzero(whole < 0)
        todo = todo[np.argsort(sizes[todo], kind="stable")]
        while len(todo):
            # a bucket: lengths within a quarter of the shortest, and a bounded number of cells
            width = int(sizes[todo[0]] * 5 // 4) + 1
            many = min(int(np.searchsorted(sizes[todo], width, "right")), max(1, CELLS // width))
            bucket, todo = todo[:many], todo[many:]
            width = int(sizes[bucket[-1]])
            matrix = np.full((many, width), -1, np.int32)
            data = np.frombuffer(b"".join(pieces[i] for i in bucket), np.uint8)
            matrix[np.arange(width) < sizes[bucket][:, None]] = self.bytes[data]
            for row, values in self._merged(matrix):
                rows.append(bucket[row])
                ids.append(values)
        at, values = np.concatenate(rows), np.concatenate(ids)
        order = np.argsort(at, kind="stable")
        return values[order].astype(np.int64), np.bincount(at, minlength=len(pieces))

    def _merged(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row number and id, in order within a row, for rows as they come to an end."""
        find = self.pairs.find
        row = np.arange(len(ids))
        ranks = find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(ids):
            each = np.arange(len(ids))
            best = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            rank = ranks[each, best] if ranks.shape[1] else np.full(len(ids), PairTable.NONE)
            ended = rank == PairTable.NONE
            if ended.any():
                there = ids[ended] >= 0
                yield np.repeat(row[ended], there.sum(1)), ids[ended][there]
                ids, ranks, row, best, rank = (x[~ended] for x in (ids, ranks, row, best, rank))
                each = np.arange(len(ids))
                if not len(ids):
                    return
            ids[each, best] = rank
            stays = np.ones(ids.shape, bool)
            stays[each, best + 1] = False
            ids = ids[stays].reshape(len(ids), -1)
            stays = np.ones(ranks.shape, bool)
            stays[each, best] = False
            ranks = ranks[stays].reshape(len(ids), -1)
            last = ranks.shape[1]
            for at in (best - 1, best):  # the two pairs that the new symbol is in
                own = np.flatnonzero((at >= 0) & (at < last))
                ranks[own, at[own]] = find(ids[own, at[own]], ids[own, at[own] + 1])

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        return self.flat[np.repeat(self.starts[ids], sizes) + ragged(sizes)].tobytes()


class Codec:
    """Texts to ids and back; keeps the ids of chunks already seen."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.cache = PieceCache(pattern, self.vocabulary.encode)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        found, counts = chunks(*flat_text(texts))
        ids, sizes = self.cache.symbols(self.cache.codes(found))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return np.split(ids, ends[:-1])


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` in a column ``ids`` (array<int>), which replaces one of that name."""
    schema = docs.drop(ids).withColumn(ids, F.expr("cast(null as array<int>)")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            for part in sliced(batch, text, SLICE_BYTES):
                lists = codec.encode(part.column(text))
                sizes = np.array([0, *map(len, lists)], np.int64)
                flat = np.concatenate([*lists, np.zeros(0)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.array(flat))
                kept = [n for n in part.schema.names if n != ids]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), column], names=[*kept, ids])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256 (little-endian unsigned 32-bit ids), decoded_sha256 (bytes of the decoded ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, pattern)
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                lists = codec.encode(part.column("text"))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_tokens": pa.array([len(x) for x in lists], pa.int64()),
                        "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in lists],
                        "decoded_sha256": [hashlib.sha256(codec.vocabulary.decode(x)).hexdigest() for x in lists],
                    }
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )
