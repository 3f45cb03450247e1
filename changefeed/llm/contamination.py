"""Benchmark decontamination: short test items found inside long documents by MinHash containment search.

An item is the set of its shingles of five words (lower case, letters and digits; a shorter item is one shingle of all its words). Its MinHash
signature is the smallest of its shingle hashes, as many as make certain that a document with at least the wanted share of the item's
shingles has one of them: for n shingles of which m must be there, the n - m + 1 smallest. An item's size fixes the length of its signature, the size
of its shingles and the least size of a document that can hold it. Documents are searched for signatures alone; only candidates are verified, by exact
containment of the item's shingles.

A null or empty text has no shingles: such an item is never found, such a document holds none. Documents of equal text are searched once.
Equal items are found in the same documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.llm.arrays import Spans, flat_text, sliced, word_hashes, word_spans
from changefeed.operators.skew import broadcast_if_small
from changefeed.session import written

SHINGLE = 5
CONTAINMENT = 0.8
FILTER_BITS = 23  # a filter of one megabyte, however many items there are

BETWEEN = np.ones(256, bool)
BETWEEN[range(0x61, 0x7B)] = False
BETWEEN[range(0x30, 0x3A)] = False
BETWEEN[range(0x80, 0x100)] = False


def shingles(texts: pa.Array, sizes: list[int]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: (size, row, hash) of the runs of so many words, row by row."""
    data, offsets = flat_text(pc.utf8_lower(texts))
    starts, ends, limits = word_spans(data, offsets, BETWEEN)
    rolling = Spans(word_hashes(data, starts, ends))
    out = []
    for size in sizes:
        counts = np.maximum(np.diff(limits) - size + 1, 0)
        row = np.repeat(np.arange(len(counts)), counts)
        first = limits[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        out.append((size, row, rolling.spans(first, first + size).view(np.int64)))
    return out


def signatures(items: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """Per distinct shingle of an item: item_id, words, hash, n, need (shingles that must be there), signed (in the signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                ids = part.column("item_id").to_pylist()
                found = shingles(part.column("text"), [*range(SHINGLE, 0, -1)])
                words = np.bincount(found[-1][1], minlength=len(ids))
                rows = []
                for size, row, hashes in found:
                    for i in np.flatnonzero(np.minimum(words, SHINGLE) == size):
                        own = np.unique(hashes[np.searchsorted(row, i) : np.searchsorted(row, i, "right")].view(np.uint64))
                        n = len(own)
                        need = max(1, int(np.ceil(share * n - 1e-9)))
                        rows += [(ids[i], size, int(h), n, need, k <= n - need) for k, h in enumerate(own.view(np.int64))]
                columns = [*zip(*rows, strict=True)] or [()] * 6
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                names = ["item_id", "words", "hash", "n", "need", "signed"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    schema = "item_id bigint, words int, hash bigint, n int, need int, signed boolean"
    return items.select("item_id", "text").mapInArrow(run, schema)


def hash_filter(values: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bit for each value of ``hash`` cut to so many bits: at most 2^(bits - 6) numbers come to the driver."""
    word = F.shiftrightunsigned("hash", 64 - bits + 6)
    bit = F.shiftrightunsigned("hash", 64 - bits).bitwiseAND(63).cast("int")
    marks = values.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("bit"))
    rows = marks.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in rows.collect():
        out[r.word] = r.bits
    return out.view(np.uint64)


def _holding(marks: np.ndarray, sizes: list[int]):
    """A function from batches (k1, k2, text) to the distinct shingles of each text that may be among those of a filter: k1, k2, words, hash, doc_shingles."""
    shift = np.uint64(64 - FILTER_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                for size, row, hashes in shingles(part.column("text"), sizes):
                    place = hashes.view(np.uint64) >> shift
                    hit = np.flatnonzero((marks[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1))
                    if len(hit):
                        total = np.bincount(row, minlength=part.num_rows)
                        own = pd.DataFrame({"row": row[hit], "hash": hashes[hit]}).drop_duplicates()
                        at = pa.array(own["row"].to_numpy())
                        yield pa.RecordBatch.from_arrays(
                            [part.column("k1").take(at), part.column("k2").take(at), pa.array(np.full(len(own), size, np.int32)),
                             pa.array(own["hash"].to_numpy()), pa.array(total[own["row"]].astype(np.int64))],
                            ["k1", "k2", "words", "hash", "doc_shingles"],
                        )

    return run


def contained(docs: DataFrame, items: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """Which texts hold which items: text_key (struct of two hashes of the text), item_id, n_shingles, n_found.

    ``docs`` has ``text``, ``items`` item_id and text. First the signatures alone are looked for: a text with one shingle of an item's signature, and with as many shingles
    as the item needs, is a candidate. Then the shingles of candidates are compared with all of their items, and counted.
    """
    known = written(signatures(items, share), "items")
    sizes = sorted(r.words for r in known.select("words").distinct().collect())  # at most SHINGLE numbers
    schema = "k1 bigint, k2 bigint, words int, hash bigint, doc_shingles bigint"
    keyed = docs.select("text", text_key().getField("k1").alias("k1"), text_key().getField("k2").alias("k2"))
    signed = known.where("signed")
    met = keyed.mapInArrow(_holding(hash_filter(signed), sizes), schema).join(broadcast_if_small(signed), ["words", "hash"])
    candidates = written(met.where("doc_shingles >= need").select("k1", "k2", "item_id").distinct(), "candidates")
    texts = keyed.join(broadcast_if_small(candidates.select("k1", "k2").distinct()), ["k1", "k2"], "left_semi")
    found = texts.mapInArrow(_holding(hash_filter(known), sizes), schema).dropDuplicates(["k1", "k2", "words", "hash"])
    return (
        found.join(broadcast_if_small(known), ["words", "hash"]).join(broadcast_if_small(candidates), ["k1", "k2", "item_id"], "left_semi")
        .groupBy("k1", "k2", "item_id").agg(F.first("n").alias("n_shingles"), F.first("need").alias("need"), F.count("*").alias("n_found"))
        .where("n_found >= need")
        .select(F.struct("k1", "k2").alias("text_key"), "item_id", "n_shingles", "n_found")
    )


def text_key():
    """Two independent hashes of ``text``; a null text has the key of an empty one."""
    text = F.coalesce("text", F.lit(""))
    return F.struct(F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def leaks(docs: DataFrame, items: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """Per document and item found in it: doc_id, item_id, n_shingles, n_found, containment. Repeated rows of a document give one row."""
    found = contained(docs, items, share)
    return (
        docs.select("doc_id", text_key().alias("text_key")).distinct().join(found, "text_key")
        .select("doc_id", "item_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), "n_found",
                (F.col("n_found") / F.col("n_shingles")).alias("containment"))
        .distinct()
    )


def without_leaks(docs: DataFrame, items: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, with the columns of ``docs``."""
    found = written(contained(docs, items, share).select("text_key").distinct(), "leaked")
    # the caller's columns are in one struct, so that no name of theirs is taken for one of these
    keyed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), text_key().alias("text_key"))
    return keyed.join(broadcast_if_small(found), "text_key", "left_anti").select("own.*")
