"""Substring dedup by recompression: words in windows that occur elsewhere are removed.

Each document is recompressed (see ``recompression``): symbols have the same names everywhere and known contexts. Each window of WINDOW words
is given to one of the symbols whose context lies within it, the one with the smallest hash of that context, so equal windows are given to equal
symbols at the same offset. A symbol whose context occurs once in the corpus rules out all its windows. Where all occurrences of a symbol
have the same stretch of windows around it (equal 64-bit hashes of context and of stretch), all these windows repeat. Only where stretches differ,
at the ends of repeats, are windows compared one by one, by 128 bits, once for each different stretch. Windows without such a symbol
(long runs of one word) are compared by their own hashes.

Counts and joins go through Spark by symbol, so no group of copies meets in one task and none is expanded into pairs.

A null text has no words; a text shorter than the window is kept whole. Repeated rows are documents of their own, and repeat each other; rows
with equal doc_id and text share one result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.llm.arrays import Spans, flat_text, ragged, sliced, word_hashes, word_spans
from changefeed.llm.recompression import recompress
from changefeed.session import written

WINDOW = 35
_ALONE = np.uint64(0x5851F42D4C957F2D)  # sets the keys of windows without a symbol apart


def stretches(names: np.ndarray, names2: np.ndarray, limits: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(row, first window, number of windows, key, content) of stretches that together hold every window of every row once.

    Equal windows are in stretches of equal key, at the same distance from the symbol.
    """
    s = recompress(names, limits)
    rolling, rolling2 = Spans(names), Spans(names2, 1)
    first, last = limits[s.row], limits[s.row + 1] - window  # of the windows of a symbol's row
    low, high = np.maximum(s.high - window, first), np.minimum(s.low, last)
    there = np.flatnonzero((low <= high) & (s.low >= first) & (s.high <= limits[s.row + 1]))
    low, high = low[there], high[there]
    key = rolling.spans(s.low[there], s.high[there])
    # the smallest key among the symbols of each window
    counts = high - low + 1
    at, who = np.repeat(low, counts) + ragged(counts), np.repeat(np.arange(len(there)), counts)
    best = np.full(len(names) + 1, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(best, at, key[who])
    mine = best[at] == key[who]
    at, who = at[mine], who[mine]
    order = np.argsort(at, kind="stable")
    at, who = at[order], who[order]
    single = np.ones(len(at), bool)
    single[1:] = at[1:] != at[:-1]  # of two symbols with one key in a window, the first
    at, who = at[single], who[single]
    head = np.ones(len(at), bool)
    head[1:] = (who[1:] != who[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(head)
    begin, number, key = at[heads], np.diff(np.append(heads, len(at))), key[who[heads]]
    # windows without a symbol; side by side and equal they are one stretch
    free = np.ones(len(names) + 1, bool)
    free[at] = False
    row = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    place = np.arange(len(names))
    free = place[free[:-1] & (place + window <= limits[row + 1])]
    own = rolling.spans(free, free + window)
    head = np.ones(len(free), bool)
    head[1:] = (own[1:] != own[:-1]) | (free[1:] != free[:-1] + 1)
    heads = np.flatnonzero(head)
    alone, many = free[heads], np.diff(np.append(heads, len(free)))
    content = np.concatenate([rolling2.spans(begin, begin + number - 1 + window), rolling2.spans(alone, alone + window)])
    begin, key = np.concatenate([begin, alone]), np.concatenate([key, own[heads] ^ _ALONE])
    weight = np.concatenate([np.ones(len(number), np.int64), many])
    return row[begin], begin, np.concatenate([number, many]), key, content, weight


def _tagged(docs: DataFrame) -> DataFrame:
    """doc and tag name a document: its id, and a hash of 64 bits of its text for the case that an id is used again."""
    return docs.select(
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "doc_id", "text"
    )


def _words(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = flat_text(part.column("text"))
    starts, ends, limits = word_spans(data, offsets)
    return word_hashes(data, starts, ends), word_hashes(data, starts, ends, 1), limits


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], [*columns])


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, tag, first, number: stretches of windows that occur elsewhere too (first word of the first window, counted from 0 in the document)."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                names, names2, limits = _words(part)
                row, begin, number, key, content, weight = stretches(names, names2, limits, window)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc").take(at), part.column("tag").take(at), pa.array((begin - limits[row]).astype(np.int32)),
                     pa.array(number.astype(np.int32)), pa.array(weight.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))],
                    ["doc", "tag", "first", "number", "weight", "key", "content"],
                )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the windows of the stretches wanted of a document."""
        for batch in batches:
            for part in sliced(batch):
                names, names2, limits = _words(part)
                lists = part.column("wanted")
                sizes = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                first, number = (flat.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("first", "number"))
                begin = first + np.repeat(limits[:-1], sizes)
                at, offset = np.repeat(begin, number) + ragged(number), ragged(number)
                who = np.repeat(np.arange(len(number)), number)
                fields = {f: flat.field(f).to_numpy(zero_copy_only=False)[who] for f in ("key", "content", "weight")}
                one, two = Spans(names).spans(at, at + window), Spans(names2, 1).spans(at, at + window)
                yield _batch(**fields, offset=offset.astype(np.int32), one=one.view(np.int64), two=two.view(np.int64))

    tagged = _tagged(docs)
    every = written(tagged.mapInArrow(parse, "doc bigint, tag bigint, first int, number int, weight int, key bigint, content bigint"), "stretches")
    # what is summed up by key or window is written before it is joined: the join then stands alone in its stage, where a hot key's rows can be split
    keys = every.groupBy("key").agg(F.sum("weight").alias("times"), (F.min("content") == F.max("content")).alias("alike"))
    found = written(every.join(written(keys.where("times > 1").drop("times"), "repeated-keys"), "key"), "repeated")
    # one document for each different stretch gives its windows
    kinds = found.where("not alike").groupBy("key", "content").agg(F.sum("weight").alias("weight"), F.min(F.struct("doc", "tag", "first", "number")).alias("at"))
    wanted = kinds.groupBy("at.doc", "at.tag").agg(F.collect_list(F.struct("at.first", "at.number", "key", "content", "weight")).alias("wanted"))
    # (a row that is there twice gives them twice, with the same weight: duplicates go)
    unlike = written(
        tagged.join(wanted, ["doc", "tag"]).select("text", "wanted")
        .mapInArrow(windows, "key bigint, content bigint, weight bigint, offset int, one bigint, two bigint").distinct(),
        "windows",
    )
    again = written(unlike.groupBy("key", "one", "two").agg(F.sum("weight").alias("times")).where("times > 1").drop("times"), "windows-again")
    offsets = written(unlike.join(again, ["key", "one", "two"]).groupBy("key", "content").agg(F.collect_set("offset").alias("offsets")), "offsets")
    whole = found.where("alike").select("doc", "tag", "first", "number")
    some = found.where("not alike").join(offsets, ["key", "content"]).select("doc", "tag", "first", F.explode("offsets").alias("offset"))
    return whole.unionByName(some.select("doc", "tag", (F.col("first") + F.col("offset")).alias("first"), F.lit(1).alias("number")))


def removed(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, kept (the words that stay, joined by a space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                words = [(t or "").encode().split() for t in part.column("text").to_pylist()]
                lists = part.column("ranges")
                n, gone, digests, texts = [], [], [], []
                for i, own in enumerate(words):
                    ranges = lists[i]
                    if ranges.is_valid and own:
                        first, number = (ranges.values.field(f).to_numpy(zero_copy_only=False).astype(np.int64) for f in ("first", "number"))
                        step = np.zeros(len(own) + 1, np.int64)
                        np.add.at(step, first, 1)
                        np.add.at(step, first + number - 1 + window, -1)
                        kept = np.cumsum(step[:-1]) == 0
                        rest = [*compress(own, kept.tolist())]
                    else:
                        rest = own
                    whole = b" ".join(rest)
                    n.append(len(own))
                    gone.append(len(own) - len(rest))
                    digests.append(hashlib.sha256(whole).hexdigest())
                    texts.append(whole.decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
                )

    ranges = repeats(docs, window).groupBy("doc", "tag").agg(F.collect_list(F.struct("first", "number")).alias("ranges"))
    both = _tagged(docs).join(ranges, ["doc", "tag"], "left").select("doc_id", "text", "ranges")
    return both.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept string")
