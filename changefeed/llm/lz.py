"""Lempel-Ziv phrase fingerprints: likeness of texts as a compressor sees it.

A text is parsed into dictionary phrases: each phrase is the shortest stretch of UTF-8 bytes from where the last one ended that is not in the
text's own dictionary yet, and then joins it. The set of phrases is hashed; in each of ``SLOTS`` slots of the hash space the smallest hash
is kept as 16 bits (0: no phrase there). The likeness of two fingerprints is the share of equal slots among those filled in
either, an estimate of the overlap of the two phrase sets.

A null text is empty; an empty text has no phrases, and two empty texts are alike (1.0). Equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.llm.arrays import Rolling

SLOTS = 128
SLICE_CHARS = 1 << 20
LEAST = -(1 << 63)


def phrases(data: bytes, known: list[bytes] = (), start: int = 0) -> tuple[list[bytes], list[int]]:
    """Phrases of ``data`` from ``start`` on, given the phrases before it, and where each one ends.

    All prefixes of a phrase are phrases, so the search for the shortest new one may begin in the middle.
    """
    seen, found, ends = set(known), [], []
    size = len(data)
    while start < size:
        end = start + 3
        if data[start:end] in seen:
            end += 1
            while end <= size and data[start:end] in seen:
                end += 1
        elif data[start : end - 1] not in seen:
            end -= 1 if data[start : end - 2] in seen else 2
        phrase = data[start:end]
        seen.add(phrase)
        start = min(end, size)
        found.append(phrase)
        ends.append(start)
    return found, ends


def signatures(hashes: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """Row by slot: 16 bits of the smallest hash of the row's phrases in that slot, 0 where there is none."""
    out = np.zeros((rows, SLOTS), np.uint16)
    slot = owner.astype(np.uint64) * np.uint64(SLOTS) + hashes % np.uint64(SLOTS)
    ranked = np.sort((slot << np.uint64(32)) | (hashes >> np.uint64(32)))
    at, low = (ranked >> np.uint64(32)).astype(np.int64), ranked & np.uint64(0xFFFFFFFF)
    first = np.diff(at, prepend=-1) != 0
    out.reshape(-1)[at[first]] = low[first] % np.uint64(65535) + np.uint64(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of the fingerprints in the rows of two matrices."""
    filled = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def phrase_hashes(found: list[bytes]) -> np.ndarray:
    if not found:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([*map(len, found)])
    data = np.frombuffer(b"".join(found), np.uint8).astype(np.uint64) + np.uint64(1)
    return Rolling(data).spans(np.concatenate([[0], ends[:-1]]), ends)


def hexadecimal(matrix: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in matrix]


def fingerprint_texts(texts: list[str]) -> np.ndarray:
    own = [phrases(t.encode())[0] for t in texts]
    owner = np.repeat(np.arange(len(own)), [*map(len, own)])
    return signatures(phrase_hashes([p for ps in own for p in ps]), owner, len(texts))


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` (hexadecimal) in a column ``name``, which replaces one of that name."""
    schema = docs.drop(name).withColumn(name, F.lit("")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            values = [t if t is not None else "" for t in frame[text]]
            out: list[str] = []
            for part in parts(values):
                out += hexadecimal(fingerprint_texts(values[part]))
            yield frame.drop(columns=name, errors="ignore").assign(**{name: out})

    return docs.mapInPandas(run, schema)


def parts(texts: list[str]) -> Iterator[slice]:
    """Slices of rows with about SLICE_CHARS characters."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS or i == len(texts) - 1:
            yield slice(first, i + 1)
            first, size = i + 1, 0


def beside_next(docs: DataFrame, partitions: int) -> DataFrame:
    """Rows (doc_id, text) so dealt out that each partition's groups hold consecutive documents and, last and marked as ``guest``, the one that follows.

    Groups are ranges of doc_id with about as many rows each; only their limits (``partitions`` numbers) are gathered.
    """
    keyed = docs.select("doc_id", "text").withColumn("_key", F.coalesce("doc_id", F.lit(LEAST)).cast("double"))
    at = [(i + 1) / partitions for i in range(partitions - 1)]
    cuts = keyed.agg(F.percentile_approx("_key", at or [0.5], 10 * partitions)).first()[0] or []
    splits = [-float("inf"), *(sorted(set(cuts)) or [0.0]), float("inf")]
    keyed = Bucketizer(splits=splits, inputCol="_key", outputCol="_group").transform(keyed)
    keyed = keyed.withColumn("_group", F.col("_group").cast("int"))
    order = F.coalesce("doc_id", F.lit(LEAST))
    heads = sorted(tuple(r) for r in keyed.groupBy("_group").agg(F.min(order)).collect())
    guests = [(first, heads[i - 1][0]) for i, (_, first) in enumerate(heads)]
    rows = keyed.sparkSession.createDataFrame(guests or [(0, 0)], "_first bigint, _before int")
    # at most one row for each partition
    keyed = keyed.join(F.broadcast(rows), order == F.col("_first"), "left")
    return (
        keyed.withColumn("_to", F.explode(F.array_compact(F.array(_place("_group", False), _place("_before", True)))))
        .select("doc_id", "text", F.col("_to.at").alias("_group"), F.col("_to.guest").alias("_guest"))
        .repartition(partitions, "_group")
        .sortWithinPartitions("_group", "_guest", F.asc_nulls_first("doc_id"), F.asc_nulls_first("text"))
    )


def _place(group: str, guest: bool) -> Column:
    return F.when(F.col(group).isNotNull(), F.struct(F.col(group).alias("at"), F.lit(guest).alias("guest")))


def edited(text: str, following: str) -> str:
    """``text`` with its last half (rounded down) replaced by the first as many characters, or all, of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited form, and their likeness; see ``edited``. Of rows with one doc_id the order is that of the texts.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            held = frame.tail(1)
            for part in parts([t or "" for t in frame["text"]]):
                # with the row after the part, if it has come
                yield compared(frame.iloc[part.start : part.stop + 1])

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [t if t is not None else "" for t in frame["text"]]
        groups, guest = frame["_group"].to_numpy(), frame["_guest"].to_numpy(bool)
        pairs = np.flatnonzero(~guest[:-1] & (groups[:-1] == groups[1:]))
        own, tails, n_shared, digests = [], [], [], []
        for t in texts:
            own.append(phrases(t.encode()))
        for i in pairs:
            text, changed = texts[i], edited(texts[i], texts[i + 1]).encode()
            kept = len(text[: len(text) - len(text) // 2].encode())
            found, ends = own[i]
            shared = bisect_right(ends, kept)
            # the phrases that end before the edit are those of the edited text as well
            tails.append(phrases(changed, found[:shared], ends[shared - 1] if shared else 0)[0])
            n_shared.append(shared)
            digests.append(hashlib.sha256(changed).hexdigest())
        sizes = np.array([len(found) for found, _ in own])
        hashes = phrase_hashes([p for found, _ in own for p in found])
        starts = np.cumsum(sizes) - sizes
        plain = signatures(hashes, np.repeat(np.arange(len(own)), sizes), len(own))
        changed_hashes = [hashes[starts[i] : starts[i] + k] for i, k in zip(pairs, n_shared, strict=True)]
        changed_hashes += [phrase_hashes([p for t in tails for p in t])]
        owner = np.concatenate([np.repeat(np.arange(len(pairs)), n_shared), np.repeat(np.arange(len(pairs)), [*map(len, tails)])])
        changed = signatures(np.concatenate(changed_hashes), owner.astype(np.int64), len(pairs))
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"].iloc[pairs].astype("Int64"),
                "n_chars": [len(texts[i]) for i in pairs],
                "edited_sha256": digests,
                "fingerprint": hexadecimal(plain[pairs]),
                "edited_fingerprint": hexadecimal(changed),
                "near_edited": likeness(plain[pairs], changed),
                "near_next": likeness(plain[pairs], plain[pairs + 1]),
            }
        )

    partitions = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return beside_next(docs, partitions).mapInPandas(run, schema)
