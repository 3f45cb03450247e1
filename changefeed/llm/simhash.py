"""SimHash near-duplicates by tiled exact comparison.

A fingerprint has a bit set where over half of a document's shingle hashes have it. Equal fingerprints are one node. Fingerprints that
differ in at most three of 64 bits agree in one of four blocks of 16 bits, so only those that share a block are compared: as tiles,
by exclusive-or and bit counts in numpy. The fingerprints of a full block are dealt out to tiles by population count, and pairs of tiles whose
counts differ by more than the radius are skipped. A pair of tiles gives a spanning forest of its links, never all pairs.

A null or empty text has no words and fingerprint zero, which links like any other. Repeated rows get equal results. A document without
an id gets a fingerprint; a component's id is the smallest id in it, null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.llm.arrays import flat_text, sliced
from changefeed.llm.components import components
from changefeed.operators.skew import broadcast_if_small
from changefeed.session import written

SHINGLE = 3
RADIUS = 3  # below the number of blocks
BLOCK_BITS = 16
TILE = 2048  # fingerprints of a tile, about
SEED = 42
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint_texts(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Fingerprint of each text as a signed 64-bit number."""
    data, offsets = flat_text(texts)
    whole = data.tobytes().translate(_LOWER)
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    limits = offsets.tolist()
    for i in range(len(texts)):
        words = whole[limits[i] : limits[i + 1]].split()
        if not words:
            continue
        line = b" ".join(words)
        ends = np.cumsum([*map(len, words)]) + np.arange(len(words))
        k = min(shingle, len(words))
        firsts = np.concatenate([[0], ends[: len(words) - k] + 1]).tolist()
        hashes += [digest(line[a:b], SEED) for a, b in zip(firsts, ends[k - 1 :].tolist(), strict=True)]
        counts[i] = len(firsts)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        heads = (np.cumsum(counts) - counts)[some]
        votes = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
        out[some] = np.packbits(votes * 2 > counts[some, None], axis=1).view(">u8").ravel()
    return out.view(np.int64)


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of ``text`` (bigint) in a column ``name``, which replaces one of that name."""
    schema = docs.drop(name).withColumn(name, F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, text):
                kept = [n for n in part.schema.names if n != name]
                own = pa.array(fingerprint_texts(part.column(text)), pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in kept), own], names=[*kept, name])

    return docs.mapInArrow(run, schema)


def near(values: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs among ``values`` that differ in at most ``radius`` bits, in strips of bounded size."""
    left, right = [], []
    rows = max(1, (1 << 21) // max(1, len(values)))
    for first in range(0, len(values), rows):
        strip = values[first : first + rows, None] ^ values[None, first:]
        a, b = np.nonzero(np.bitwise_count(strip) <= radius)
        later = b > a
        left.append(a[later] + first)
        right.append(b[later] + first)
    return np.concatenate(left), np.concatenate(right)


def forest(size: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node to the smallest node of its component: fewer than ``size``, with the same components."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        np.minimum.at(after, label[left], low)
        np.minimum.at(after, label[right], low)
        after = after[after]
        if (after == label).all():
            node = np.flatnonzero(label != np.arange(size))
            return node, label[node]
        label = after


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links among the fingerprints of each row's tiles. Short lists of one length are compared together."""
    for frame in frames:
        a, b = [], []
        lists = [np.asarray(v, np.int64) for v in frame["values"]]
        by_size: dict[int, list[np.ndarray]] = {}
        for v in lists:
            by_size.setdefault(len(v), []).append(v)
        for size, same in by_size.items():
            if size > 16:
                for v in same:
                    left, right = near(v.view(np.uint64))
                    if len(left):
                        left, right = forest(size, left, right) if len(left) >= size else (left, right)
                        a.append(v[left])
                        b.append(v[right])
                continue
            i, j = np.triu_indices(size, 1)
            matrix = np.stack(same)
            hit = np.bitwise_count((matrix[:, i] ^ matrix[:, j]).view(np.uint64)) <= RADIUS
            row, pair = np.nonzero(hit)
            a.append(matrix[row, i[pair]])
            b.append(matrix[row, j[pair]])
        if a:
            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})


def links(values: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct ``fingerprint`` values, enough to connect all that differ in at most RADIUS bits."""
    blocks = F.array(
        *(
            F.shiftrightunsigned("fingerprint", BLOCK_BITS * i).bitwiseAND((1 << BLOCK_BITS) - 1) + (i << BLOCK_BITS)
            for i in range(64 // BLOCK_BITS)
        )
    )
    dealt = values.select("fingerprint", F.explode(blocks).alias("block"))
    full = dealt.groupBy("block").count().where(F.col("count") > TILE)
    # a block with more fingerprints than a tile: tiles by population count and salt, and all pairs of tiles within the radius
    dealt = dealt.join(full, "block", "left").select(
        "fingerprint", "block", F.ceil(F.coalesce("count", F.lit(0)) / TILE).cast("int").alias("salts"), F.bit_count("fingerprint").alias("ones")
    )
    own = F.expr("ones * salts + cast(pmod(xxhash64(fingerprint), salts) as int)")
    others = F.expr(f"flatten(transform(sequence(ones - {RADIUS}, ones + {RADIUS}), p -> transform(sequence(0, salts - 1), s -> p * salts + s)))")
    pairs = F.when(F.col("salts") == 0, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))).otherwise(
        F.transform(others, lambda o: F.struct(F.least(o, "own").alias("lo"), F.greatest(o, "own").alias("hi")))
    )
    tiles = (
        dealt.withColumn("own", F.when(F.col("salts") > 0, own)).select("fingerprint", "block", F.explode(pairs).alias("pair"))
        .groupBy("block", "pair.lo", "pair.hi").agg(F.collect_list("fingerprint").alias("values"))
        .where("size(values) > 1").select("values")
    )
    return tiles.mapInPandas(_compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hexadecimal digits), component_id. Fingerprints are written once, so texts are read once."""
    own = written(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fingerprint"), "simhash")
    nodes = written(own.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    found = components(links(nodes)).withColumnRenamed("node", "fingerprint")
    members = nodes.join(found, "fingerprint")
    least = members.groupBy("component").agg(F.min("first").alias("least"))
    linked = members.join(least, "component").select("fingerprint", "least")
    classes = nodes.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("least", "first").alias("component_id"))
    return own.join(classes, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, with the columns of ``docs``: that of the smallest id, or one without an id if none has one. Among
    rows that share that id, or lack one, a hash of the row decides; of equal rows one stays."""
    # the caller's columns are in one struct, so that no name of theirs is taken for one of these
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = [*columns, *(c.isNull() for c in columns)]
    keyed = docs.select(F.struct(*columns).alias("own"), F.xxhash64(*whole).alias("k1"), F.xxhash64(F.lit(1), *whole).alias("k2"))
    own = written(fingerprints(keyed.select("own.doc_id", "own.text", "k1", "k2")).drop("text"), "simhash")
    kinds = own.groupBy("fingerprint", "k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times"))
    nodes = written(own.select("fingerprint").distinct(), "simhash-nodes")
    found = components(links(nodes)).withColumnRenamed("node", "fingerprint")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "k1", "k2", "times")).alias("first")
    kept = kinds.join(found, "fingerprint", "left").groupBy(F.coalesce("component", "fingerprint")).agg(first)
    kept = written(kept.select("first.k1", "first.k2", "first.times"), "simhash-kept")
    once = keyed.join(kept.where("times = 1"), ["k1", "k2"], "left_semi")
    repeated = keyed.join(broadcast_if_small(kept.where("times > 1")), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return once.select("own.*").union(repeated.select("own.*"))
