"""What each of five text filters does in every order in which they can be applied.

Each text fails some of the filters A to E, a mask of five bits. Rows are counted by part and mask (at most 32 cells a part), and all 120 orders are worked out from
the cells alone. A walk through the 32 sets of filters in Gray-code order toggles one filter at a time: each cell has a counter of the active filters it fails, and
what survives changes only by cells whose counter leaves or reaches zero. The 32 states are stored; a step of an order is the difference of two of them.

A: too few words. B: too few distinct words. C: too many capitals. D: holds a character of MARKS. E: the same text stands in a row of smaller doc_id anywhere in the
table. A null text is empty and fails A; rows without a doc_id come after all others, and none of them is before another; rows of one doc_id are not before one
another either. A null source is the part "". A document is good (toxic) if any label of its doc_id says so. Columns other than doc_id, text and source are not
read. An empty table gives no rows.

Texts are known by their sha256. Copies are summed up before and after the exchange by hash, part and id, and the first row of a text is found among these sums, so a
text that many rows share is never gathered.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 50
DISTINCT_PERCENT = 65
CAPITALS_PERCENT = 5
MARKS = "[#$%&*|]"
COUNTED = ("n", "good", "toxic")

AUDIT = (
    "part string, filter_order string, step int, filter string, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
    "good_lost bigint, toxic_lost bigint, shapley bigint"
)


def text_mask(text: Column) -> Column:
    """Bits 0 to 3: whether a text fails A, B, C, D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    failures = (
        n < LEAST_WORDS,
        F.size(F.array_distinct(words)) * F.lit(100).cast("bigint") < n * F.lit(DISTINCT_PERCENT).cast("bigint"),
        F.regexp_count(text, F.lit("[A-Z]")) * F.lit(100).cast("bigint") > F.length(text) * F.lit(CAPITALS_PERCENT).cast("bigint"),
        text.rlike(MARKS),
    )
    return sum((F.when(f, 1 << bit).otherwise(0) for bit, f in enumerate(failures)), F.lit(0))


def _labels(labels: DataFrame) -> DataFrame:
    """label_of, good, toxic (0 or 1): one row for each doc_id."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("label_of"))
    return known.agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (the five filters that a text fails, A the lowest bit), n, good, toxic."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"),
        F.unhex(F.sha2(text, 256)).alias("sha"), text_mask(text).alias("mask"),
    )
    # rows of one id and text are one before the labels are joined, so that only different texts of an id can be many
    by_id = rows.groupBy("doc_id", "sha", "mask", "part").agg(F.count("*").alias("n"))
    judged = by_id.join(_labels(labels), F.col("doc_id") == F.col("label_of"), "left").withColumns(
        {c: F.col("n") * F.coalesce(c, F.lit(0)) for c in COUNTED[1:]}
    )
    sums = [F.sum(c).cast("bigint").alias(c) for c in COUNTED]
    # rows without an id are after all others
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id")
    by_text = judged.groupBy("sha", "mask", "part").agg(*sums, F.min(F.struct(place.alias("place"), *COUNTED)).alias("least"))
    earliest = by_text.groupBy("sha").agg(F.min("least.place").alias("place"))
    both = by_text.join(earliest, "sha")
    is_first = F.col("least.place") == F.col("place")
    first = [F.when(is_first, F.col(f"least.{c}")).otherwise(0) for c in COUNTED]
    kinds = F.array(
        F.struct(F.col("mask").alias("mask"), *(f.alias(c) for f, c in zip(first, COUNTED))),
        F.struct((F.col("mask") + 16).alias("mask"), *((F.col(c) - f).alias(c) for f, c in zip(first, COUNTED))),
    )
    return both.select("part", F.inline(kinds)).groupBy("part", "mask").agg(*sums)


def states(masks: np.ndarray, counts: np.ndarray, filters: int = len(FILTERS)) -> np.ndarray:
    """counts summed over what survives each set of filters, by the set's bits: a walk that toggles one filter at a time."""
    failing = np.zeros(len(masks), np.int64)  # of each cell, the active filters that it fails
    survivors = counts.sum(axis=0)
    stored = np.zeros((1 << filters, counts.shape[1]), np.int64)
    stored[0], active = survivors, 0
    for i in range(1, 1 << filters):
        bit = (i & -i).bit_length() - 1  # what two neighbours of the Gray code differ by
        hit = masks >> bit & 1 == 1
        if active >> bit & 1:
            failing[hit] -= 1
            survivors = survivors + counts[hit & (failing == 0)].sum(axis=0)
        else:
            survivors = survivors - counts[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        active ^= 1 << bit
        stored[active] = survivors
    return stored


def audit_part(part: str, masks: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    """All orders and steps of one part; counts has a row (n, good, toxic) for each mask."""
    kept = states(masks, counts)
    fails = [int(counts[masks >> bit & 1 == 1, 0].sum()) for bit in range(len(FILTERS))]
    alone = [int(counts[masks == 1 << bit, 0].sum()) for bit in range(len(FILTERS))]
    rows, shapley = [], [0] * len(FILTERS)
    for order in permutations(range(len(FILTERS))):
        active, name = 0, "".join(FILTERS[bit] for bit in order)
        for step, bit in enumerate(order, 1):
            after = active | 1 << bit
            removed, good, toxic = (int(x) for x in kept[active] - kept[after])
            rows.append((part, name, step, bit, int(kept[after][0]), removed, fails[bit] - removed, alone[bit], good, toxic))
            shapley[bit] += removed
            active = after
    return pd.DataFrame([(*r[:3], FILTERS[r[3]], *r[4:], shapley[r[3]]) for r in rows], columns=[c.split()[0] for c in AUDIT.split(", ")])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part, order and step: filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Counts are of rows within the part. ``redundant`` fail the filter but went earlier, ``unique_fails`` fail no other; ``shapley`` sums up ``removed`` of the filter over all
    120 orders, at any step.
    """

    def walk(cells: pd.DataFrame) -> pd.DataFrame:
        return audit_part(cells["part"].iloc[0], cells["mask"].to_numpy(np.int64), cells[[*COUNTED]].to_numpy(np.int64))

    # a group has at most 32 rows
    return cells(docs, labels).groupBy("part").applyInPandas(walk, AUDIT)
