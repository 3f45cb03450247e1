"""Fill-in-middle transformation: a text is cut into prefix, middle and suffix at line limits, and these are put in another order.

One pattern, a repeated capture of one unit, matches the whole text; ``ends(1)`` of the match has the end of every repetition, so it gives the number of units and
both cuts without a loop over lines. A unit is a line with its line break, or what is left after the last one.

Random numbers are the first four groups of eight digits of the sha256 of ``<seed>:<doc_id>``, so a document is cut alike in every run. A row without an id is
seeded by an empty one; repeated rows are cut alike; a null text is empty. An empty text, one that holds a sentinel, and the share of texts that ``rate`` spares
stay plain. Columns of the input other than doc_id and text are neither read nor returned. Nothing is shuffled; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.llm.arrays import sliced

UNITS = r"([^\n]*+\n|[^\n]++)*+"  # possessive: no states are kept to go back to


class Sentinels(NamedTuple):
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Plan(NamedTuple):
    """What is done to a text: its units, its form, and where it is cut (code points; None where it stays plain)."""

    n: int
    form: str
    first: int | None = None
    second: int | None = None


def numbers(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[at : at + 8], 16) for at in range(0, 32, 8)]


def plan(text: str, doc_id: int | None, units: regex.Pattern, marks: Sentinels, seed: int, rate: int, spm: int) -> Plan:
    ends = units.fullmatch(text).ends(1)
    n, (h1, h2, h3, h4) = len(ends), numbers(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return Plan(n, "plain")
    ends.append(0)  # no unit ends at 0; ends[-1] is the end of none
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return Plan(n, "spm" if h4 % 100 < spm else "psm", ends[low - 1], ends[high - 1])


def arrange(text: str, p: Plan, marks: Sentinels = Sentinels()) -> str:
    if p.form == "plain":
        return text
    prefix, middle, suffix = text[: p.first], text[p.first : p.second], text[p.second :]
    if p.form == "psm":
        return f"{marks.prefix}{prefix}{marks.suffix}{suffix}{marks.middle}{middle}"
    return f"{marks.suffix}{suffix}{marks.prefix}{prefix}{marks.middle}{middle}"


def restore(output: str, form: str, marks: Sentinels = Sentinels()) -> str:
    """The text that ``output`` was made of. No part holds a sentinel, so each is found where it was put."""
    if form == "plain":
        return output
    rest, _, middle = output.partition(marks.middle)
    if form == "psm":
        prefix, _, suffix = rest.removeprefix(marks.prefix).partition(marks.suffix)
    else:
        suffix, _, prefix = rest.removeprefix(marks.suffix).partition(marks.prefix)
    return prefix + middle + suffix


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, marks: Sentinels = Sentinels()) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output and restored (the text rebuilt from output and form).

    ``rate`` percent of the texts are rearranged, ``spm`` percent of these with the suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = regex.compile(UNITS)
        for batch in batches:
            for part in sliced(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                plans = [plan(t, i, units, marks, seed, rate, spm) for t, i in zip(texts, part.column("doc_id").to_pylist())]
                outputs = [arrange(t, p, marks) for t, p in zip(texts, plans)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([p.n for p in plans], pa.int64()), pa.array([p.form for p in plans], pa.string()),
                     pa.array([p.first for p in plans], pa.int64()),
                     pa.array([None if p.first is None else p.second - p.first for p in plans], pa.int64()),
                     pa.array(outputs, pa.string()), pa.array([restore(o, p.form, marks) for o, p in zip(outputs, plans)], pa.string())],
                    ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, restored string")
