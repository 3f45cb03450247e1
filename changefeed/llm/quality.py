"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class (label 1, label 0) has a mean and a covariance, shrunk towards its diagonal and the covariance of both classes; the score is the
probability of label 1 from the two Gaussian log-densities (Mahalanobis distances by cached Cholesky factors). Means
and covariances come from sums over all labelled rows, added up by Spark.

A null text is empty and scored like any other. Repeated rows get equal scores, a document with several labels counts once for each.
Without rows of both classes the score is the share of label 1 (0.5 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.llm.arrays import BLANK, flat_text, sliced, word_hashes, word_spans
from changefeed.session import written

SHRINK = 0.1  # weight of the diagonal, and of the covariance of both classes
THRESHOLD = 0.7

# classes of bytes
LOWER, UPPER, DIGIT, SPACE, LINE, COMMON, SYMBOL, OTHER = range(8)
KINDS = np.full(256, SYMBOL, np.uint8)
KINDS[range(0x61, 0x7B)] = LOWER
KINDS[range(0x41, 0x5B)] = UPPER
KINDS[range(0x30, 0x3A)] = DIGIT
KINDS[BLANK] = SPACE
KINDS[0x0A] = LINE
KINDS[[*b".,;:'\"-?()"]] = COMMON
KINDS[range(0x80, 0x100)] = OTHER

# what a short text is drawn to: so many characters, words or lines of ordinary text count with each
ORDINARY = {
    "chars": 100, "words": 20, "lines": 2, "word_length": 6.0, "spread": 3.0, "upper": 0.02, "digit": 0.002, "space": 0.15, "common": 0.02,
    "symbol": 0.0005, "other": 0.02, "marked": 0.005, "capital": 0.005, "repeated": 0.002, "top": 0.1, "line_words": 40, "repeated_line": 0.02,
}
STATISTICS = (
    "log_word_length", "word_length_spread", "upper", "digits", "spaces", "common_marks", "symbols", "other_bytes",
    "words_with_symbols", "words_in_capitals", "distinct_words", "repeated_neighbours", "top_word", "log_line_words", "repeated_lines",
)


def root(share: np.ndarray) -> np.ndarray:
    """Shares on a scale on which their spread does not depend on their size."""
    return np.arcsin(np.sqrt(np.clip(share, 0, 1)))


def statistics(texts: pa.Array) -> np.ndarray:
    """Row by statistic (STATISTICS) of whole texts."""
    data, offsets = flat_text(texts)
    rows = len(texts)
    kinds = KINDS[data]
    sizes = np.diff(offsets)
    count = np.stack([_row_sums(kinds == k, offsets) for k in range(8)], 1)
    starts, ends, limits = word_spans(data, offsets)
    words = np.diff(limits)
    n, owner = np.maximum(words, 1), np.repeat(np.arange(rows), words)
    lengths = (ends - starts).astype(float)
    mean = np.bincount(owner, lengths, rows) / n
    spread = np.sqrt(np.bincount(owner, (lengths - mean[owner]) ** 2, rows) / n)
    odd = np.concatenate([[0], np.cumsum((kinds == SYMBOL) | (kinds == DIGIT))])
    small = np.concatenate([[0], np.cumsum((kinds != UPPER) & (kinds != SYMBOL) & (kinds != COMMON))])
    marked = np.bincount(owner, odd[ends] > odd[starts], rows) / n
    capitals = np.bincount(owner, (small[ends] == small[starts]) & (lengths > 1), rows) / n
    hashes = word_hashes(data, starts, ends)
    repeated = np.zeros(len(hashes), bool)
    repeated[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = _distinct(hashes, owner, rows)
    # lines: stretches between line breaks that hold a word
    line = np.cumsum(kinds == LINE)[starts] if len(starts) else np.zeros(0, np.int64)
    line_head = np.ones(len(starts), bool)
    line_head[1:] = (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(line_head)
    with np.errstate(over="ignore"):
        line_hash = np.add.reduceat(hashes, heads) if len(heads) else hashes
    lines = np.bincount(owner[heads], minlength=rows)
    distinct_lines, _ = _distinct(line_hash, owner[heads], rows)

    def share(part: np.ndarray, of: np.ndarray, unit: str, usual: str) -> np.ndarray:
        return root((part + ORDINARY[unit] * ORDINARY[usual]) / (of + ORDINARY[unit]))

    extra = ORDINARY["words"]
    return np.stack(
        [
            np.log1p((mean * words + extra * ORDINARY["word_length"]) / (words + extra)),
            np.log1p((spread * words + extra * ORDINARY["spread"]) / (words + extra)),
            share(count[:, UPPER], sizes, "chars", "upper"), share(count[:, DIGIT], sizes, "chars", "digit"),
            share(count[:, SPACE] + count[:, LINE], sizes, "chars", "space"), share(count[:, COMMON], sizes, "chars", "common"),
            share(count[:, SYMBOL], sizes, "chars", "symbol"), share(count[:, OTHER], sizes, "chars", "other"),
            share(marked * words, words, "words", "marked"), share(capitals * words, words, "words", "capital"),
            # distinct words against what a text of that length usually has
            np.log(distinct + extra) - 0.9 * np.log(words + extra),
            share(np.bincount(owner, repeated, rows), words, "words", "repeated"), share(top, words, "words", "top"),
            np.log1p((words + ORDINARY["lines"] * ORDINARY["line_words"]) / (lines + ORDINARY["lines"])),
            share(lines - distinct_lines, lines, "lines", "repeated_line"),
        ],
        1,
    )


def _row_sums(marks: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _distinct(values: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values of each row, and how often its commonest occurs."""
    if not len(values):
        return np.zeros(rows), np.zeros(rows)
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    head = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])]))
    top = np.zeros(rows)
    np.maximum.at(top, o[head], np.diff(np.append(head, len(v))))
    return np.bincount(o[head], minlength=rows).astype(float), top


@dataclass
class Discriminant:
    """Two Gaussians with their Cholesky factors, and the log-odds of the classes."""

    means: np.ndarray  # class by statistic
    factors: np.ndarray  # class by statistic by statistic: inverse of the Cholesky factor
    log_weight: np.ndarray  # class: log of the share of rows less half the log-determinant

    @classmethod
    def fit(cls, counts: np.ndarray, sums: np.ndarray, products: np.ndarray, shrink: float = SHRINK) -> Discriminant:
        """From the number of rows of each class, sums of their statistics and sums of products of two statistics."""
        d = sums.shape[1]
        means = sums / np.maximum(counts, 1)[:, None]
        each = products / np.maximum(counts, 1)[:, None, None] - means[:, :, None] * means[:, None, :]
        both = (each * counts[:, None, None]).sum(0) / max(counts.sum(), 1)
        factors, log_weight = np.zeros((2, d, d)), np.zeros(2)
        for k in (0, 1):
            own = (1 - 2 * shrink) * each[k] + shrink * np.diag(np.diag(each[k])) + shrink * both + 1e-4 * np.eye(d)
            lower = np.linalg.cholesky(own)
            factors[k] = np.linalg.inv(lower)
            log_weight[k] = np.log(counts[k] / counts.sum()) - np.log(np.diag(lower)).sum()
        return cls(means, factors, log_weight)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        z = [((x - m) @ f.T) for m, f in zip(self.means, self.factors, strict=True)]
        logs = [w - 0.5 * (v**2).sum(1) for w, v in zip(self.log_weight, z, strict=True)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of the text (array<double> ``x``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                x = statistics(part.column("text"))
                limits = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(limits, x.ravel())], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x array<double>")


def fit(labelled: DataFrame) -> Discriminant | float:
    """From rows ``x``, ``label``: the discriminant, or the share of label 1 if a class has no rows. Sums are made by partition, then by
    Spark; two rows of sums come to the driver."""

    d = len(STATISTICS)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + d + d * d))
        for frame in frames:
            x, y = np.array(frame["x"].tolist()).reshape(-1, d), frame["label"].to_numpy()
            for k in (0, 1):
                own = x[y == k]
                total[k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pd.DataFrame({"label": [0, 1], "sums": list(total)})

    sums = (
        labelled.select("x", "label").where("label in (0, 1)").mapInPandas(partial, "label int, sums array<double>")
        .select("label", F.posexplode("sums"))
        .groupBy("label", "pos").agg(F.sum("col").alias("value"))
        .collect()
    )
    total = np.zeros((2, 1 + d + d * d))
    for row in sums:
        total[row.label, row.pos] = row.value
    counts = total[:, 0]
    if not counts.all():
        return float(counts[1] / counts.sum()) if counts.any() else 0.5
    return Discriminant.fit(counts, total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d))


def score(statistics_: DataFrame, model: Discriminant | float) -> DataFrame:
    """``statistics_`` with a column ``score``, the probability of label 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["x"].tolist()).reshape(-1, len(STATISTICS))
            yield frame.assign(score=model.score(x) if isinstance(model, Discriminant) else model)

    return statistics_.mapInPandas(run, statistics_.withColumn("score", F.lit(0.0)).schema)


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether the row is not to be learned from: crc32 of the id as text leaves ``fold`` when divided by ``folds``. A null id is not held out."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with its columns. The score is a row's own, so ids do not matter for it:
    the statistics are made again beside the row."""
    _, model = learned(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch):
                if isinstance(model, Discriminant):
                    yield part.filter(pa.array(model.score(statistics(part.column("text"))) >= threshold))
                elif model >= threshold:
                    yield part

    return docs.mapInArrow(run, docs.schema)


def learned(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Discriminant | float]:
    """The statistics of ``docs``, written once, with ``held_out``, and what is learned from the rows that are not held out."""
    x = written(with_statistics(docs), "quality").withColumn("held_out", held_out("doc_id", 4, 2))
    known = labels.select("doc_id", F.col("quality").alias("label"))
    return x, fit(x.where("not held_out").join(known, "doc_id"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels (doc_id, quality) of held-out rows are not used.

    The statistics are written once, so the texts are read once.
    """
    x, model = learned(docs, labels)
    return score(x, model).select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
