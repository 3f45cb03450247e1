"""Toxicity by a weighted finite-state pattern grammar.

Small transducers rewrite a clause's symbols one after the other: negation marks denied insults, reported speech marks quoted ones, a
threat counts only with its target, an insult counts more beside one. Composed, they are one table that reads each clause with an
insult or a threat once; what it matches, with the weight of the words, is the clause's score. A logistic model on the clause
scores of a document gives the probability of label 1.

Insults are a short fixed list and the words that occur far more often in toxic documents than in others. Words and logistic model are
learned from a bounded sample of the labelled rows.

A null text is empty; texts without a match all have the same low score. Without labels of both classes only the fixed list counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changefeed.llm.arrays import flat_text, sliced, word_hashes, word_spans
from changefeed.llm.quality import held_out
from changefeed.session import written

SAMPLE_ROWS = 20_000  # labelled rows that the model is learned from, those with the smallest hash of their id
LEARNED_WORDS = 4_000  # at most, those with the clearest difference
CLEAR = 3.0  # standard errors of a word's log-odds; that of a word no other document has is 1.4 at least, as half a document is added
THRESHOLD = 0.7

# fixed values: words of the grammar, in the languages of the corpus
INSULTS = "idiot moron scum loser clown trash worthless pathetic disgusting stupid vermin imbecile dumb crétin abruti idiota imbécil trottel vollidiot"
THREATS = "kill hurt destroy beat stab shoot murder tuer matar töten umbringen"
TARGETS = "you your yours u they them he she him her this these du dich dir ihr euch tu toi te vous tú usted ustedes"
DENIALS = "not never isn aren don nicht kein keine jamais nunca"
REPORTS = "said says say called claimed wrote quoted sagte schrieb dit dijo"
FIXED_WEIGHT, THREAT_WEIGHT = 3.0, 4.0

OTHER, INSULT, THREAT, TARGET, DENIAL, REPORT = range(6)
DENIED, QUOTED, MENACE = range(6, 9)  # symbols between the transducers
SYMBOLS = 9
_REACH = 4  # words that a denial, a target or a threat reaches forward within its clause

LETTERLESS = np.ones(256, bool)
LETTERLESS[range(0x61, 0x7B)] = False
LETTERLESS[range(0x80, 0x100)] = False
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[*b".!?;\n"]] = True


class Transducer:
    """Arcs (state, symbol) -> (state, symbol, weight); weights multiply along the transducers of a chain."""

    def __init__(self, states: int, arc):
        self.states = states
        self.arcs = {(q, s): arc(q, s) for q in range(states) for s in range(SYMBOLS)}

    def then(self, other: Transducer) -> Transducer:
        """The composition: ``other`` reads what this one writes."""

        def arc(q: int, s: int):
            to, between, weight = self.arcs[q // other.states, s]
            to_other, out, more = other.arcs[q % other.states, between]
            return to * other.states + to_other, out, weight * more

        return Transducer(self.states * other.states, arc)


def _reaching(opens: int, meets: dict[int, tuple[int, float]], consumed: bool = True) -> Transducer:
    """After the symbol ``opens``, the symbols in ``meets`` within reach are rewritten and weighted."""

    def arc(q: int, s: int):
        if s == opens:
            return _REACH, OTHER if consumed else s, 1.0
        out, weight = meets.get(s, (s, 1.0)) if q else (s, 1.0)
        return max(q - 1, 0), out, weight

    return Transducer(_REACH + 1, arc)


def grammar() -> Transducer:
    threat = _reaching(THREAT, {TARGET: (MENACE, 1.0)})
    denial = _reaching(DENIAL, {INSULT: (DENIED, 0.25), MENACE: (DENIED, 0.25)})
    quoted = {INSULT: (QUOTED, 0.4), MENACE: (QUOTED, 0.4)}
    report = Transducer(2, lambda q, s: (1, OTHER, 1.0) if s == REPORT else (q, *(quoted.get(s, (s, 1.0)) if q else (s, 1.0))))
    target = _reaching(TARGET, {s: (s, 1.5) for s in (INSULT, DENIED, QUOTED)}, consumed=False)
    return threat.then(denial).then(report).then(target)


def tables(chain: Transducer) -> tuple[list[list[int]], list[list[float]]]:
    """Next state, and the weight of a match (0 where nothing is matched), by state and symbol."""
    matched = (INSULT, DENIED, QUOTED, MENACE)
    arcs = [[chain.arcs[q, s] for s in range(SYMBOLS)] for q in range(chain.states)]
    return [[a[0] for a in row] for row in arcs], [[a[2] if a[1] in matched else 0.0 for a in row] for row in arcs]


class Lexicon:
    """Symbol and weight of words, looked up by hash for whole arrays."""

    def __init__(self, learned: dict[str, float]):
        entries = {w: (INSULT, FIXED_WEIGHT) for w in INSULTS.split()} | {w: (INSULT, x) for w, x in learned.items()}
        # a word of the grammar keeps its role, learned or not
        for words, symbol in ((THREATS, THREAT), (TARGETS, TARGET), (DENIALS, DENIAL), (REPORTS, REPORT)):
            entries |= {w: (symbol, THREAT_WEIGHT if symbol == THREAT else 0.0) for w in words.split()}
        data, offsets = flat_text(pa.array(list(entries)))
        hashes = word_hashes(data, offsets[:-1], offsets[1:])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.symbols, self.weights = (np.array(x)[order] for x in zip(*entries.values(), strict=True))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        there = self.hashes[at] == hashes
        return np.where(there, self.symbols[at], OTHER), np.where(there, self.weights[at], 0.0)


def clause_features(texts: pa.Array, lexicon: Lexicon, nexts: list[list[int]], weights: list[list[float]]) -> np.ndarray:
    """Row by feature: log of the sum of clause scores, the highest, log of the number of matched clauses, sum by length."""
    data, offsets = flat_text(pc.utf8_lower(texts))
    starts, ends, limits = word_spans(data, offsets, LETTERLESS)
    owner = np.repeat(np.arange(len(texts)), np.diff(limits))
    symbols, weight = lexicon.find(word_hashes(data, starts, ends))
    clause = np.cumsum(CLAUSE_END[data])[starts] + owner if len(starts) else starts
    total, top, matched = (np.zeros(len(texts)) for _ in range(3))
    hits = np.flatnonzero((symbols == INSULT) | (symbols == THREAT))
    for number in np.unique(clause[hits]):
        a, b = np.searchsorted(clause, [number, number + 1])
        state = score = 0.0
        state = 0
        for symbol, w in zip(symbols[a:b].tolist(), weight[a:b].tolist(), strict=True):
            if factor := weights[state][symbol]:
                score += factor * (w or THREAT_WEIGHT)
            state = nexts[state][symbol]
        if score:
            row = owner[a]
            total[row] += score
            top[row] = max(top[row], score)
            matched[row] += 1
    words = np.diff(limits)
    return np.stack([np.log1p(total), np.minimum(top, 20), np.log1p(matched), 10 * total / np.sqrt(words + 25)], 1)


def with_features(docs: DataFrame, learned: dict[str, float]) -> DataFrame:
    """doc_id and the clause features of the text (array<double> ``x``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, (nexts, weights) = Lexicon(learned), tables(grammar())
        for batch in batches:
            for part in sliced(batch):
                x = clause_features(part.column("text"), lexicon, nexts, weights)
                limits = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(limits, x.ravel())], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, x array<double>")


def learn_words(labelled: DataFrame) -> dict[str, float]:
    """Log-odds of the words (runs of letters, lower case) that are clearly commoner in documents of label 1. From rows ``text``, ``label``."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blanks = bytes(0x20 if LETTERLESS[b] else b for b in range(256))
        for batch in batches:
            for part in sliced(batch):
                texts = pc.fill_null(pc.utf8_lower(part.column("text")), "").to_pylist()
                found = [{*t.encode().translate(blanks).split()} for t in texts]
                labels = np.repeat(part.column("label").to_numpy(zero_copy_only=False), [*map(len, found)])
                yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for f in found for w in f], pa.string()), "label": labels})

    count = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    n, p = count.get(0, 0), count.get(1, 0)
    if not n or not p:
        return {}
    # log-odds with half a document added to each cell, and their standard error
    inside = F.col("ones") + 0.5, F.col("zeros") + 0.5
    odds = F.log(inside[0] / (p - F.col("ones") + 0.5)) - F.log(inside[1] / (n - F.col("zeros") + 0.5))
    rows = (
        labelled.select("text", "label").mapInArrow(words, "word string, label int")
        .groupBy("word").agg(F.sum("label").alias("ones"), F.sum(1 - F.col("label")).alias("zeros"))
        .where("ones >= 3").withColumn("odds", odds)
        .withColumn("clear", F.col("odds") / F.sqrt(1 / inside[0] + 1 / inside[1]))
        .where((F.col("clear") >= CLEAR) & (F.col("odds") >= 2))
        .orderBy(F.desc("clear"), "word").limit(LEARNED_WORDS)
        .collect()
    )
    return {r.word: r.odds for r in rows}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Weights (the first is the constant) by Newton steps on the ridge-penalised likelihood."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Labels (doc_id, toxic) of held-out rows are not used."""
    sample = written(
        labels.where(~held_out("doc_id", 3, 1)).where("toxic in (0, 1)")
        .select("doc_id", F.col("toxic").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows),
        "toxicity-sample",
    )
    # at most sample_rows rows of two numbers
    learned = learn_words(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))
    x = written(with_features(docs, learned), "toxicity")
    # one row for each sampled id and label, however many rows the id has
    known = x.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min("x").alias("x")).select("x", "label").toPandas()
    if known["label"].nunique() == 2:
        weights = logistic(np.array(known["x"].tolist()), known["label"].to_numpy(float))
    else:
        weights = np.array([-4.0, 2.0, 0.5, 0.0, 0.0])  # by the fixed list alone

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            z = np.array(frame["x"].tolist()).reshape(-1, len(weights) - 1) @ weights[1:] + weights[0]
            yield frame.assign(score=1 / (1 + np.exp(-np.clip(z, -700, 700))))

    scored = x.mapInPandas(run, x.withColumn("score", F.lit(0.0)).schema)
    return scored.select(
        "doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
