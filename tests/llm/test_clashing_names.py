"""Every operator on tables whose further columns have the names that the operators use themselves, with ids that are null or repeated."""

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from changefeed.llm import bpe, contamination, fill_in_middle, filter_audit, html_text, licenses, lines, lz, quality, simhash, substrings, token_counts, toxicity
from changefeed.llm.arrays import Rolling, Spans, word_hashes, word_spans, flat_text
import numpy as np

HELPERS = (
    "_key _k1 _k2 _doc _tag _leaked own doc tag k1 k2 key n at lead many label mask places place first codes words hashes fingerprint component component_id "
    "least x score held_out held_out_ row kept ranges found base part sha good toxic_ filter output restored form _group _guest _to _line _lines_dropped hash item "
    "text_key string value url_ pages window content weight"
).split()
TEXTS = ["one two three four five six\nseven eight", "one two three four five six\nother line of five words", None, "", "one two three four five six\nseven eight"]


def clashing(spark, texts=TEXTS, more=""):
    rows = [(i if i < 3 else None, t, "en", "s", 7, *[100 + k for k in range(len(HELPERS))]) for i, t in enumerate(texts)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{h}` int" for h in HELPERS)
    return spark.createDataFrame(rows, schema)


def labels_of(spark):
    return spark.createDataFrame([(0, 1, 0, 5, 6), (1, 0, 1, 5, 6)], "doc_id bigint, quality int, toxic int, label int, x int")


def items_of(spark):
    return spark.createDataFrame([(1, "other line of five words", 3, 4)], "item_id bigint, text string, hash int, n int")


def same_columns(df, docs, but=()):
    """The caller's columns come back as they were."""
    rows = df.collect()
    for h in HELPERS:
        if h not in but:
            assert {r[h] for r in rows} <= {100 + HELPERS.index(h)}, h
    assert [c for c in df.columns if c not in but] == [c for c in docs.columns if c not in but]
    return rows


def test_operators_that_keep_the_rows(spark):
    docs = clashing(spark)
    kept = same_columns(lines.without_repeated_lines(docs), docs, but=("_lines_dropped",))
    assert sorted((r._lines_dropped, r.text or "") for r in kept)[:2] == [(0, ""), (0, "")] and sum(r._lines_dropped for r in kept) == 3
    assert len(same_columns(simhash.one_of_each(docs), docs)) == 3
    assert sorted(r.text or "" for r in same_columns(contamination.without_leaks(docs, items_of(spark)), docs)) == ["", "", TEXTS[0], TEXTS[0]]
    assert same_columns(quality.keep(docs, labels_of(spark), threshold=0.0), docs)


def test_operators_that_return_their_own_columns(spark):
    docs, tokens = clashing(spark), public_tokenizers.path
    n = len(TEXTS)
    assert quality.classify(docs, labels_of(spark)).count() == n
    assert toxicity.classify(docs, labels_of(spark)).count() == n
    assert sorted((r.n_words, r.n_removed) for r in substrings.removed(docs, 4).collect()) == [(0, 0), (0, 0), (8, 8), (8, 8), (11, 6)]
    assert [(r.doc_id, r.n_found) for r in contamination.leaks(docs, items_of(spark)).collect()] == [(1, 1)]
    assert simhash.near_duplicates(docs).count() == n
    assert bpe.digests(docs, tokens("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).count() == n
    assert token_counts.token_counts(docs, tokens("byte_bpe_50k.json"), public_tokenizers.PATTERN).count() == n
    assert lz.compare_with_next(docs).count() == n
    assert filter_audit.audit(docs, labels_of(spark)).count() == 600
    assert licenses.summary(licenses.scan(docs)).count() == n and fill_in_middle.transform(docs).count() == n
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *HELPERS)
    assert html_text.main_text(pages).count() == n


def test_pipeline_stages(spark, sf_dir):
    docs = clashing(spark)
    for name, stage in corpus_pipeline.STAGES[1:4]:
        assert stage(spark, docs, sf_dir).columns == list(corpus_pipeline.COLUMNS), name


def thue_morse(n, a, b):
    return [b if bin(i).count("1") & 1 else a for i in range(n)]


def test_sequences_that_collide_modulo_two_to_the_64():
    """Pairs that agree modulo 2^64 whatever the base: neither words nor spans of words collide."""
    one, other = np.array(thue_morse(2048, 7, 9), np.uint64), np.array(thue_morse(2048, 9, 7), np.uint64)
    ends = np.array([0]), np.array([2048])
    for lane in (0, 1):
        assert Rolling(one, lane).spans(*ends) == Rolling(other, lane).spans(*ends)
        assert Spans(one, lane).spans(*ends) != Spans(other, lane).spans(*ends)
    words = ["".join(thue_morse(2048, "a", "b")), "".join(thue_morse(2048, "b", "a")), "a", "ab", "abcdefgh", "abcdefghi", "abcdefghi", "q" * 256, "q" * 257, "q" * 257, "é", "日本"]
    data, offsets = flat_text(pa.array([" ".join(words)]))
    starts, stops, _ = word_spans(data, offsets)
    for lane in (0, 1):
        hashes = word_hashes(data, starts, stops, lane)
        assert all((hashes[i] == hashes[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


def test_spans_are_equal_wherever_they_lie():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    values[100:400] = values[2000:2300]
    spans = Spans(values)
    for length in (1, 35, 300):
        assert (spans.spans(np.array([100]), np.array([100 + length])) == spans.spans(np.array([2000]), np.array([2000 + length]))).all()
    assert spans.spans(np.array([100]), np.array([401])) != spans.spans(np.array([2000]), np.array([2301]))
    assert len(np.unique(spans.spans(np.arange(2900), np.arange(2900) + 35))) == 2900 - 266


@pytest.mark.parametrize("ending", ["", " tail"])
def test_unlike_words_of_one_polynomial_are_not_removed(spark, ending):
    rest = " ".join(f"w{i}" for i in range(34)) + ending
    docs = spark.createDataFrame([(i, "".join(thue_morse(2048, *w)) + " " + rest) for i, w in enumerate(("ab", "ba"))], "doc_id bigint, text string")
    want = 0 if not ending else 35
    assert {r.n_removed for r in substrings.removed(docs).collect()} == {want}


def test_quality_scores_are_those_of_a_plain_discriminant(spark, sf_dir):
    """Sums by partition, shrinkage, Cholesky factors and log densities against the formulas written out, on all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").toPandas()
    x = quality.statistics(pa.array(rows["text"], pa.string()))
    known = dict(labels.select("doc_id", "quality").toPandas().itertuples(index=False, name=None))
    out = {r.doc_id for r in docs.where(quality.held_out("doc_id", 4, 2)).select("doc_id").collect()}
    learn = [i for i, d in enumerate(rows["doc_id"]) if d in known and d not in out and known[d] in (0, 1)]
    y = np.array([known[rows["doc_id"][i]] for i in learn])
    xs, shrink = x[learn], quality.SHRINK
    own = [xs[y == k] for k in (0, 1)]
    covariances = [np.cov(o.T, bias=True) for o in own]
    pooled = sum(len(o) * c for o, c in zip(own, covariances)) / len(y)
    logs = []
    for o, c in zip(own, covariances):
        mixed = (1 - 2 * shrink) * c + shrink * np.diag(np.diag(c)) + shrink * pooled + 1e-4 * np.eye(len(c))
        away = x - o.mean(0)
        distance = np.einsum("ij,jk,ik->i", away, np.linalg.inv(mixed), away)
        logs.append(np.log(len(o) / len(y)) - 0.5 * np.linalg.slogdet(mixed)[1] - 0.5 * distance)
    want = dict(zip(rows["doc_id"], 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))))
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows) and max(abs(r.score - want[r.doc_id]) for r in got) < 1e-6
    assert {r.doc_id for r in got if r.held_out} == out and all(r.predicted == (r.score >= 0.7) for r in got)
