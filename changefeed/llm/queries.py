"""One query for each operator, over its whole table, and the SQL that must give the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changefeed.llm import bpe, contamination, fill_in_middle, filter_audit, html_text, licenses, lines, lz, quality, simhash, substrings, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(build):
    QUERIES[build.__name__] = build
    return build


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@_query
def op8_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.compare_with_next(_table(spark, sf_dir, "documents"))


@_query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n")).alias("n_lines"))
    return lines.without_repeated_lines(docs).select(
        "doc_id", F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), F.col("_lines_dropped").cast("bigint").alias("n_removed"),
        F.sha2("text", 256).alias("kept_sha256"),
    )


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("filter")


@_query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(_table(spark, sf_dir, "documents")))


@_query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(_table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    )


# runs of letters, digits and bytes beyond ASCII; shingles of five words or, for a shorter item, of all its words
ORACLES["op3_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(text), '(?:[a-z0-9]|[^\x00-\x7F])+') AS w FROM benchmark
), items AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT item_id, count(*) AS n FROM items GROUP BY item_id
), shingles AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)
), found AS (
  SELECT doc_id, item_id, count(*) AS n_found FROM shingles JOIN items USING (k, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, n AS n_shingles, n_found, n_found / n AS containment
FROM found JOIN sizes USING (item_id) WHERE n_found >= greatest(1, ceil(0.8 * n - 1e-9))
"""

# masks have a bit for each failed filter, A the lowest; the texts that an earlier filter of an order has removed are those that share a bit with `before`
ORACLES["op11_filter_audit"] = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), rows AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL)::INT AS mask
  FROM w LEFT JOIN l USING (doc_id)
), cells AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows GROUP BY part, mask
), f AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(name, bit)
), orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
  SELECT filter_order, step, bits[step]::INT AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM orders, range(1, 6) r(step)
), counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""

# both cuts are counted in lines; the smaller and the larger of two remainders
ORACLES["op13_fill_in_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), h AS (
  SELECT *, len(units) AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2, ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
         WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, coalesce(array_to_string(units[1 : low], ''), '') AS prefix, coalesce(array_to_string(units[low + 1 : high], ''), '') AS middle,
    coalesce(array_to_string(units[high + 1 :], ''), '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
