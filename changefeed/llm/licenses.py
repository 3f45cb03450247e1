"""License scan with DataFrame functions only: ordered signature rules over the words of a text.

A text is lower-cased (A-Z) and cut into words. At each word that is the keyword of a rule, the next SPAN words are looked at: only the rules of that keyword whose
needle is among them are tried, in order, with their pattern. A match covers an interval of words. Matches are walked through by start, the longest and strongest
first: one that lies within the interval of an earlier match of the same or a higher rank is suppressed, so of overlapping detections the most telling stands and
both stand where neither holds the other. Phrases of ``BASE_PHRASES`` are reported wherever they stand, suppressed or not.

Everything happens within a row: nothing is shuffled, and the rules are one literal of the plan. A null text has no words; a text without a match has no labels and
score 0. Rows are independent of each other, so repeated rows and ids get results of their own. Columns other than doc_id and text are neither read nor returned.
Texts of any length are scanned whole: the walk keeps one number for each rank, and a match costs the same wherever it stands.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changefeed.llm.license_rules import BASE_PHRASES, MENTION, STRENGTH, TAG, Rule, rules

SPAN = 40  # words; no rule matches more
CHUNK = 256  # matches that are appended to one array before another is begun
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MATCH = "struct<first:int,shorter:int,weaker:int,number:int,label:string,last:int,rank:int,base:boolean>"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, CAPITALS, SMALL), BETWEEN), "")


def rule_map(rule_list: list[Rule]) -> Column:
    """keyword: its rules in order. A constant, which Spark works out once when it plans."""
    by_word: dict[str, list[dict]] = {}
    for r in rule_list:
        own = {"number": r.number, "label": r.label, "rank": r.rank, "needle": r.needle, "pattern": f"^(?:{r.pattern})(?= )()", "base": r.number < len(BASE_PHRASES)}
        by_word.setdefault(r.keyword, []).append(own)  # group 1 is the version, or else empty
    kind = "map<string,array<struct<number:int,label:string,rank:int,needle:string,pattern:string,base:boolean>>>"
    return F.from_json(F.lit(json.dumps(by_word)), kind)


def matches(words: Column, rule_list: list[Rule]) -> Column:
    """All matches, by start, the longest first, then the strongest, then in the order of the rules (MATCH)."""
    keywords = sorted({r.keyword for r in rule_list})
    by_word = rule_map(rule_list)
    places = F.when(
        F.arrays_overlap(words, F.array(*(F.lit(k) for k in keywords))),
        F.filter(F.transform(words, lambda w, i: F.when(w.isin(keywords), i)), lambda i: i.isNotNull()),
    ).otherwise(F.array().cast("array<int>"))
    windows = F.transform(places, lambda i: F.struct(
        i.alias("first"), F.get(words, i).alias("keyword"), F.concat(F.array_join(F.slice(words, i + 1, F.lit(SPAN)), " "), F.lit(" ")).alias("ahead")
    ))

    def tried(window: Column) -> Column:
        able = F.filter(by_word[window["keyword"]], lambda r: F.contains(window["ahead"], r["needle"]))
        found = F.transform(able, lambda r: F.struct(
            r.alias("rule"), *(F.call_function("regexp_extract", window["ahead"], r["pattern"], F.lit(group)).alias(name) for group, name in enumerate(("found", "version")))
        ))
        return F.transform(F.filter(found, lambda m: m["found"] != ""), lambda m: _match(window["first"], m))

    return F.array_sort(F.flatten(F.transform(windows, tried)))


def _match(first: Column, m: Column) -> Column:
    """A match as MATCH has it: its first fields sort it."""
    n = F.length(m["found"]) - F.length(F.replace(m["found"], F.lit(" "), F.lit("")))  # its words, less one
    version = F.replace(m["version"], F.lit(" "), F.lit("."))
    dotted = F.when(version.contains("."), version).otherwise(F.concat(version, F.lit(".0")))
    label = F.when(m["version"] == "", m["rule"]["label"]).otherwise(F.concat(m["rule"]["label"], F.lit("-"), dotted))
    return F.struct(
        first.alias("first"), (-n).alias("shorter"), (-m["rule"]["rank"]).alias("weaker"), m["rule"]["number"].alias("number"),
        label.alias("label"), (first + n).alias("last"), m["rule"]["rank"].alias("rank"), m["rule"]["base"].alias("base"),
    )


def unsuppressed(found: Column) -> Column:
    """Of sorted matches, those that lie within no earlier one of the same or a higher rank."""
    kind = f"array<{MATCH}>"
    start = F.struct(
        F.array_repeat(F.lit(-1), TAG).alias("ends"),  # for each rank, the furthest end of a match of it or a higher one
        F.array().cast(f"array<{kind}>").alias("full"), F.array().cast(kind).alias("open"),
    )

    def step(state: Column, m: Column) -> Column:
        stays = F.get(state["ends"], m["rank"] - 1) < m["last"]
        is_full = F.size(state["open"]) >= CHUNK
        return F.struct(
            F.when(stays, F.transform(state["ends"], lambda end, i: F.when(i < m["rank"], F.greatest(end, m["last"])).otherwise(end))).otherwise(state["ends"]).alias("ends"),
            F.when(stays & is_full, F.concat(state["full"], F.array(state["open"]))).otherwise(state["full"]).alias("full"),
            F.when(~stays, state["open"]).when(is_full, F.array(m)).otherwise(F.concat(state["open"], F.array(m))).alias("open"),
        )

    return F.aggregate(found, start, step, lambda s: F.flatten(F.concat(s["full"], F.array(s["open"]))))


def scan(docs: DataFrame, rule_list: list[Rule] | None = None) -> DataFrame:
    """doc_id, n_words, base and detections: arrays of (rule, label, rank, first, last), first and last being words counted from 0.

    ``base`` has every place of a base phrase, ``detections`` what is not suppressed, both by place.
    """
    rule_list = rules() if rule_list is None else rule_list
    # each step stands in a generator, so that what is worked out once is not worked out again for each use
    cut = docs.select("doc_id", F.explode(F.array(words_of(F.coalesce("text", F.lit(""))))).alias("words"))
    found = cut.select("doc_id", F.size("words").cast("bigint").alias("n_words"), F.explode(F.array(matches(F.col("words"), rule_list))).alias("found"))
    walked = found.select("doc_id", "n_words", "found", F.explode(F.array(unsuppressed(F.col("found")))).alias("kept"))

    def plain(m: Column) -> Column:
        return F.struct(m["number"].alias("rule"), m["label"].alias("label"), m["rank"].alias("rank"), m["first"].alias("first"), m["last"].alias("last"))

    return walked.select(
        "doc_id", "n_words", F.transform(F.filter("found", lambda m: m["base"]), plain).alias("base"), F.transform("kept", plain).alias("detections")
    )


def summary(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: the strength of the strongest detection, 0 without one."""

    def distinct(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    strength = F.lit(0.0)
    for rank in range(MENTION, TAG + 1):
        strength = F.when(F.array_contains("detections.rank", rank), F.lit(STRENGTH[rank])).otherwise(strength)
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"),
        F.array_min("base.first").cast("bigint").alias("first_word"), F.array_max("base.first").cast("bigint").alias("last_word"),
        distinct(F.col("base.label")).alias("base_labels"), distinct(F.concat("base.label", "detections.label")).alias("labels"), strength.alias("score"),
    )
