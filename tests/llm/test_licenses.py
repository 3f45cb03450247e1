"""The licence scan against Python's regular expressions and a comparison of all pairs of matches."""

import re

import pytest

from changefeed.llm import license_rules, licenses
from changefeed.llm.queries import QUERIES

RULES = license_rules.rules()
TEXTS = [
    None, "", " ... ", "cc by", "CC-BY, cc by; cc  by", "General\nPublic_License general public license", "ALL RIGHTS RESERVED all rights reserved all rights",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: Apache-2.0",
    "Released under the MIT License. Licensed under the Apache License, Version 2.0.", "gplv3 or later, gpl 2, lgpl v2.1 and LGPL 2.1", "gpl 2019 5",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "Copyright (c) 2019 2021 by Ann Other. All rights reserved.",
    "redistribute it and/or modify it under the terms of the GNU Lesser General Public License 2.1", "écc by cc byé cc by", "Kelvin K İ cc by", "neither the name of a b c d e f g h nor the names of its contributors",
    "no licence here at all", "cc by " * 3000, "under the mit license " * 700, "y" * 100_000, "creative commons attribution share-alike 3.0 unported license",
]


def words_of(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    words = words_of(text)
    by_word = {}
    for r in RULES:
        by_word.setdefault(r.keyword, []).append(r)
    found = []
    for at, word in enumerate(words):
        ahead = " ".join(words[at : at + licenses.SPAN]) + " "
        for r in by_word.get(word, ()):
            m = re.match(f"(?:{r.pattern})(?= )()", ahead, re.ASCII)
            if m:
                version = (m[1] or "").replace(" ", ".")
                label = r.label + (f"-{version if '.' in version else version + '.0'}" if version else "")
                found.append((r.number, label, r.rank, at, at + m[0].count(" ")))
    ordered = sorted(found, key=lambda m: (m[3], -m[4], -m[2], m[0]))
    kept = [m for k, m in enumerate(ordered) if not any(e[3] <= m[3] and e[4] >= m[4] and e[2] >= m[2] for e in ordered[:k])]
    return len(words), [m for m in ordered if m[0] < len(license_rules.BASE_PHRASES)], kept


def test_rules():
    assert 300 < len({r.number for r in RULES})
    for r in RULES:
        assert r.keyword in license_rules.first_words(r.pattern) and r.needle.strip() and len(r.pattern.split(" ")) < licenses.SPAN


def test_agrees_with_brute_force(spark, sf_dir):
    given = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "cc by"), (3, "cc by"), (3, "mit license")]
    own = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    given += [(1000 + r.doc_id, r.text) for r in own]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in given], "doc_id bigint, text string, found string, n_words int")
    got = sorted(
        ((r.doc_id, r.n_words, [tuple(m) for m in r.base], [tuple(m) for m in r.detections]) for r in licenses.scan(docs).collect()), key=repr
    )
    assert got == sorted(((i, *brute(t)) for i, t in given), key=repr)


@pytest.mark.parametrize("text, row", [
    (None, (0, 0, None, None, "", "", 0.0)),
    ("a cc by b GENERAL public license", (7, 2, 1, 4, "cc-by,gpl", "cc-by,gpl", 0.3)),
    ("This work is licensed under the GNU General Public License, version 3.", (12, 1, 7, 7, "gpl", "gpl,gpl-3.0", 0.95)),
    ("Licensed under CC BY-NC 4.0. All rights reserved.", (10, 2, 2, 7, "cc-by,reserved", "cc-by,cc-by-nc-4.0,reserved", 0.95)),
    ("spdx license identifier: MIT", (4, 0, None, None, "", "mit", 1.0)),
])
def test_summary(spark, text, row):
    scanned = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))
    assert tuple(licenses.summary(scanned).first())[1:] == row


def test_empty_table(spark):
    assert licenses.summary(licenses.scan(spark.createDataFrame([], "doc_id bigint, text string"))).count() == 0


def test_query_has_every_document_and_no_python(spark, sf_dir):
    df = QUERIES["op12_license_scan"](spark, sf_dir)
    assert df.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(p in plan for p in ("Python", "Arrow", "Pandas", "Exchange"))
