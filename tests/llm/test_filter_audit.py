"""The filter audit against filters that are really applied, order by order, and odd tables."""

import re
from itertools import permutations

import numpy as np

from changefeed.llm import filter_audit
from changefeed.llm.queries import ORACLES, QUERIES
from tools.check_queries import connect, normalized, oracle_rows

LONG = " ".join(f"word{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, LONG, "a"), (3, LONG, "a"), (1, LONG, "b"), (None, LONG, None), (None, LONG, "a"),
    (4, None, "a"), (5, "", "a"), (6, "  \t\n", None), (7, "w " * 60, "a"), (8, "LOUD " * 60, "b"), (9, f"{LONG} #", "b"), (10, f"{LONG} #", "a"),
    (11, f"{LONG} é\xa0É", "b"), (12, "few WORDS & more", "c"), (13, "few WORDS & more", "c"), (None, "alone", "d"), (None, "alone", "d"), (14, "x" * 200_000, "b"),
    (15, " ".join(f"w{i % 39}" for i in range(60)), "a"), (16, " ".join(f"w{i % 38}" for i in range(60)), "a"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (8, None, 1), (9, 1, None), (None, 1, 1), (12, 1, 1), (99, 1, 1)]


def brute(docs, labels):
    """Each order applied to the rows themselves."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}

    def fails(doc):
        doc_id, text, _ = doc
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        earlier = any((i is not None) and (doc_id is None or i < doc_id) for i, t, _ in docs if (t or "") == text)
        return {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": earlier,
        }

    judged = [(d[0], d[2] or "", fails(d)) for d in docs]
    rows, shapley = [], {}
    for part in {p for _, p, _ in judged}:
        for order in permutations("ABCDE"):
            left = [(i, f) for i, p, f in judged if p == part]
            every = list(left)
            for step, name in enumerate(order, 1):
                gone = [i for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                failing = sum(f[name] for _, f in every)
                alone = sum(f[name] and sum(f.values()) == 1 for _, f in every)
                rows.append((part, "".join(order), step, name, len(left), len(gone), failing - len(gone), alone, sum(i in good for i in gone), sum(i in toxic for i in gone)))
                shapley[part, name] = shapley.get((part, name), 0) + len(gone)
    return sorted((*r, shapley[r[0], r[3]]) for r in rows)


def test_agrees_with_filters_applied_in_order(spark):
    # names that the operator uses itself are the caller's here
    docs = spark.createDataFrame([(*d, "x", 7, 1) for d in DOCS], "doc_id bigint, text string, source string, mask string, n int, label_of int")
    labels = spark.createDataFrame([(*x, "y") for x in LABELS], "doc_id bigint, quality int, toxic int, sha string")
    got = sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect())
    assert got == brute(DOCS, LABELS)


def test_states_are_what_survives_each_set():
    rng = np.random.default_rng(5)
    masks, counts = np.arange(32), rng.integers(0, 100, (32, 3))
    got = filter_audit.states(masks, counts)
    for active in range(32):
        assert (got[active] == counts[(masks & active) == 0].sum(axis=0)).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id bigint, text string, source string")
    assert filter_audit.audit(one, labels).count() == 600


def test_query_agrees_with_sql(spark, sf_dir):
    df = QUERIES["op11_filter_audit"](spark, sf_dir)
    columns, want = oracle_rows(connect(sf_dir), ORACLES["op11_filter_audit"])
    assert normalized(df.columns, [tuple(r) for r in df.collect()]) == normalized(columns, want)
