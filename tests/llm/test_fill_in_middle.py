"""Fill-in-middle against a loop over lines, its round trip, and odd rows."""

import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from changefeed.llm import fill_in_middle
from changefeed.llm.queries import ORACLES, QUERIES
from tools.check_queries import connect, normalized, oracle_rows

TEXTS = [
    None, "", "\n", "\n\n\n", "one", "one\ntwo", "one\ntwo\n", "a <P> b\nc", "<S>", "x\n<M>", "<P\n>\n<S\n", "ends with <\nP>\nS>", "Ünï\n日本🙂\r\nçø\x85dé", "w\n" * 5000, "x" * 300_000,
]


def brute(text, doc_id, rate=100, spm=50, seed=7):
    """The contract, line by line."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(units)
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(df):
    return sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rate, spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_agrees_with_brute_force(spark, rate, spm):
    docs = [(i, t) for i, t in enumerate(TEXTS * 4)] + [(None, "no\nid\nhere"), (None, None), (5, "same\nid"), (5, "same\nid")]
    # names that the operator uses itself are the caller's here
    table = spark.createDataFrame([(i, t, "s", 1, "o") for i, t in docs], "doc_id bigint, text string, form string, n int, output string")
    want = sorted(((i, *brute(t, i, rate, spm), t or "") for i, t in docs), key=repr)
    assert rows_of(fill_in_middle.transform(table, rate=rate, spm=spm)) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>PSM\n a", max_size=40), st.integers(0, 10**6))
def test_restores_any_text(text, doc_id):
    units, marks = fill_in_middle.regex.compile(fill_in_middle.UNITS), fill_in_middle.Sentinels()
    p = fill_in_middle.plan(text, doc_id, units, marks, 7, 100, 50)
    output = fill_in_middle.arrange(text, p, marks)
    assert (p.n, p.form, output) == tuple(brute(text, doc_id)[i] for i in (0, 1, 4))
    assert fill_in_middle.restore(output, p.form, marks) == text


def test_empty_table(spark):
    assert fill_in_middle.transform(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_query_agrees_with_sql(spark, sf_dir):
    df = QUERIES["op13_fill_in_middle"](spark, sf_dir)
    columns, want = oracle_rows(connect(sf_dir), ORACLES["op13_fill_in_middle"])
    assert normalized(df.columns, [tuple(r) for r in df.collect()]) == normalized(columns, want)
    assert {r.form for r in df.select("form").distinct().collect()} == {"psm", "spm"}
