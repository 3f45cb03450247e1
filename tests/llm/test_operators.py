"""The operators against brute force, the tokenizer libraries and hand-made cases: nulls, empty texts, ties, repeated rows, empty tables."""

import hashlib
import os
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from changefeed.llm import bpe, components, contamination, html_text, lines, lz, pieces, quality, simhash, substrings, token_counts, toxicity
from changefeed.llm.queries import ORACLES, QUERIES
from tools.check_queries import check, connect

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
ODD_TEXTS = [None, "", " ", "a", "a  b\t\n c ", "one two 　 three", "x" * 3000, "zz " * 400, "Ünï çødé 日本語 🙂🙂", "it's we'll  <|endoftext|> 12 ,,, \x1c."]


def table(spark, texts, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in enumerate(texts)], schema)


def passage(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 50, n)))


@pytest.fixture(scope="module")
def texts():
    shared, other = passage(1, 60), passage(2, 40)
    return [
        *ODD_TEXTS, passage(3, 90), f"{passage(4, 30)} {shared} {passage(5, 50)}", f"{shared}\n{passage(6, 20)}", passage(3, 90),
        "w " * 50, "w " * 36, "u v " * 40, "u v " * 20, f"{other}", f"{other} {other}", passage(3, 34), passage(3, 35),
    ]


def split(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]


def test_bpe_agrees_with_the_library(spark, texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(pieces.rank_file(path))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = {r.doc_id: r for r in bpe.digests(table(spark, texts), path, public_tokenizers.PATTERN).collect()}
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.encode(table(spark, texts[:5]), path, public_tokenizers.PATTERN, ids="source")  # a name that is there
    assert encoded.columns[-1] == "source" and encoded.where("doc_id = 3").first().source == library.encode_ordinary("a")


def test_token_counts_agree_with_the_library(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in token_counts.token_counts(table(spark, texts), path, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 512)


def test_substrings_agree_with_brute_force(spark, texts):
    count = Counter(tuple(w[i : i + 35]) for t in texts for w in [split(t)] for i in range(len(w) - 34))
    rows = {r.doc_id: r for r in substrings.removed(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words, gone = split(text), set()
        for at in range(len(words) - 34):
            if count[tuple(words[at : at + 35])] > 1:
                gone.update(range(at, at + 35))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        assert (rows[i].n_words, rows[i].n_removed, rows[i].kept) == (len(words), len(gone), kept), i


def brute_simhash(text, shingle=3):
    words = split(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def brute_components(values):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("tile", [2048, 2])
def test_simhash_agrees_with_brute_force(spark, texts, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    more = [*texts, passage(9, 200), passage(9, 200) + " extra", passage(9, 199)]
    values = [brute_simhash(t) for t in more]
    label = brute_components(values)
    for r in simhash.near_duplicates(table(spark, more)).collect():
        assert r.fingerprint == f"{values[r.doc_id]:016x}"
        assert r.component_id == label[r.doc_id]
    assert simhash.one_of_each(table(spark, more)).count() == len(set(label))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (None, 3)], "a bigint, b bigint")
    got = dict(components.components(links).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_leaks(spark, texts):
    item = passage(20, 30)
    words = item.split()
    changed = " ".join([*words[:13], "other", *words[14:]])  # 5 of 26 shingles differ
    worse = " ".join([*words[:8], "x", *words[9:20], "y", *words[21:]])
    docs = table(spark, [None, "", f"{passage(21, 500)} {item.upper()}! {passage(22, 10)}", changed, worse, "two words here", "words two", *texts])
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (5, item)], "item_id bigint, text string")
    got = sorted((r.doc_id, r.item_id) for r in contamination.leaks(docs, items).collect())
    assert got == [(2, 1), (2, 5), (3, 1), (3, 5), (5, 4)]
    assert contamination.without_leaks(docs, items).count() == docs.count() - 3
    assert contamination.leaks(docs, items.limit(0)).count() == 0


def test_lines(spark):
    long = "the quick brown fox jumps over the lazy dog near an old stone bridge in the morning light of june with friends"
    docs = table(spark, [f"{long}\nown line one\n\n---", f"{long.upper()}!\nown line two\n\n---", f"x\n{long}\n{long}", None, "", "own line one"])
    got = {r.doc_id: (r.text, r._lines_dropped) for r in lines.without_repeated_lines(docs).collect()}
    assert got == {
        0: (f"{long}\nown line one\n\n---", 0), 1: ("own line two\n\n---", 1), 2: ("x", 2), 3: (None, 0), 4: ("", 0), 5: ("", 1)
    }
    assert lines.without_repeated_lines(docs.limit(0)).count() == 0


def test_line_simhash_and_edit_similarity(spark):
    words = [passage(s, n).split() for s, n in ((1, 6), (2, 127), (3, 128), (4, 1500))]
    frame = spark.createDataFrame([(w,) for w in words], "w array<string>").selectExpr("transform(w, x -> xxhash64(x)) as h", "w")
    for r in frame.select("w", lines.simhash("h").alias("bits")).collect():
        hashes = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in r.w]
        assert r.bits % (1 << 64) == sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))
    pair = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c", "d"])], "a array<string>, b array<string>")
    assert pair.select(lines.word_letters("a").alias("a"), lines.word_letters("b").alias("b")).selectExpr("levenshtein(a, b)").first()[0] == 2


def test_line_votes_in_lanes_are_those_of_the_lambda(spark):
    sizes = (1, 2, 6, 7, 8, 14, 15, 127, 128, 510, 511, 512, 513, 1500)
    rows = [([xxhash.xxh64_intdigest(f"{n} {i}".encode()) - (1 << 63) for i in range(n)], n) for n in sizes] + [([-1] * 511, 0), ([], -1), (None, -2)]
    frame = spark.createDataFrame(rows + rows, "hashes array<bigint>, n int").repartition(3)
    want = {r.n: r.bits for r in frame.select("n", lines.simhash("hashes").alias("bits")).collect()} | {-1: 0}
    got = [(r.n, r.bits) for r in lines.with_simhash(frame).collect()]
    assert len(got) == 2 * len(rows) and {n: bits for n, bits in got} == want and all(want[n] == bits for n, bits in got)


def test_lines_of_one_group_that_no_single_leader_reaches(spark):
    base = passage(9, 60).split()
    # a chain: each line differs from the one before in one word
    chain = [base[:i] + [f"new{j}" for j in range(i)] + base[i:] for i in range(0, 30)]
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(chain)], "doc_id bigint, text string")
    every = lines.lines_of(docs).collect()
    bits = {r.doc: r.bits for r in every}
    near = [(a, b) for a in bits for b in bits if a < b and bin((bits[a] ^ bits[b]) % (1 << 64)).count("1") <= 3]
    near = [(a, b) for a, b in near if len(chain[a]) >= 0.8 * len(chain[b])]
    find = {a: a for a in bits}
    for _ in bits:
        for a, b in near:
            find[a] = find[b] = min(find[a], find[b])
    kept = {r.doc_id for r in lines.without_repeated_lines(docs).where("text <> ''").collect()}
    assert kept == {a for a in bits if find[a] == a} and len(kept) < len(bits)


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_texts_without_an_id_whose_short_hashes_are_equal(spark):
    shared = passage(31, 80)
    texts = spark.range(400_000).selectExpr("id % 2 as short", f"concat('w', id, ' ', if(id % 2 = 0, '{shared}', 'own')) as text")
    pair = texts.groupBy(F.hash("text")).agg(F.max_by("text", "short").alias("a"), F.min_by("text", "short").alias("b"), F.sum("short").alias("s"), F.count("*").alias("n"))
    a, b = pair.where("n = 2 and s = 1").select("a", "b").orderBy("a").first()
    docs = spark.createDataFrame([(None, a), (None, b), (None, f"{shared} end")], "doc_id bigint, text string")
    assert sorted((r.n_words, r.n_removed) for r in substrings.removed(docs).collect()) == [(2, 0), (81, 80), (81, 80)]


def test_no_pair_of_similar_lines_is_missed(spark):
    rng, rows = np.random.default_rng(11), []
    for seed, n in enumerate([4, 5, 6, 9, 10, 11, 14, 15, 19, 20, 24, 25, 39, 40, 60, 100] * 4):
        line = passage(100 + seed, n).split()
        for share in (0.05, 0.1, 0.15, 0.2, 0.22):
            copy = list(line)
            for at in sorted(rng.choice(n, max(1, int(share * n + 1e-9)), replace=False), reverse=True):
                new = f"new{rng.integers(1 << 40)}"
                copy[at : at + 1] = ([new], [], [copy[at], new])[rng.integers(3) if seed % 4 else 0]
            rows += [line, copy]
    rows = [*{tuple(r): r for r in rows}.values()]
    find = list(range(len(rows)))
    for b, y in enumerate(rows):
        for a, x in enumerate(rows[:b]):
            longest = max(len(x), len(y))
            if len({*x} & {*y}) >= 0.5 * longest and word_edits(x, y) * 5 <= longest:
                old, new = max(find[a], find[b]), min(find[a], find[b])
                find = [new if f == old else f for f in find]
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(rows)], "doc_id bigint, text string").repartition(5)
    kept = {r.doc_id for r in lines.without_repeated_lines(docs).where("text <> ''").collect()}
    assert kept == {a for a in range(len(rows)) if find[a] == a} and 64 <= len(kept) < len(rows) / 2


def test_lines_of_few_words_that_come_again_and_again(spark):
    rng, rows = np.random.default_rng(5), []
    for n in [5, 7, 10, 12, 15, 20, 25, 31] * 6:
        line = [f"w{i}" for i in rng.integers(9, size=n)]
        rows.append(line)
        for _ in range(3):
            copy = list(line)
            for _ in range(rng.integers(1, n // 5 + 2)):
                at = rng.integers(len(copy))
                copy[at : at + 1] = ([f"w{rng.integers(9)}"], [], [copy[at], f"w{rng.integers(9)}"])[rng.integers(3)]
            rows.append(copy)
    rows = [r for r in {tuple(r): list(r) for r in rows}.values() if len(r) >= 4]
    find = list(range(len(rows)))
    for b, y in enumerate(rows):
        for a, x in enumerate(rows[:b]):
            if word_edits(x, y) * 5 <= max(len(x), len(y)):
                old, new = max(find[a], find[b]), min(find[a], find[b])
                find = [new if f == old else f for f in find]
    docs = spark.createDataFrame([(i, " ".join(words)) for i, words in enumerate(rows)], "doc_id bigint, text string").repartition(4)
    kept = {r.doc_id for r in lines.without_repeated_lines(docs).where("text <> ''").collect()}
    assert kept == {a for a in range(len(rows)) if find[a] == a} and 24 <= len(kept) < len(rows)


def line_nodes(spark, texts):
    """key, k1, n, codes, as of distinct lines; a line's key has its number in ``texts``."""
    docs = spark.createDataFrame([(i, text) for i, text in enumerate(texts)], "doc_id bigint, text string")
    return lines.parsed(docs).select(lines.node_key(F.col("doc"), F.col("n"), F.lit(1)).alias("key"), "k1", "n", "codes").localCheckpoint()


def test_lines_with_a_word_pair_at_unlike_places_are_not_compared(spark):
    a, b = passage(41, 20).split(), passage(42, 20).split()
    nodes = line_nodes(spark, [" ".join(["rare", "pair", *a]), " ".join([*b, "rare", "pair"])])
    assert lines.crowded_blocks(nodes, lines.commonness(nodes)).count() == 0
    nodes = line_nodes(spark, [" ".join(["rare", "pair", *a]), " ".join([a[0], "rare", "pair", *a[1:]])])
    assert lines.to_leaders(lines.crowded_blocks(nodes, lines.commonness(nodes))).count() == 1


def test_a_line_gets_one_link_to_a_group_however_many_of_it_are_similar(spark):
    base = passage(43, 60).split()
    group = [" ".join([*base[:i], f"own{i}", *base[i + 1 :]]) for i in range(40)]
    late = [" ".join([*base[:50], f"late{i}", *base[51:]]) for i in range(5)]
    far = " ".join([*base[:20], *passage(44, 40).split()])
    nodes = line_nodes(spark, [*group, *late, far])
    keys = {r.key >> lines.LENGTH_BITS: r.key for r in nodes.collect()}
    labels = spark.createDataFrame([(keys[i], keys[0]) for i in range(40)], "key bigint, label bigint")
    links = {tuple(r) for r in lines.across(lines.crowded_blocks(nodes, lines.commonness(nodes)), labels, nodes).collect()}
    assert {link for link in links if keys[0] in link} == {(keys[i], keys[0]) for i in range(40, 45)}
    assert all(keys[45] not in link for link in links) and len(links) <= 5 + 10


def test_lines_that_meet_in_many_blocks_are_compared_once(spark, monkeypatch):
    base = passage(46, 60).split()
    texts = [" ".join([*base[:i], f"own{i}", *base[i + 1 :]]) for i in range(12)]
    nodes = line_nodes(spark, texts)
    compared = []

    def similar(pairs, nodes, real=lines.similar):
        compared.extend((r.a, r.b) for r in pairs.collect())
        return real(pairs, nodes)

    monkeypatch.setattr(lines, "similar", similar)
    labels = spark.createDataFrame([], "key bigint, label bigint")
    links = lines.across(lines.crowded_blocks(nodes, lines.commonness(nodes)), labels, nodes).collect()
    assert len(compared) == len(set(compared)) > 0
    found = components.components(spark.createDataFrame([tuple(r) for r in links], "a bigint, b bigint")).select("component").distinct().count()
    assert found == 1


def test_line_sizes_keep_all_lengths_that_can_be_similar(spark):
    lengths = [*range(4, 140), *range(1000, 1500, 37), lines.LONGEST]
    rows = spark.createDataFrame([(1, n, n) for n in lengths], "at bigint, key bigint, label bigint")
    met = {tuple(r) for r in lines._in_reach(rows, rows, F.lit(True), "inner").select("l.key", "r.key").collect()}
    assert {(m, n) for m in lengths for n in lengths if m != n and abs(m - n) <= max(m, n) // 5} <= met
    assert not any(max(m, n) > 4 * min(m, n) for m, n in met)


def test_line_sketches_mark_words_that_come_an_odd_number_of_times(spark):
    for r in lines._sketched(spark.createDataFrame([(1, 5, [3, 70, 3, 511, 512]), (2, 4, [9, 9, 9, 9])], "key bigint, n int, codes array<int>")).collect():
        assert [r[f"odd{k}"] % (1 << 64) for k in range(8)] == ([1, 1 << 6, 0, 0, 0, 0, 0, 1 << 63] if r.key == 1 else [0] * 8)


def test_lines_leave_no_words_on_disk(spark, monkeypatch):
    made = {}

    def written(df, purpose, real=lines.written):
        table = real(df, purpose)
        made.setdefault(purpose, []).append(table.work_path)
        return table

    monkeypatch.setattr(lines, "written", written)
    assert lines.without_repeated_lines(table(spark, [passage(45, 30), f"{passage(45, 30)} end", None])).count() == 3
    left = {purpose for purpose, paths in made.items() for path in paths if os.path.exists(path)}
    assert {"lines", "lines-distinct"} < made.keys() and left <= {"lines-dropped", "line-blocks-hot"}


def test_phrases(spark, texts):
    for text in texts:
        data = (text or "").encode()
        seen, found, start = set(), [], 0
        while start < len(data):
            end = start + 1
            while end <= len(data) and data[start:end] in seen:
                end += 1
            seen.add(data[start:end])
            found.append(data[start:end])
            start = end
        assert lz.phrases(data)[0] == found
    rows = sorted(lz.compare_with_next(table(spark, texts)).collect(), key=lambda r: r.doc_id)
    plain = lz.hexadecimal(lz.fingerprint_texts([t or "" for t in texts]))
    for i, r in enumerate(rows):
        changed = lz.edited(texts[i] or "", texts[(i + 1) % len(texts)] or "")
        assert (r.fingerprint, r.n_chars) == (plain[i], len(texts[i] or ""))
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.edited_fingerprint == lz.hexadecimal(lz.fingerprint_texts([changed]))[0]
    assert len(rows) == len(texts)
    assert lz.compare_with_next(table(spark, texts).limit(0)).count() == 0
    assert lz.compare_with_next(table(spark, ["only one"])).first().near_next == 1.0
    assert rows[0].fingerprint == rows[1].fingerprint  # null and empty


def test_html():
    model = html_text.Potentials(sum((html_text.counts(html_text.Page(e)) for e in html_text.EXAMPLES), Counter()))
    page = """<html><body><nav><ul><li><a href=x>Home</a></ul></nav><article><h1>A &amp; B</h1><p>one
      two<br>three<p>four <b>five<script>var t="</p>"</script></p><div class="ad">Buy</div></article><div class="comments"><p>me too</p></div><footer>c</footer>"""
    assert model.text(page) == "A & B\n\none two three\n\nfour five"
    assert model.text("") == "" and model.text("<p") == ""
    for odd in ("</p></div>", "<<a b=\"", "<!-- x", "<div " * 200):
        model.text(odd)


def test_marginals_are_exact():
    """Against the sum over all states of a small tree."""
    model = html_text.Potentials(sum((html_text.counts(html_text.Page(e)) for e in html_text.EXAMPLES), Counter()))
    page = html_text.Page("<body><article><p>a b c</p><div class=ad>x</div></article><nav><ul><li>y</ul></nav>")
    n = len(page.tag)
    own = [1e-9] + [model.node(page.features(i)) for i in range(1, n)]
    total, ones = 0.0, np.zeros(n)
    for bits in range(1 << n):
        state = [bits >> i & 1 for i in range(n)]
        p = np.prod([own[i] if state[i] else 1.0 for i in range(n)])
        p *= np.prod([model.child[state[page.parent[i]]][state[i]] for i in range(1, n)])
        total += p
        ones += p * np.array(state)
    assert np.allclose(model.marginals(page), ones / total)


@pytest.mark.parametrize("html, want", [
    ("<p>a <svg class=i/> b</p><p>rest</p>", "a b|rest"), ("<p>a <svg/> b <svg x='/>'>c<svg/>d<svg>e</svg>f</svg>g</p>", "a b g"),
    *((f"<p>a</p><{n}>x</{n}><p>rest</p>", "a|x|rest") for n in ("button-group", "title-bar", "style-guide", "script-x", "svg-icon", "select_one", "object:x")),
    *((f"<p>a</p><{n} id=1><p>rest</p>", "a|rest") for n in ("template", "noscript", "select", "button", "object", "svg")),
    *((f"<p>a</p><{n} id=1>x</{n} ><p>rest</p>", "a|rest") for n in ("template", "noscript", "select", "BUTTON", "object", "svg", "title", "iframe")),
    *((f"<p>a</p><{n}>x<p>rest</p>", "a") for n in ("script", "style", "textarea", "title", "iframe")),
    ("<p>a</p><script>x</script y><p>rest</p>", "a|rest"), ("<button><p>a</p><button>x</button><p>rest</p>", "a|rest"),
    ("<object><p>a</p><object>x</object><p>rest</p>", "a|rest"), ("<p>a</button></svg> b</p>", "a b"),
])
def test_what_is_dropped_of_a_page(html, want):
    assert "|".join(text for _, text in html_text.Page(html).stretches) == want


@pytest.mark.parametrize("unit", ['<div class="x', "<button '", '<p ">" ', "</div ", "<div><p>", "<x '>' "])
@pytest.mark.parametrize("end", ["", "'"])
def test_a_page_is_passed_over_once(unit, end):
    """Many tags that do not end, or nested ones: four times as many take no more than some eight times as long."""
    seconds = []
    for size in (50_000, 200_000):
        start = time.process_time()
        html_text.Page(unit * (size // len(unit)) + end)
        seconds.append(time.process_time() - start)
    assert seconds[1] < 0.5 + 8 * seconds[0]


def test_pages_that_mark_their_article_are_learned_from_whole(spark):
    names = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + "x" for i in range(11_000)]
    paragraphs = "".join(f"<p class={n}>t</p>" for n in names)
    marked = f"<article>{paragraphs}</article><nav>{paragraphs}</nav>"
    pages = [(i, "u", "<div><p>no mark</p></div>") for i in range(50)] + [(99, "u", marked)]
    learned = html_text.train(spark.createDataFrame(pages, "page_id bigint, url string, html string"), sample_pages=1)
    odds = {round(learned.odds.get(f"name {n}", -99), 6) for n in names}
    assert len(odds) == 1 and -99 not in odds


def test_toxic_rows_that_are_held_out_are_found(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = toxicity.classify(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").select("toxic", "predicted").collect()
    found = sum(r.predicted for r in judged if r.toxic == 1)
    assert found >= 0.85 * sum(r.toxic == 1 for r in judged) and found >= 0.95 * sum(r.predicted for r in judged)


def test_words_of_the_grammar_keep_their_role():
    """A learned word takes no threat, target, denial or report away."""
    nexts, weights = toxicity.tables(toxicity.grammar())
    lexicon = toxicity.Lexicon(dict.fromkeys("kill you not said".split(), 6.0))
    texts = ["you said", "I will kill time", "not"]
    assert toxicity.clause_features(pa.array(texts), lexicon, nexts, weights)[:, 0].tolist() == [0, 0, 0]


def test_a_repeated_id_brings_one_row_to_the_driver(spark):
    docs = spark.createDataFrame([(i % 6, f"you idiot number {i}" if i % 2 else f"fine text number {i}") for i in range(300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)] * 3, "doc_id bigint, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 300 and all(0 <= r.score <= 1 for r in got)


def test_grammar():
    nexts, weights = toxicity.tables(toxicity.grammar())
    lexicon = toxicity.Lexicon({"gloop": 5.0})

    def score(text):
        return float(np.expm1(toxicity.clause_features(pa.array([text]), lexicon, nexts, weights)[0, 0]))

    assert score("a gloop") == pytest.approx(5.0) and score("nothing here") == 0
    assert score("you gloop") > score("a gloop") > score("he said that gloop") > score("not a gloop") > 0
    assert score("I will kill you") > 0 and score("I will kill time") == 0 and score("kill. you") == 0


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_without_labels(spark, texts, module, label):
    labels = spark.createDataFrame([], f"doc_id bigint, {label} int")
    rows = module.classify(table(spark, texts), labels).collect()
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 for r in rows)
    assert module.classify(table(spark, texts).limit(0), labels).count() == 0


def test_rows_that_share_or_lack_an_id_are_kept_by_their_own_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*corpus_pipeline.COLUMNS)
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    known = {r.doc_id for r in labels.select("doc_id").collect()}
    rest = {k: [i for i in sorted(scored) if scored[i] == k and i not in known][:20] for k in (0, 1)}
    assert all(rest.values())
    # rows that are not labelled lose their ids or share one, so what is learned stays the same
    other = {i: (None if n % 2 else -1) for k in rest for n, i in enumerate(rest[k])}
    rows = [(other.get(r.doc_id, r.doc_id), r.text, str(r.doc_id)) for r in docs.collect()]
    kept = {int(r.was) for r in quality.keep(spark.createDataFrame(rows, "doc_id bigint, text string, was string"), labels).collect()}
    assert kept == {i for i in scored if scored[i]}


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    a, b, c = passage(21, 80), passage(22, 80), passage(23, 80)
    rows = [(None, a), (None, a), (7, b), (7, b), (7, b + "  "), (7, c), (9, c), (None, c), (3, passage(24, 80))]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect()
    assert sorted((r.doc_id or 0, r.text.strip()) for r in got) == sorted([(0, a), (7, b), (7, c), (3, rows[-1][1])])


def test_classifiers_on_held_out_rows(spark, sf_dir):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() >= 0.95 * got.count()
    got = QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out")
    assert got.where("toxic = 0 and predicted = 1").count() <= 0.02 * got.count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    ok, text = check(spark, connect(sf_dir), name, sf_dir)
    assert ok, text


def test_pipeline(spark, sf_dir):
    """Every stage on what the one before it kept, and its decisions against the operators' own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = quality.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").select("doc_id")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "byte_bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        if name == "line_dedup":
            texts = sorted((r.doc_id, r.text) for r in docs.collect())
        if name == "benchmark_decontamination":
            clean = {r.doc_id: r.text for r in docs.collect()}
    assert kept["quality_classifier"] == {r.doc_id for r in good.collect()} == kept["line_dedup"]
    label = brute_components([brute_simhash(t) for _, t in texts])
    first = {texts[i][0] for i in range(len(texts)) if label[i] == i}
    assert kept["simhash_near_dedup"] == first
    assert kept["benchmark_decontamination"] <= first
    assert {r.doc_id: r.decoded_sha256 for r in docs.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in clean.items()}
