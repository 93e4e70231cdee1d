"""Winnowing against a brute-force search of every window."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabsieve.llm import winnow
from tabsieve.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=13):
    out = {}
    known = [(i, words(t)) for i, t in items if i is not None]
    for doc, text in docs:
        w = words(text)
        hit, found = [False] * len(w), set()
        for item, own in known:
            size = min(n, len(own))
            if not size:
                continue
            windows = {tuple(own[k:k + size]) for k in range(len(own) - size + 1)}
            for p in range(len(w) - size + 1):
                if tuple(w[p:p + size]) in windows:
                    hit[p:p + size] = [True] * size
                    found.add(str(item))
        n_hit = sum(hit)
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(w), n_hit, len(found), sha, n_hit > 0 and 20 * n_hit >= len(w))
    return out


def rows(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_tables(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    assert rows(winnow.op7_winnowing(spark, sf_dir)) == brute(docs, items)


def test_edges_blocks_and_clashes(spark, make_docs):
    rng = random.Random(3)
    vocab = ["a", "b", "the", "Ünï", "7"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    items = [(1, text(40)), (2, "Solo"), (3, text(5)), (4, ""), (5, None), (6, "..."), (7, text(13)), (7, text(14)),
             (None, text(20))]
    docs = [(0, None), (1, ""), (2, "solo, SOLO!"), (3, items[0][1].upper() + " x " + text(200)), (4, text(3000)),
            (5, "q " * 400 + items[6][1]), (6, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = winnow.contamination(make_docs(docs, n_words="x", CONTAMINATED=1), bench, block_bytes=60)
    assert "lang" in got.columns and got.columns.count("n_words") == 1
    assert rows(got) == brute(docs, items)
    kept = winnow.keep_clean(spark, make_docs(docs, n_words="x"), bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, v in brute(docs, items).items() if not v[4]}
    assert winnow.contamination(make_docs([]), bench).count() == 0
    assert rows(winnow.contamination(make_docs(docs), bench.limit(0))) == brute(docs, [])


def test_items_without_an_id_are_found(spark, make_docs):
    passage = " ".join(f"leak{i}" for i in range(20))
    items = [(None, passage), (3, " ".join(f"other{i}" for i in range(20)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(1, f"so {passage} end"), (2, items[1][1]), (3, "nothing of either")])
    none = hashlib.sha256(b"").hexdigest()
    assert rows(winnow.contamination(docs, bench)) == {
        1: (22, 20, 0, none, True), 2: (20, 20, 1, hashlib.sha256(b"3").hexdigest(), True), 3: (3, 0, 0, none, False)}
    assert [r.doc_id for r in winnow.keep_clean(spark, docs, bench).collect()] == [3]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=5),
       st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.integers(1, 6), st.booleans())
def test_runs_on_few_words(items, docs, n, small):
    texts = [" ".join(f"w{x}" for x in t) for t in items]
    block = winnow.Block(list(range(len(items))), [t.encode() for t in texts], n, 2)
    size = winnow.SLICE
    winnow.SLICE = 3 if small else size
    try:
        data = [" ".join(f"w{x}" for x in t).encode() for t in docs]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        got = {t: (r, own) for t, r, own in block.runs(*winnow.text_words(np.frombuffer(b"".join(data), np.uint8), offsets))}
    finally:
        winnow.SLICE = size
    for t, doc in enumerate(docs):
        hit, own = set(), set()
        for i, item in enumerate(items):
            k = min(n, len(item))
            known = {tuple(item[a:a + k]) for a in range(len(item) - k + 1)} if k else set()
            for p in range(len(doc) - k + 1):
                if tuple(doc[p:p + k]) in known:
                    hit |= set(range(p, p + k))
                    own.add(i)
        ranges, items_hit = got.get(t, ([], []))
        assert {x for a, b in ranges for x in range(a, b)} == hit and set(items_hit) == own
        assert sum(b - a for a, b in ranges) == len(hit) and len(items_hit) == len(own)


def test_repetitive_texts_on_both_sides_take_linear_time(spark, make_docs):
    items = [(1, "the " * 20000), (2, "a b " * 10000), (3, "the " * 20 + "end")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make_docs([(1, "the " * 60000), (2, "x " + "b a " * 30000), (3, "the " * 12 + "x"), (4, "the " * 15 + "end")])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    start = time.monotonic()
    assert rows(winnow.contamination(docs, bench)) == {
        1: (60000, 60000, 2, sha("1,3"), True), 2: (60001, 60000, 1, sha("2"), True), 3: (13, 0, 0, sha(""), False),
        4: (16, 16, 2, sha("1,3"), True)}
    assert time.monotonic() - start < 60  # all pairs of equal fingerprints would be a thousand million


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=60), st.integers(1, 12))
def test_every_window_keeps_its_minimum(values, w):
    grams = np.array(values, np.uint64)
    kept = set(winnow.winnow(grams, w).tolist())
    expect = {p for i in range(len(values) - w + 1) for p in range(i, i + w) if values[p] == min(values[i:i + w])}
    assert kept == expect
