"""Periodic runs against their definition, word by word, and the query against a plain reading of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np

from tabsieve.llm import periods
from tabsieve.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w):
    """Every maximal stretch by trying all periods; the smallest period of a stretch names it."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def collapse(w, runs):
    gone = {k for a, n, q in runs for k in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def plant(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute(doc_id, text):
    w = plant(doc_id, WORD.findall(text or ""))
    runs = brute_runs(w)
    best = (None,) * 4
    for a, n, q in runs:
        if best[0] is None or n * best[2] > best[1] * q:
            best = (a, n, q, 1000 * n // q)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *best, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(collapse(w, runs)))


def texts_of(rng, n):
    for _ in range(n):
        k = rng.choice([1, 2, 3, 8])
        w = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, len(w))
            block = [rng.choice("abcdefgh"[:k]) for _ in range(rng.randint(1, 6))]
            w[a:a] = block * rng.randint(2, 9) + block[:rng.randint(0, len(block))]
        yield w


def arrays(texts):
    first = np.cumsum([0] + [len(t) for t in texts])
    return np.array([ord(x) for t in texts for x in t], np.int64), first


def test_runs_of_many_texts():
    rng = random.Random(3)
    texts = list(texts_of(rng, 700))
    texts += [list("a") * 5, list("a") * 6, list("ab") * 4, list("abab") * 40, list("aab" * 30 + "aa")]
    ids, first = arrays(texts)
    start, end, period = periods.find_runs(ids, first)
    own = np.searchsorted(first, start, "right") - 1
    got = [[] for _ in texts]
    for t, a, b, q in zip(own, start, end, period):
        got[t].append((int(a - first[t]), int(b - a), int(q)))
    assert got == [brute_runs(t) for t in texts]
    assert [sorted((a, b - a, q) for a, b, q in periods.plain_runs(np.array([ord(x) for x in t]))) for t in texts] == got


def test_grammar_spells_the_text():
    ids, first = arrays(list(texts_of(random.Random(4), 60)) + [list("abcab") * 50])
    g = periods.Grammar(ids, first)
    spelled = {}
    for x, (a, m, b) in enumerate(g.node):
        spelled[x] = ids[a:b].tolist()
        assert a < m < b
    for x, at in zip(g.event_of, g.event_at):
        assert ids[at:at + len(spelled[x])].tolist() == spelled[x]
        t = np.searchsorted(first, at, "right") - 1
        assert at + len(spelled[x]) <= first[t + 1]
    assert all((g.event_of == x).sum() >= 2 for x in spelled)
    pairs = [(a, b, o) for a, b, o, p in zip(g.symbol, g.symbol[1:], g.own, g.own[1:]) if o == p]
    plain = [p for p in pairs if p[0] != p[1]]
    assert len({p[:2] for p in plain}) == len(plain)


def test_collisions_are_mended(monkeypatch):
    """With a hash that finds everything equal, words alone decide."""
    monkeypatch.setattr(periods.Prefixes, "equal", lambda self, a, b, n: np.ones(len(a), bool))
    texts = list(texts_of(random.Random(5), 60))
    ids, first = arrays(texts)
    start, end, period = periods.find_runs(ids, first)
    got = sorted(zip(start.tolist(), (end - start).tolist(), period.tolist()))
    assert got == sorted((a + f, n, q) for f, t in zip(first.tolist(), texts) for a, n, q in brute_runs(t))


def test_long_texts_stay_cheap():
    rng = np.random.default_rng(1)
    fib = "a", "ab"
    while len(fib[1]) < 100_000:
        fib = fib[1], fib[1] + fib[0]
    texts = [np.zeros(120_000, np.int64), np.tile(rng.integers(0, 9, 7000), 30), rng.integers(0, 3, 100_000),
             np.array([ord(x) for x in fib[1]])]
    first = np.cumsum([0] + [len(t) for t in texts])
    start, end, period = periods.find_runs(np.concatenate(texts), first)
    assert (start[0], end[0], period[0]) == (0, 120_000, 1)
    big = (start == first[1]) & (end == first[2])
    assert period[big].tolist() == [7000]
    assert not ((start >= first[3]) & (period > 6)).any()  # Fibonacci words have no exponent of 4


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli",
                                               "runs_sha256", "collapsed_sha256").collect()), key=str)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    assert rows(periods.op13_periodic_runs(spark, "/root/testdata/sf0.001")) == sorted(
        ((r.doc_id, *brute(r.doc_id, r.text)) for r in docs), key=str)


def test_edges(spark, make_docs):
    from pyspark.sql import functions as F
    texts = [None, "", " \n\t", "x", "a b " * 9, "Ünï 🎉 " * 7 + "end", "a\x0bb\x0ca\rb\na\tb a b a b", "w " * 3000,
             "\x00 " * 8, "a b " * 8]
    pairs = [*enumerate(texts), (4, texts[4]), (None, "z " * 9), (None, "z " * 9)]
    pairs += [(i, " ".join("abcd"[(i * k) % 4] for k in range(50))) for i in range(100, 160)]
    docs = make_docs(pairs, Runs="clash", n_words=1, best="b")
    found = periods.periodic_runs(docs)
    assert [c for c in found.columns if c.lower() == "runs"] == ["runs"] and "best" in found.columns
    plain = {(r.doc_id, r.collapsed, tuple(map(tuple, r.runs))) for r in found.collect()}
    want = set()
    for i, t in pairs:
        w = WORD.findall(t or "")
        want.add((i, collapse(w, brute_runs(w)), tuple(brute_runs(w))))
    assert plain == want
    thin = docs.select("doc_id", periods.planted(F.col("doc_id"), F.col("text")).alias("text"))
    got = rows(periods.run_digests(periods.periodic_runs(thin, ["doc_id"]), ["doc_id"]))
    assert got == sorted(((i, *brute(i, t)) for i, t in pairs), key=str)
    assert periods.run_digests(periods.periodic_runs(make_docs([])), ["doc_id"]).count() == 0
