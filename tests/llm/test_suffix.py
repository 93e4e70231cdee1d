"""Induced sorting against sorted suffixes, and removal against a search of every window."""

import hashlib
import random

import numpy as np
import pytest

from tabsieve.llm import induced, suffix
from tabsieve.llm.common import table


def test_order_and_prefixes(monkeypatch):
    rng = random.Random(0)
    for _ in range(250):
        symbols = rng.choice([1, 2, 3, 26])
        base = [rng.randrange(symbols) for _ in range(60)]
        strings = []
        for _ in range(rng.randint(1, 12)):
            a = rng.randint(0, 40)
            strings.append(base[a:a + rng.randint(1, 30)] if rng.random() < 0.5
                           else [rng.randrange(symbols) for _ in range(rng.randint(1, 30))])
        depth = rng.choice([1, 3, 5, 8, 20, 100])
        text = np.array([x for s in strings for x in [*(c + 1 for c in s), 0]], np.int16)
        own = {}
        at = 0
        for s in strings:
            own.update({at + i: tuple(s[i:i + depth]) for i in range(len(s))})
            at += len(s) + 1
        monkeypatch.setattr(induced, "BATCH", rng.choice([3, 1 << 16]))
        out = [(int(p), int(n)) for ps, ns in induced.suffixes(text, depth, rng.choice([0, 1 << 20])) for p, n in zip(ps, ns)]
        assert sorted(p for p, _ in out) == sorted(own)
        for (p, _), (q, n) in zip(out, out[1:]):
            same = next((i for i, (x, y) in enumerate(zip(own[p], own[q])) if x != y), min(len(own[p]), len(own[q])))
            assert own[p] >= own[q] and n == same


def brute(docs, length=100):
    """docs: (order key, text) in order; returns the result columns per document."""
    seen, out = set(), []
    for _, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in table(spark, f"/root/testdata/{sf}", "documents").orderBy("doc_id").collect()]
    want = sorted(((d, *x) for (d, _), x in zip(docs, brute(docs))), key=str)
    assert rows(suffix.op6_induced_suffixes(spark, f"/root/testdata/{sf}")) == want


def small(rng):
    base = "".join(rng.choice("abcdé ") for _ in range(2000))
    docs = [(1, None), (2, ""), (3, "x" * 99), (4, "x" * 100), (5, "x" * 500), (6, "ab" * 300), (7, base)]
    for i in range(8, 60):
        a, b = rng.randrange(1900), rng.randrange(1900)
        docs.append((i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(150))) + base[a:a + rng.randrange(300)]
                     + rng.choice("xyz") * rng.randrange(130) + base[b:b + 120]))
    return docs


@pytest.mark.parametrize("crowded", [20_000, 2, 0])
def test_small_texts_and_crowded_anchors(spark, make_docs, monkeypatch, crowded):
    monkeypatch.setattr(suffix, "CROWDED", crowded)
    known = suffix.crowded_anchors

    def local(*args):  # the tests' tasks run in other processes, so the count is taken here
        monkeypatch.setattr(suffix, "LOCAL", 1)
        return known(*args)
    monkeypatch.setattr(suffix, "crowded_anchors", local)
    docs = small(random.Random(8))
    want = sorted(((d, *x) for (d, _), x in zip(docs, brute(docs))), key=str)
    assert rows(suffix.removal_digests(make_docs(docs[::-1], spans="x", n_spans=1))) == want


def test_ids_that_repeat_or_lack(spark, make_docs):
    rng = random.Random(9)
    text = "".join(rng.choice("abcdefgh") for _ in range(400))
    docs = make_docs([(None, text), (5, text), (5, text), (5, text + "!"), (7, "short")])
    got = rows(suffix.removal_digests(docs))
    gone = {(r[0], r[1]): r[2] for r in got}
    assert len(got) == 5 and gone[(None, 400)] == 0 and gone[(5, 400)] == 400 and gone[(5, 401)] in (400, 401)
    assert suffix.removal_digests(make_docs([])).count() == 0


def test_removed_text(spark, make_docs):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdéfgh ") for _ in range(300))
    docs = make_docs([(1, "one " + passage), (2, "two é" + passage + "é end"), (3, None)], spans=1)
    out = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    assert out[1].text == "one " + passage and out[3].text is None and out[2].spans == 1
    assert out[2].text == "two éé end"


def test_rows_without_an_id_spread_over_buckets():
    rows = np.zeros(1000, suffix.SPAN)
    rows["doc"], rows["tie"] = suffix.NO_ID, np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 1000)
    assert np.bincount(suffix._doc_buckets(rows, 64), minlength=64).max() < 50
    own = np.zeros(1000, suffix.SPAN)
    own["doc"] = np.arange(1000)  # unique ids have no tie-break
    assert np.bincount(suffix._doc_buckets(own, 64), minlength=64).max() < 50


def test_windows_of_crowded_segments_have_two_hashes():
    data = np.frombuffer(bytes(random.Random(2).choices(range(97, 123), k=400)), np.uint8)
    segment = np.zeros(1, suffix.SEGMENT)
    segment["n"] = 301
    out = suffix._single_windows(data, segment, 100)
    assert len(out) == 301 and len(np.unique(out["c"])) == 301 and not (out["h"] == out["c"]).any()
    twice = suffix._single_windows(np.concatenate([data[:100], data[:100]]), np.array([(0, 0, 1, 0, 0, 101)], suffix.SEGMENT), 100)
    assert twice["h"][0] == twice["h"][100] and twice["c"][0] == twice["c"][100]
