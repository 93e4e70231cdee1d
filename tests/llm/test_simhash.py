"""SimHash links and components against a comparison of all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from tabsieve.llm import simhash
from tabsieve.llm.common import prepare, table


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = {i: brute_fingerprint(t) for i, t in rows}
    parent = {i: i for i in fp}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(fp)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (f"{fp[i]:016x}", find(i)) for i in ids}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, sf_dir).collect()}
    assert got == brute(rows)


def test_edges(spark, make_docs):
    rng = random.Random(2)
    text = lambda k: " ".join(rng.choice("abcdefgh") for _ in range(k))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Word"), (5, "word"), (6, "a b"), (7, "\x0bÉ é\x0c"), (8, text(30000))]
    rows += [(10 + i, text(rng.randint(1, 6))) for i in range(60)]
    docs = make_docs(rows, component_id="x", fp="y")
    got = {r.doc_id: (f"{r.fp % (1 << 64):016x}", r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == brute(rows)
    kept = {r.doc_id for r in simhash.keep_first(docs.union(docs)).collect()}
    assert kept == {c for _, c in brute(rows).values()} and simhash.keep_first(docs.union(docs)).count() == len(kept)
    assert simhash.near_duplicates(make_docs([])).count() == 0
    nulls = simhash.near_duplicates(make_docs([(None, "q"), (None, "q"), (3, "q"), (None, "other words here")])).collect()
    assert sorted(str(r.component_id) for r in nulls) == ["3", "3", "3", "None"]


def test_one_row_of_each_component_is_kept(spark, make_docs):
    """Rows without an id and rows that share one are lost only to copies of their texts."""
    rng = random.Random(8)
    a, b, c, d, e, f = (" ".join(f"w{rng.randint(0, 10 ** 9)}" for _ in range(40)) for _ in range(6))
    rows = [(None, a), (None, b), (None, a), (None, c), (1, c), (2, d), (2, e), (2, d), (3, e), (4, f), (4, f), (5, None),
            (5, "")]
    fps = [brute_fingerprint(t) for _, t in rows]
    assert min((x ^ y).bit_count() for x in fps for y in fps if x != y) > 2
    kept = simhash.keep_first(make_docs(rows, digest="x", fp="y", n=1, last=False, label=0)).collect()
    assert [r.text or "" for r in kept if r.doc_id == 5] == [""]
    assert sorted((str(r.doc_id), r.text) for r in kept if r.doc_id != 5) == sorted(
        [("None", a), ("None", b), ("1", c), ("2", d), ("2", e), ("4", f)])


def test_links_of_dense_and_biased_bits(spark):
    """Buckets far over the limit are split and lose no pair."""
    prepare(spark)
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 1 << 62))
    near = {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (150, 2))}
    few = {int(x) & 0xFFF for x in rng.integers(0, 1 << 62, 200)}
    values = sorted(near | few | {int(x) for x in rng.integers(0, 1 << 62, 200)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1:] if (a ^ b).bit_count() <= 2}
    for bucket in (64, 16):
        assert {(r.a, r.b) for r in simhash.links(fps, bucket=bucket).collect()} == want


def test_allocation_is_cheapest():
    costs = [[5.0, 9.0, 20.0], [1.0, 2.0, 3.0], [7.0, 8.0, 9.0]]
    import itertools
    best = min(sum(c[t] for c, t in zip(costs, ts) if t >= 0) for ts in itertools.product(range(-1, 3), repeat=3)
               if sum(ts) == 0)
    cost, chosen = simhash.allocate(costs, 0)
    assert cost == best and sum(chosen) == 0
