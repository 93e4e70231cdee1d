"""Importance weights against a plain count, the sampler's law, and quality of the selection."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsieve.llm import resample as rs
from tabsieve.llm.common import prepare, table

LABELS = "doc_id long, quality int, toxic int"


def grams(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    t = re.findall(rb"[0-9a-z\x80-\xff]+|[\x21-\x2f\x3a-\x60\x7b-\x7f]+", raw)
    return t, list(zip(t, t[1:]))


def buckets(text):
    raw = (text or "").encode()
    b, own = rs.gram_buckets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return b


def test_buckets_follow_grams():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab é.!| \n9") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    seen = {}
    for t in texts:
        words, pairs = grams(t)
        b = buckets(t)
        assert len(b) == len(words) + len(pairs)
        for g, x in zip([*words, *pairs], b):
            assert seen.setdefault(g, x) == x
    joined = "".join(texts).encode()
    cuts = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    b, own = rs.gram_buckets(np.frombuffer(joined, np.uint8), cuts)
    for i, t in enumerate(texts):
        assert Counter(b[own == i].tolist()) == Counter(buckets(t).tolist())


def test_weights_and_top_k(spark, make_docs):
    rng = random.Random(2)
    good = lambda: " ".join(rng.choice(["sun", "sea", "hill", "road"]) for _ in range(30))
    junk = lambda: " ".join(rng.choice(["buy%%", "now||", "$$$"]) for _ in range(30))
    rows = [(i, good() if i % 4 else junk()) for i in range(200)] + [(200, None), (201, ""), (None, "sun"), (3, "sea")]
    docs = make_docs(rows, kept="x", n_grams=1)
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200, 3)] + [(None, 1, 0), (7, None, 0)], LABELS)
    out = rs.resample(docs, labels, share=0.75).collect()
    raw, target = np.ones(rs.BUCKETS), np.ones(rs.BUCKETS)
    for i, t in rows:
        raw += np.bincount(buckets(t), minlength=rs.BUCKETS)
        if i is not None and i < 200 and i % 3 == 0 and i % 4:
            target += np.bincount(buckets(t), minlength=rs.BUCKETS)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    want = sorted(round(float(ratio[buckets(t)].sum()), 6) for _, t in rows)
    assert np.allclose(sorted(r.log_weight for r in out), want, atol=2e-6)
    kept = sorted((r.gumbel_key for r in out if r.kept), reverse=True)
    assert len(kept) == round(0.75 * len(rows)) and kept[-1] > max(r.gumbel_key for r in out if not r.kept)
    assert sum(r.kept for r in out if r.doc_id is not None and r.doc_id < 200 and r.doc_id % 4 == 0) <= 5
    none = spark.createDataFrame([], LABELS)
    assert {r.log_weight for r in rs.resample(docs, none).collect()} == {0.0}
    assert rs.resample(make_docs([]), labels).count() == 0


def test_every_row_draws_for_itself(spark, make_docs):
    """Null ids and repeated rows are sampled like others, and exactly k rows are kept."""
    rows = [(i if i % 3 else None, f"word{i % 7} and more") for i in range(600)] + [(5, "the same row")] * 300
    out = rs.resample(make_docs(rows), spark.createDataFrame([], LABELS), share=0.5).collect()
    assert sum(r.kept for r in out) == 450 and len(out) == 900
    null, same = ([r.kept for r in out if r.doc_id == x] for x in (None, 5))
    assert 70 < sum(null) < 130 and 115 < sum(same) < 190
    assert sum(r.kept for r in rs.resample(make_docs(rows), spark.createDataFrame([], LABELS), share=0.0).collect()) == 0
    assert sum(r.kept for r in rs.resample(make_docs(rows), spark.createDataFrame([], LABELS), share=1.0).collect()) == 900


def test_kth_largest_between_neighbours(spark):
    prepare(spark)
    x = 1e16
    values = [x, np.nextafter(x, 2e16), np.nextafter(np.nextafter(x, 2e16), 2e16)] * 30
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    small, rs.SMALL = rs.SMALL, 5
    try:
        assert [rs.kth_largest(df, "x", k) for k in (1, 30, 31, 60, 61, 90)] == [
            sorted(values, reverse=True)[k - 1] for k in (1, 30, 31, 60, 61, 90)]
    finally:
        rs.SMALL = small


def test_kth_largest(spark, monkeypatch):
    prepare(spark)
    rng = random.Random(5)
    values = [rng.choice([0.0, 1.0, rng.random(), 1e6 * rng.random()]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    monkeypatch.setattr(rs, "SMALL", 5)
    for k in (1, 2, 700, 1500, 2999, 3000):
        assert rs.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]


def test_gumbel_law(spark):
    """The largest of two noisy keys is the first with the odds of its weight."""
    prepare(spark)
    a, b = rs.gumbel(F.col("id")), rs.gumbel(F.col("id") + 10**7)
    share = spark.range(20000).select(F.avg((a + float(np.log(3)) > b).cast("int"))).first()[0]
    assert share == pytest.approx(0.75, abs=0.02)


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    labels = table(spark, sf, "labels")
    rows = rs.op1_importance_resampling(spark, sf).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in rows}
    assert n[(1, True)] / (n[(1, True)] + n[(1, False)]) > 0.9
    assert n[(0, True)] / (n[(0, True)] + n[(0, False)]) < 0.6
