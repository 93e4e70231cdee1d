"""Phrases against a plain count of all n-grams, with forced collisions; the exact score; the ranking."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tabsieve.llm import collocations as col
from tabsieve.llm.common import prepare


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, widest=5, top=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for w in pieces(text):
            n[lang] += len(w)
            for k in range(1, widest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    f = {x: c for x, c in f.items() if c >= least}
    gone = set()
    for (lang, w), c in f.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                if f[lang, w[i:i + k]] == c:
                    gone.add((lang, w[i:i + k]))
    out = {}
    for (lang, w), a in f.items():
        if len(w) > 1 and (lang, w) not in gone:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                                 for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows_ in out.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top]))


def made(rng, n):
    words = ["Sun", "sea", "été", "🎉", "a", "b", "of", "the", "new", "york", "x\x00y", "zz"]
    gaps = [" ", "  ", "\t", " \t "] * 4 + [". ", ",", "\n", "!", "\r\n", "\x0b"]
    for _ in range(n):
        body = []
        for _ in range(rng.randint(0, 40)):
            body += [rng.choice(["new york", "the sea of the sun", rng.choice(words)]), rng.choice(gaps)]
        yield rng.choice(["en", "de", None]), "".join(body)


def frame(spark, rows, **extra):
    prepare(spark)
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    for name, value in extra.items():
        df = df.withColumn(name, F.lit(value))
    return df


def result(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_against_plain_counts(spark):
    rows = [*made(random.Random(1), 400), (None, None), ("en", ""), ("en", " . ,"), ("de", "a " * 30000)]
    rows += [("fr", "une seule phrase de cinq mots ici")] * 25
    docs = frame(spark, rows, phrase="clash", mark=1, score=2, rank="x", n=5)
    want = brute(rows, 20)
    assert {r[0] for r in want} == {"en", "de", "und", "fr"} and any(r[2].count(" ") == 4 for r in want)
    assert result(col.collocations(docs, least=20)) == want
    assert result(col.collocations(docs, least=20, top=7)) == brute(rows, 20, top=7)
    assert result(col.collocations(docs, least=5, widest=3)) == brute(rows, 5, widest=3)


def test_collisions_are_told_apart(spark):
    rows = list(made(random.Random(2), 150))
    assert result(col.collocations(frame(spark, rows), least=8, bits=7)) == brute(rows, 8)


def test_empty_and_rare(spark):
    assert col.collocations(frame(spark, [])).count() == 0
    assert col.collocations(frame(spark, [("en", "a b"), (None, None)])).count() == 0
    assert result(col.collocations(frame(spark, [("en", "a b")] * 100))) == [("en", 1, "a b", 100, 100, 100, 200, 2000)]


def test_scores_beyond_64_bits(spark):
    prepare(spark)
    big = 3 * 10**12
    phrases = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 2)],
                                    "lang string, phrase string, k long, a long")
    totals = spark.createDataFrame([("en", 10**13)], "lang string, n long")
    got = col.scored(phrases, totals).first()
    assert got.score == 1000 * (big - 2) * 10**13 // (big * (big - 1))


def test_ranking_in_groups(spark):
    prepare(spark)
    rng = random.Random(3)
    rows = [("en" if rng.random() < 0.9 else "de", rng.randint(0, 50), rng.randint(0, 3), f"p{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "lang string, score long, a long, phrase string")
    got = {(r.lang, r["rank"]): r.phrase for r in col.top_ranked(df, 20, group_rows=60).collect()}
    for lang in ("en", "de"):
        want = sorted((-s, -a, p.encode()) for x, s, a, p in rows if x == lang)[:20]
        assert [got[lang, i + 1] for i in range(20)] == [p.decode() for _, _, p in want]


def test_prints_and_sieve():
    data = np.frombuffer(b"abcabc abd", np.uint8)
    seed = np.uint64(5)
    mark, check = col.Prints(data).of(np.array([0, 3, 7]), np.array([3, 6, 10]), seed)
    assert mark[0] == mark[1] != mark[2] and check[0] == check[1] != check[2]
    want = 0
    for i, b in enumerate(b"abd"):
        want += int(col._CODES[b]) * pow(col._ROOT, i, int(col.PRIME))
    assert int(check[2]) == want % int(col.PRIME)


def test_sieve_misses_nothing(spark):
    prepare(spark)
    marks = np.random.default_rng(1).integers(-2**63, 2**63, 5000)
    sieve = col.sieve_of(spark.createDataFrame([(int(x),) for x in marks], "mark long"))
    assert sieve.holds(marks.view(np.uint64)).all()
    other = np.random.default_rng(2).integers(-2**63, 2**63, 20000).view(np.uint64)
    assert sieve.holds(other).mean() < 0.1
