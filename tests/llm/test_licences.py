"""Licence notices against every alignment of every template, tried one by one."""

import math
import random
import re

import duckdb
import pytest

from tabsieve.llm import licences as lic
from tabsieve.llm.common import prepare

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts):
    docs = [words(t) for t in texts]
    held = [set(d) for d in docs]
    weight = {w: math.floor(1000 * (1 + math.log((1 + len(docs)) / (1 + sum(w in h for h in held)))))
              for w in lic.vocabulary(lic.TEMPLATES)}
    out = []
    for d in docs:
        found = []
        for t in lic.TEMPLATES:
            total = sum(weight[w] for w in t.words)
            for s in range(-len(t.words), len(d)):
                ok = [0 <= s + p < len(d) and d[s + p] == w for p, w in enumerate(t.words)]
                got = sum(weight[w] for w, x in zip(t.words, ok) if x)
                if all(ok[p] for p in t.mandatory) and 100 * got >= 60 * total:
                    found.append((t.label, t.base, s, len(t.words), round(got / total, 6)))
        base = [f for f in found if f[1]]
        out.append((len(d), len(base), min((f[2] for f in base), default=None), max((f[2] for f in base), default=None),
                    ",".join(sorted({f[0] for f in base})), ",".join(sorted({f[0] for f in found})),
                    max((f[4] for f in found), default=0.0)))
    return out


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def rows(df):
    return sorted(((r.doc_id, *(r[c] for c in COLUMNS)) for r in df.collect()), key=str)


def texts():
    rng = random.Random(9)
    notices = [" ".join(t.words) for t in lic.TEMPLATES]
    out = [None, "", " .,;", "Under the MIT-License; under the mit license. UNDER/THE/MIT/LICENSE", "cc by nc " * 3,
           "apache license version 2 0 the license", "é under the mit licensé", "under the mit license" * 2,
           "CC BY-NC 4.0 and Apache License, Version 2.0 but no more", "mit " * 5000 + "under the mit license"]
    pool = lic.vocabulary(lic.TEMPLATES)[:40] + ["the", "license", "public", "x", "und"]
    for n in notices:
        w = n.split()
        cut = rng.randint(0, len(w) - 1)
        changed = [x if rng.random() < 0.85 else "zz" for x in w]
        out += [n.title(), " ".join(w[cut:]), " ".join(w[:cut]), "a b " + " ".join(changed), ", ".join(w) + "\n" + n]
    out += [" ".join(rng.choice(pool) for _ in range(rng.randint(1, 80))) for _ in range(80)]
    return out


@pytest.fixture(scope="module")
def wanted():
    return brute(texts())


def test_against_every_alignment(spark, make_docs, wanted):
    docs = make_docs([*enumerate(texts())], Notices="clash", n_words="x", base_notices="y")
    found = lic.licence_notices(docs)
    assert [c for c in found.columns if c.lower() == "notices"] == ["notices"]
    assert rows(lic.label_columns(found, ["doc_id", "base_notices"])) == sorted(
        ((i, *w) for i, w in enumerate(wanted)), key=str)
    assert {w[5] for w in wanted} >= {"gpl-3", "bsd", "cc-by", "mit", "lgpl"}


def test_sql_says_the_same(wanted, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [*enumerate(texts())])
    got = con.sql(f"SELECT doc_id, {', '.join(COLUMNS)} FROM ({lic.OP12_SQL})").fetchall()
    assert sorted(got, key=str) == sorted(((i, *w) for i, w in enumerate(wanted)), key=str)


def test_edges(spark, make_docs):
    docs = make_docs([(None, "under the mit license"), (None, "under the mit license"), (1, "a"), (1, "a")])
    got = rows(lic.label_columns(lic.licence_notices(docs, ["doc_id"]), ["doc_id"]))
    assert [r[:7] for r in got] == [(1, 1, 0, None, None, "", "")] * 2 + [(None, 4, 1, 0, 0, "mit", "mit")] * 2
    assert lic.label_columns(lic.licence_notices(make_docs([]), ["doc_id"]), ["doc_id"]).count() == 0
    prepare(spark)
    assert lic.document_counts(make_docs([(1, "mit mit"), (2, "Mit"), (3, None)]), ["mit", "x"]) == (3, {"mit": 2, "x": 0})


def test_whole_table(spark):
    from tabsieve.llm.common import table
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents").collect()
    assert rows(lic.op12_rare_token_index(spark, sf)) == sorted(
        ((r.doc_id, *w) for r, w in zip(docs, brute([r.text for r in docs]))), key=str)
